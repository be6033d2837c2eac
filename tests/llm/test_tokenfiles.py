import zlib

import numpy as np
import pytest

from conftest import SF
from shoptrail.llm import tokenfiles, tokens
from shoptrail.llm.shared import folder


def path(name):
    import public_tokenizers
    return public_tokenizers.path(name)


@pytest.mark.parametrize("seed", range(5))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([5, 6, 7, 8, 49407], 5000, p=[.5, .3, .1, .05, .05]).astype(np.uint32)
    if seed == 4:
        ids[:] = 9
    sizes = [0, 1, 1000, 0, 3999]
    data = tokenfiles.shard_bytes([4, None, -7, 2**62, 5], sizes, ids, 77)
    shard = tokenfiles.Shard(data)
    assert len(shard.rules) > 3 and len(shard.symbols) < 0.7 * len(ids) and shard.base == 77
    assert np.array_equal(shard.expand(0, 5000), ids) and list(shard.tokens) == sizes and list(shard.nulls) == [0, 1, 0, 0, 0]
    for a, b in rng.integers(0, 5001, (200, 2)):
        assert np.array_equal(shard.expand(int(a), int(b)), ids[a:b])
    for k, (a, b) in enumerate(shard.rules):
        assert max(a, b) < shard.first + k


def test_grammar_replaces_left_pairs_first():
    x = np.array([1, 1, 1, 1, 1, 2, 1, 1], np.int32)
    rules, left = tokenfiles.grammar(x.astype(np.uint32), least=3, rounds=1)
    assert rules.tolist() == [[1, 1]] and left.tolist() == [49408, 49408, 1, 2, 49408]
    assert tokenfiles.grammar(x[:0].astype(np.uint32))[1].tolist() == []


def test_rules_are_taken_until_none_pays():
    """No pair is left that would save more bytes than its rule takes, as long as symbols are free; the file is smaller for it."""
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 3000, 12), 6) for _ in range(400)] + [rng.integers(0, 3000, 5000)]).astype(np.uint32)
    rules, left = tokenfiles.grammar(ids)
    assert len(rules) < (1 << 16) - tokenfiles.IDS
    # pairs of equal symbols overlap, so that fewer can be replaced than stand there
    pairs = [p for p in zip(left[:-1].tolist(), left[1:].tolist()) if p[0] != p[1]]
    assert max(pairs.count(p) for p in set(pairs)) < 2 * tokenfiles.LEAST  # those that are left overlap
    size = lambda r, x: tokenfiles.RULE * len(r) + 2 * len(x)
    assert size(rules, left) < 0.8 * size([], ids) and size(rules, left) < size(*tokenfiles.grammar(ids, least=200))


def test_broken_files():
    good = tokenfiles.shard_bytes([1], [3], np.array([5, 6, 1], np.uint32), 0)
    tokenfiles.Shard(good)
    for bad in (good[:-1], b"XXXX" + good[4:], good[:60] + b"\1" + good[61:], good + b"\0", b""):
        with pytest.raises(tokenfiles.Broken):
            tokenfiles.Shard(bad)


ODD = ["a  b", "a\n b", " a", "a ", "\n\n x", "x \n y", "<|endoftext|> a<|endoftext|>b", "  ", "", "\n", "a\t b", "é̈ x  y z", "a   b",
       "it's 's ' s", "ΑΣ ΑΣ.", "x  y", "İstanbul ISS ß. Ünï,", "n1 22 333\n\n\n z", "a.\nB c,\nD", "\nq\n", "日本語 テキスト。", "a,. b.,", "x\x1cy \x85z", "ª º µ."]


@pytest.mark.parametrize("name,spaces", (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)))
def test_ids_are_the_librarys(rows, name, spaces, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 500)
    coder = tokens.Encoder(path(name), spaces)
    for text in ODD + [t or "" for _, t in rows("SELECT doc_id, text FROM '@documents.parquet'")]:
        want = np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.ids(text) == want, text[:100]


def test_query_equals_brute_force(spark, rows, monkeypatch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want, start = [], 0
    for d, x in rows("SELECT doc_id, coalesce(text, '') FROM '@documents.parquet' ORDER BY doc_id"):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfiles.op6(spark, SF).collect())) == want


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD", 50)
    docs = spark.createDataFrame([(3, None, 0), (1, "", 0), (None, "a", 0), (2, "word " * 300, 0), (5, "y", 0), (5, "x x", 0), (9, "z", 0)],
                                 "doc_id long, text string, start int")
    into = folder(spark, "tokens-test")
    got = tokenfiles.read_shards(tokenfiles.write_shards(docs, into, path("word_bpe_49k.json"), 3), into)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in got.collect())
    assert rows == [(0, None, 2), (2, 1, 1), (3, 2, 301), (304, 3, 1), (305, 5, 3), (308, 5, 2), (310, 9, 2)]
    into = folder(spark, "tokens-test")
    assert tokenfiles.read_shards(tokenfiles.write_shards(docs.limit(0), into, path("word_bpe_49k.json"), 3), into).count() == 0


def test_expansion_lengths_without_the_expansions():
    rng = np.random.default_rng(3)
    ids = rng.choice([5, 6, 7, 20592], 4000).astype(np.uint32)
    rules, left = tokenfiles.grammar(ids)
    offsets, texts = tokenfiles.expansions(rules, tokenfiles.IDS)
    assert len(rules) > 20 and np.array_equal(tokenfiles.spans(rules, tokenfiles.IDS), np.diff(offsets)) and texts.dtype == np.uint32
    assert tokenfiles.spans(rules[:0], tokenfiles.IDS).tolist() == [] == tokenfiles.expansions(rules[:0], tokenfiles.IDS)[1].tolist()
    again = tokenfiles.shard_bytes([1], [len(ids)], ids, 0)
    assert np.array_equal(tokenfiles.Shard(again).expand(0, len(ids)), ids)


def test_a_batch_is_its_texts(rows, monkeypatch):
    """Nulls, empty texts and slices; words, and words with marks, are put together from what is known, few or many of them kept."""
    import pyarrow as pa
    texts = [None, "", *ODD, "Word. word, WORD!! word*** 'word word's (word) ...", "ßa. ÿ!", None] + [t for _, t in rows("SELECT doc_id, text FROM '@documents.parquet'")]
    column = pa.array(["x"] + texts, pa.string()).slice(1)
    for kept in (0, 500, 1 << 20):
        monkeypatch.setattr(tokens, "WORDS", kept)
        coder = tokens.Encoder(path("word_bpe_49k.json"), False)
        for _ in range(2):
            ids, many = coder.batch(column)
            want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(coder.first) <= kept
    ids, many = coder.batch(column.slice(0, 0))
    assert len(ids) == len(many) == 0


def test_a_word_is_encoded_once_whatever_its_case_and_marks(monkeypatch):
    import pyarrow as pa
    coder = tokens.Encoder(path("word_bpe_49k.json"), False)
    seen, encode = [], coder._word
    monkeypatch.setattr(coder, "_word", lambda word, before="": seen.append(word) or encode(word, before))
    coder.batch(pa.array(["Anthouing anthouing, ANTHOUING!! anthouing***", "anthouing. and anthouing"]))
    assert sorted(seen) == ["and", "anthouing"]


def test_rounds_that_look_at_a_few_pairs_find_what_all_pairs_give():
    rng = np.random.default_rng(8)
    for ids in (rng.integers(0, 60, 30_000), np.concatenate([np.tile(rng.integers(0, 90, 9), 7) for _ in range(900)]), np.repeat(rng.integers(0, 9, 4000), 5)):
        rules, left, first, whole = [], ids.astype(np.uint32), tokenfiles.IDS, tokenfiles.grammar(ids.astype(np.uint32))
        while True:
            more, left = tokenfiles.grammar(left, first + len(rules), rounds=1)
            if not len(more):
                break
            rules += more.tolist()
        assert len(rules) > 100 and whole[0].tolist() == rules and whole[1].tolist() == left.tolist()


def test_many_texts_with_spaces_are_encoded_at_once(rows, monkeypatch):
    """A different piece is looked up once for all texts, and its word apart from its marks, even if nothing is kept; nulls, slices, odd texts."""
    import pyarrow as pa
    texts = [None, "", *ODD, "heat$$$ heat*** A### heat.%%%\nheat$$$ (heat) it's\n'tis", "ßa!! ÿ.\nÿ..", None] + [t for _, t in rows("SELECT doc_id, text FROM '@documents.parquet'")]
    column = pa.array(["x"] + texts, pa.string()).slice(1)
    for kept in (0, 500, 1 << 20):
        monkeypatch.setattr(tokens, "HELD", kept)
        coder = tokens.Encoder(path("byte_bpe_50k.json"), True)
        for _ in range(2):
            ids, many = coder.batch(column)
            want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert max(len(coder.first), len(coder.later)) <= kept
    ids, many = coder.batch(column.slice(0, 0))
    assert len(ids) == len(many) == 0
    monkeypatch.setattr(tokens, "HELD", 0)
    coder = tokens.Encoder(path("byte_bpe_50k.json"), True)
    seen, word, whole = [], coder._word, coder._whole
    monkeypatch.setattr(coder, "_word", lambda w, before="": seen.append(before + w) or word(w, before))
    monkeypatch.setattr(coder, "_whole", lambda text: seen.append(text) or whole(text))
    coder.batch(pa.array(["a heat$$$ heat$$$", "b heat$$$\nheat"]))
    assert sorted(seen) == ["$$$", "a", "b", "heat", "Ġheat"]


def test_odd_white_space_is_pythons():
    import pyarrow as pa
    import pyarrow.compute as pc
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = pc.match_substring_regex(pa.array(letters), tokens.ODD).to_pylist()
    assert [c for c, x in zip(letters, odd) if x] == [c for c in letters if c.isspace() and c not in " \n"]
    assert pc.match_substring_regex(pa.array(["a b\nc", "a  b", "a \n", "\n a", "\n\n"]), tokens.ODD).to_pylist() == [False] + [True] * 4


def test_portions_hold_every_text_once(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokens, "PORTION", 10)
    texts = pa.array(["x"] + [None, "a" * 4, "é" * 4, "", "b" * 35, "c", None, "d" * 9] * 3, pa.string()).slice(1)
    cuts = list(tokens.portions(texts))
    assert [i for a, z in cuts for i in range(a, z)] == list(range(len(texts))) and len(cuts) > 6
    assert all(sum(len((t or "").encode()) for t in texts.slice(a + 1, max(z - a - 1, 0)).to_pylist()) <= 10 for a, z in cuts)
    assert list(tokens.portions(texts.slice(0, 0))) == [(0, 0)]


def test_memory_holds_words_apart_from_case_and_marks():
    """A word takes one place however it is written; what is no such word is kept as it stands."""
    import pyarrow as pa
    coder = tokens.Encoder(path("word_bpe_49k.json"), False)
    texts = ["Word. word, WORD!! ÉTÉ", "été. it's It's 9! ... \u0130\u0130.", "word"] * 2
    for _ in range(2):
        ids, many = coder.batch(pa.array(texts))
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert sorted(coder.first) == sorted(["word", "été", "", ".", ",", "!!", "...", "it's", "It's", "9!", "\u0130\u0130."])
        assert [coder.table[a:a + n].tolist() for a, n in zip(np.cumsum(coder.width) - coder.width, coder.width)] == [
            coder.tokenizer.encode(w, add_special_tokens=False).ids for w in coder.first]


def test_pairs_that_overlap_are_taken_from_the_left():
    rng = np.random.default_rng(5)
    for at in (np.empty(0, np.int64), np.array([0]), np.arange(7), np.flatnonzero(rng.random(3000) < 0.7), np.flatnonzero(rng.random(3000) < 0.1)):
        taken = []
        for i in at.tolist():
            if not taken or taken[-1] < i - 1:
                taken.append(i)
        assert at[tokenfiles.apart(at)].tolist() == taken


def test_gathered_batches_hold_every_row_once(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokens, "PORTION", 100)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(["x" * n, None] * n, pa.string())[:n]}) for n in (3, 0, 1, 40, 2, 0, 9)]
    got = list(tokens.gathered(iter(batches)))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
    assert 1 < len(got) < len(batches) and all(b.column(1).nbytes >= 100 for b in got[:-1])
    assert list(tokens.gathered(iter([]))) == []
