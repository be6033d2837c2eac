import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoptrail.llm import collocations


def plain(docs, least=10, top=2000, share=50):
    """The report by counting every run of one to three words."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if len(p) == 2 and any(100 * n >= share * a for q, n in often.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(spark, docs, **options):
    rows = [(i // 2, t, lang, "x", "y", 1) for i, (lang, t) in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, w1 string, n int")
    return sorted(map(tuple, collocations.collocations(table, **options).collect()))


@pytest.mark.parametrize("held", (1, 1 << 24))
def test_equals_brute_force(spark, monkeypatch, held):
    """Pieces, odd white space, letters beyond ASCII, overlaps, null langs and texts, ties; batches of one row and of all."""
    monkeypatch.setattr(collocations, "HELD", held)
    rng = np.random.default_rng(5)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ; ", "?!"]
    docs = [(None, None), ("en", ""), ("en", " \t\n.,"), ("de", "a a a a a a a a a a a a"), ("fr", "É é\x1cx\x85 " * 15), ("en", "A b. " * 30), ("und", "a b " * 6)]
    for i in range(150):
        words = rng.choice(list("abcdefgHIJKL"), int(rng.integers(1, 60)), p=np.arange(12, 0, -1) / 78)
        docs.append(([None, "en", "de", "de", "und"][i % 5], "".join(w + marks[int(rng.integers(0, len(marks)))] for w in words)))
    want = plain(docs)
    assert len(want) > 50 and mined(spark, docs) == want
    assert mined(spark, docs, least=3, top=7, share=90) == plain(docs, 3, 7, 90)


def test_a_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    docs = [("en", " ".join(f"w{i % 7}x{i * i % 11}" for i in range(900)))]
    want = plain(docs)
    monkeypatch.setattr(collocations, "passes", lambda filter_, hashes: np.ones(len(hashes), bool))
    assert mined(spark, docs) == want != []


def test_a_long_text_and_no_text(spark):
    docs = [("en", "one two three four " * 30_000)]
    assert mined(spark, docs) == plain(docs)
    assert mined(spark, []) == [] and mined(spark, [("en", None)]) == []


def test_frequent_groups_pass_the_filter(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-2 ** 63, 2 ** 63, 1000) >> 16 << 16
    made = collocations.frequent_filter(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert collocations.passes(made, h.view(np.uint64)).all() and 990 < int(np.unpackbits(made).sum()) <= 1000


def test_words_have_the_numbers_that_spark_gives_them(spark):
    made = collocations.Numbering("7", 50)
    words = ["", "a", "é", "日本語", "x" * 7, "y" * 8, "z" * 31, "w" * 32, "v" * 77, "ab\x00c"]
    for lang in ("", "en", "und"):
        table = spark.createDataFrame([(lang, w) for w in words], "lang string, w1 string")
        want = made.hashes(lang, words)
        got = {r.w1: (r.h, r.i) for r in table.select("w1", made.hash_column().alias("h"), made.column().alias("i")).collect()}
        assert [got[w] for w in words] == [(int(h), int(i)) for h, i in zip(want.view(np.int64), made.numbers(want))]


def test_words_that_share_a_number_are_not_counted_as_one(spark, monkeypatch):
    """Numbers of six bits are shared by frequent words, so wider ones are tried; rare words may share one."""
    words = spark.createDataFrame([("en", f"w{i}", 12) for i in range(40)] + [("de", f"r{i}", 1) for i in range(40)], "lang string, w1 string, n int")
    tried = []
    column = collocations.Numbering.column
    monkeypatch.setattr(collocations, "min", lambda a, b: b if b < 30 else 6 if not tried else a, raising=False)
    monkeypatch.setattr(collocations.Numbering, "column", lambda self: tried.append(self) or column(self))
    made = collocations.numbering(words, 10)
    assert [t.wide for t in tried][0] == 6 and made == tried[-1] and len(tried) > 1 and len({t.salt for t in tried}) == len(tried)
    shared = words.filter("n > 1").groupBy(column(made)).count().filter("count > 1")
    assert shared.count() == 0


def test_each_group_is_counted_once_by_the_tasks(spark, monkeypatch):
    """No second pass over the texts sends the frequent groups again: one row for each group of a task, exact however few are held."""
    docs = [("en", " ".join(f"w{i * i % 13}" for i in range(700))), ("de", "x y z " * 60)]
    want = plain(docs)
    monkeypatch.setattr(collocations, "GROUPS", 5)
    assert mined(spark, docs) == want != [] and not hasattr(collocations, "counted")


def test_groups_of_a_large_vocabulary():
    import pyarrow as pa
    own = collocations.Rows(pa.array(["a b c a b c \n b c", "c a", ""]))
    small = own.groups(3)
    own.words = pa.array(own.words.to_pylist() + [f"u{i}" for i in range(1 << 21)])
    for a, b in zip([*small[0], small[1]], [*(x := own.groups(3))[0], x[1]]):
        assert a.tolist() == b.tolist()
    assert sorted(small[1].tolist()) == [1, 1, 2]
