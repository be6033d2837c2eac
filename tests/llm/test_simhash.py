import re

import numpy as np
import pytest
import xxhash

from conftest import SF
from shoptrail.llm import simhash


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, near):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 3)
    texts = [None, "", " \t\n", "one", "One two\x0bTHREE", "a b c d e f g h A B", "É é ß a", "\x1c\x85 x\xa0y z w v", "x " * 50]
    for t in texts:
        for k in (1, 4, 5):
            assert simhash.fingerprint(t, k) == plain_fingerprint(t, k), (t, k)


def test_query_equals_brute_force(spark, rows):
    docs = rows("SELECT doc_id, text FROM '@documents.parquet'")
    fp = {d: plain_fingerprint(t, 4) for d, t in docs}
    want = roots(sorted(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.op5(spark, SF).collect()}
    assert set(got) == set(fp) and len(set(want.values())) < len(fp)
    assert all(int(r.fingerprint, 16) == fp[d] and len(r.fingerprint) == 16 and r.component_id == want[d] for d, r in got.items())


@pytest.mark.parametrize("seed", range(8))
def test_trie_join_equals_brute_force(seed, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = np.random.default_rng(seed)
    keys = [0, 1, 2**64 - 1, 2**63]
    for c in rng.integers(0, 2**63, 25).tolist():
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                c ^= 1 << b
            keys.append(c)
    keys = np.unique(np.array(keys, np.uint64))
    home = rng.random(len(keys)) < 0.6
    ids = list(range(len(keys)))
    near = [(a, b) for a in ids for b in ids if a < b and (home[a] or home[b]) and (int(keys[a]) ^ int(keys[b])).bit_count() <= 4]
    a, b = simhash.near_forest(keys, home, 4)
    assert roots(ids, near) == roots(ids, list(zip(np.searchsorted(keys, a).tolist(), np.searchsorted(keys, b).tolist())))
    assert len(a) < len(keys)  # a forest, not all pairs


def test_a_large_group_costs_a_forest():
    rng = np.random.default_rng(0)
    keys = np.unique(np.array([sum(1 << b for b in set(rng.integers(0, 64, 3).tolist())) for _ in range(20_000)], np.uint64))
    a, _ = simhash.near_forest(keys, np.ones(len(keys), bool), 4)
    assert len(a) == len(keys) - 1


@pytest.mark.parametrize("top", (3, 6))
def test_links_over_units(spark, top):
    """Fingerprints that differ in their first bits meet although they are at home in different units."""
    base = 0x0123456789ABCDEF
    keys = [base, base ^ (7 << 61), base ^ (15 << 60), base ^ (1 << 63) ^ 7, base ^ (31 << 59), base ^ 0xFF]
    signed = [(int(np.array(k, np.uint64).view(np.int64)),) for k in keys]
    links = [tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fp long"), 4, len(keys), top).collect()]
    ids = [k for k, in signed]
    near = [(a, b) for a in ids for b in ids if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert roots(ids, links) == roots(ids, near)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7), (9000, 9000)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5001] == got[5000] == 5000
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXT = " ".join(f"w{i}" for i in range(400))


def test_defined_cases(spark):
    rows = [(3, None, 0), (8, " \n", 0), (5, TEXT, 0), (4, TEXT, 0), (4, TEXT, 0), (None, TEXT, 0), (6, "other text of its own here", 0)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(3, 3), (8, 3), (5, 4), (4, 4), (4, 4), (None, 4), (6, 6)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_each_keeps_columns_and_one_row(spark):
    near = TEXT.replace("w7 ", "v7 ")
    rows = [(9, TEXT, "a", 1), (5, near, "b", 2), (5, near, "b", 2), (None, TEXT, "c", 3), (7, "clean one", None, 4), (None, "clean two", "d", 5),
            (None, "clean three", "d", 6), (11, None, "e", 7), (12, "", "f", 8)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp string, first int"))
    assert got.columns == ["doc_id", "text", "fp", "first"]
    assert sorted(r["first"] for r in got.collect()) == [2, 4, 5, 6, 7]


def test_no_unit_holds_more_than_two_prefixes(spark, monkeypatch):
    """The work is spread over pairs of prefixes, and a prefix that holds too much is split."""
    monkeypatch.setattr(simhash, "UNIT", 100)
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate((rng.integers(0, 2**64, 600, np.uint64), rng.integers(0, 2**59, 600, np.uint64))))
    keys = np.unique(np.concatenate((keys, keys[::3] ^ (np.uint64(1) << rng.integers(0, 64, len(keys[::3])).astype(np.uint64)))))
    distinct = spark.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "fp long")
    starts, depths = simhash.prefixes(distinct, 3)
    assert depths.max() > 3
    held = simhash.unit_pairs(distinct, 4, starts, depths).groupBy("low", "high").count().agg({"count": "max"}).first()[0]
    assert held <= 200
    got = [tuple(r) for r in simhash.links(distinct, 4, len(keys), 3).collect()]
    ids = keys.view(np.int64).tolist()
    near = [(ids[i], ids[j]) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 4).tolist() if i != j]
    assert roots(ids, got) == roots(ids, near)


def changed(words, n):
    """words with n of them exchanged, each far from the next one."""
    out = list(words)
    for i in range(n):
        out[10 + 12 * i] = f"new{i}"
    return out


def test_copies_of_eight_tenths_are_one(spark):
    """Of pairs at 0.815 one stays, of pairs at 0.73 both, and a large group of near copies is one, with a straggler of 0.73."""
    base = [[f"w{j}x{i}" for i in range(200)] for j in range(31)]
    docs = [(100 * j + v, " ".join(changed(base[j], n))) for j in range(30) for v, n in ((0, 0), (1, 4 if j < 20 else 6))]
    docs += [(5000 + i, " ".join([*base[30][:190 + i % 9], f"end{i}"])) for i in range(40)] + [(6000, " ".join(changed(base[30], 7)))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {100 * j for j in range(30)} | {100 * j + 1 for j in range(20, 30)} | {5000, 6000}


def sets_of(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def all_pairs(docs, similar=0.8):
    """Components of a Jaccard of `similar` over every pair of documents."""
    sets = {d: sets_of(t) for d, t in docs}
    ids = sorted(sets)
    alike = lambda a, b: len(a & b) >= similar * len(a | b)
    return roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if alike(sets[a], sets[b])])


@pytest.mark.parametrize("block", (1024, 7))
def test_what_stays_equals_all_pairs(spark, rows, monkeypatch, block):
    """The given documents, groups of near copies at many distances and chains, also with blocks of a few texts."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(7)
    docs = rows("SELECT doc_id, text FROM '@documents.parquet'")
    base = [[f"w{j}x{i}" for i in range(150)] for j in range(12)]
    made = [" ".join(changed(base[j % 12], int(rng.integers(0, 9)))) + f" tail{j % 5}" for j in range(120)]
    made += [" ".join(f"c{x}" for x in range(4 * i, 4 * i + 100)) for i in range(30)]  # neighbours are alike, the ends are not
    docs = docs + [(10_000 + i, t) for i, t in enumerate(made)]
    want = set(all_pairs(docs).values())
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(want) and len(want) < len(docs) - 80


def test_columns_of_any_name_stay(spark):
    names = ["text_digest", "node", "cluster", "digest", "stay_id", "key", "_hash"]
    docs = spark.createDataFrame([(1, TEXT, *range(7)), (2, TEXT, *range(7)), (3, "b", *range(7))], ["doc_id", "text", *names])
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, TEXT, *range(7)), (3, "b", *range(7))]
