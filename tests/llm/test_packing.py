import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from shoptrail.llm import packing


def held(plan, size):
    counts = np.zeros(size, int)
    for content, n in plan.items():
        assert sum(content) < size
        for length in content:
            counts[length] += n
    return counts


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.gamma(1.2, 500, 30_000).astype(int), 1, 3000) % 1024 + 1
    if seed == 1:
        lengths[:10_000] = 700  # one length has a third of all pieces
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.plan(counts)
    assert (held(plan, 1025) == counts).all()
    assert sum(plan.values()) <= 1.002 * sum(packing.best_fit(counts).values())
    if seed != 1:
        assert sum(plan.values()) <= 1.003 * -(-int((counts * np.arange(1025)).sum()) // 1024)


def test_plan_of_few_pieces():
    for lengths in ([], [1024], [1], [1024, 1023, 1], [513, 513], [512, 512, 300, 300, 424]):
        counts = np.bincount(lengths, minlength=1025)
        assert (held(packing.plan(counts), 1025) == counts).all()
    assert sum(packing.plan(np.bincount([512, 512, 300, 300, 424], minlength=1025)).values()) == 2


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def whole(pieces, ids):
    """pieces cover the documents' ids, and sequences without gaps."""
    from collections import defaultdict
    of, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        seq[p.sequence_id].append((p.offset, p.length))
    assert set(of) == set(ids)
    for d, own in of.items():
        own.sort(key=lambda p: p.piece)
        n = len(ids[d])
        assert [(p.start, p.length) for p in own] == packing.cut(n, 1024) and [p.piece for p in own] == list(range(len(own)))
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][p.start:p.start + p.length], "<u4").tobytes())
    for own in seq.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 1024
    return len(seq)


def test_query_equals_brute_force(spark, rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    docs = rows("SELECT doc_id, coalesce(text, '') FROM '@documents.parquet'")
    ids = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in docs}
    used = whole(packing.op4(spark, SF).collect(), ids)
    assert used <= 1.02 * -(-sum(map(len, ids.values())) // 1024)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "word " * 5000, 0), (4, "x", 0), (4, "x", 0)],
                                 "doc_id long, text string, sequence_id int")
    got = packing.packed(docs, packing.tokenizer_path())
    assert got.filter("doc_id IN (1, 2)").agg(F.sum("length")).first()[0] == 2
    assert got.filter("doc_id = 4").count() == 2 and got.filter("doc_id IS NULL").count() == 1
    assert got.filter("doc_id = 3").agg(F.sum("length"), F.max("length"), F.max("piece")).first()[:2] == (5002, 1024)
    places = got.select("sequence_id", "offset").distinct().count()
    assert places == got.count()
    assert packing.packed(docs.limit(0), packing.tokenizer_path()).count() == 0


def test_hot_length_is_spread(spark):
    """A length that most pieces have is ranked in many groups."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, id % 900 + 1, 77) AS length", "id AS ids_crc32")
    got = packing.ranked(rows, [F.col("doc_id")], 64)
    n = got.groupBy("length").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m"))
    assert n.filter("n <> d OR m <> n - 1").count() == 0
    assert "length#" in got._jdf.queryExecution().executedPlan().toString() and "_bucket" in got._jdf.queryExecution().executedPlan().toString()
