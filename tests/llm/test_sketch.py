import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF
from shoptrail.llm import sketch


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def all_hashes(text):
    words = [w for w in re.split(r"[\t-\r ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def of(part):  # Spark's hash of several values: each is hashed with the one before as seed
        seed = 42
        for h in part:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed)
    return {of(hashes[i:i + 5]) for i in range(max(1, len(hashes) - 4))} if hashes else set()


def plain_sketch(text):
    found = all_hashes(text)
    return sorted(h for h in found if h < -(1 << 63) + (1 << 61)) or sorted(found)[:1]


def hexed(s):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in s)


def alike(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def check(got, docs):
    docs = sorted(docs)
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        after, r = docs[(i + 1) % len(docs)][1], got[d]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        own, other, next_ = map(plain_sketch, (t, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(other))
        assert (r.near_edited, r.near_next) == (alike(own, other), alike(own, next_))


def test_query_equals_brute_force(spark, rows):
    docs = rows("SELECT doc_id, coalesce(text, '') FROM '@documents.parquet'")
    check({r.doc_id: r for r in sketch.op9(spark, SF).collect()}, docs)


@pytest.mark.parametrize("n", (0, 1, 2, 3, 40))
def test_small_tables(spark, tmp_path, n):
    docs = [(i * 1000, ["", "ÄÖ a B c d e f \n g", "x", None, "😀" * 50 + " a b c d e f"][i % 5]) for i in range(n)]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, range string").write.parquet(f"{tmp_path}/documents.parquet")
    check({r.doc_id: r for r in sketch.op9(spark, str(tmp_path)).collect()}, [(d, t or "") for d, t in docs])


def test_nulls_and_repeats(spark, tmp_path):
    spark.createDataFrame([(None, "a"), (None, None), (5, "b c"), (5, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sketch.op9(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "None", "None"] and len({r.fingerprint for r in got if r.doc_id == 5}) == 1


def test_short_texts_are_told_apart(spark):
    texts = ["red apples", "blue sky over the sea", "my cat", "totally other thing", "a", "", " \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sketch.fingerprint(sketch.sketch(F.col("t"))).alias("f")).collect()
    assert len({r.f for r in rows}) == 6 and [r.t for r in rows if r.f == ""] == ["", " \n"]


def test_merging_equals_the_sketch_of_all_shingles(spark):
    parts = [" ".join(f"w{i}" for i in range(a, z)) for a, z in ((0, 3), (0, 5), (7, 12), (0, 60), (30, 900), (0, 0))]
    pairs = [(a, b) for a in parts for b in parts]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sketch.merged(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m")).collect()
    for r in rows:
        both = {h for t in (r.a, r.b) for h in all_hashes(t)}
        assert r.m == (sorted(h for h in both if h < -(1 << 63) + (1 << 61)) or sorted(both)[:1])


def test_sketches_merge(spark):
    """The sketch of a long text holds those of its parts, whatever their sizes."""
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:60]))], "a string, b string")
    row = df.select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b")).select(
        sketch.containment(F.col("a"), F.col("b")).alias("c"), F.size("a").alias("n"), F.size("b").alias("m")).first()
    assert row.c == 1.0 and row.m > 0 and 250 < row.n < 500
