"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is kept, so sketches
of documents of very unequal size compare (and merge) by plain set operations. Column expressions only.

Shingles are five words between ASCII white space, in ASCII lower case (fewer words: all of them as one); a shingle's hash
is XXH64 over the hashes of its words. A fingerprint is the sorted kept hashes in hex, 16 digits each.

Of a text none of whose hashes is below the bound (one of a few words), the least one is kept, so different texts have different
sketches; sketches still merge, and such a hash goes when another text brings one below the bound.

Defined cases: a null text is an empty one and, like one without words, has an empty sketch; two equal fingerprints
are alike by 1, an empty and another one by 0. A very long text is one row's array of word hashes, 8 bytes a word. Rows of equal doc_id are ordered by their text, null doc_ids come first; an
empty table gives an empty one. A single document is its own next one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

WORDS = 5
FRACTION = 8           # one hash in so many is kept
RANGES = 256           # ranges of doc_id per 64 shuffle partitions, at least


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sketch(text: Column, words: int = WORDS, fraction: int = FRACTION) -> Column:
    """Sorted distinct kept hashes of a text."""
    bound = F.lit(-(1 << 63) + (1 << 64) // fraction)
    hashes = F.transform(F.filter(F.split(lower(text), "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    starts = lambda h: F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))

    def shingles(h: Column) -> Column:
        full = F.transform(starts(h), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))
        return F.when(F.size(h) > 0, full).otherwise(F.array().cast("array<bigint>"))
    # once(h) binds the array of hashes, which would otherwise be computed for every use
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    # where no hash is below the bound the least one stands for the text
    few = lambda all_: once(F.filter(all_, lambda x: x < bound), lambda kept: F.when(
        (F.size(kept) > 0) | (F.size(all_) == 0), F.array_sort(F.array_distinct(kept))).otherwise(F.array(F.array_min(all_))))
    return once(hashes, lambda h: once(shingles(h), few))


def merged(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    bound = F.lit(-(1 << 63) + (1 << 64) // fraction)
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, lambda x: x < bound)
    return F.when((F.size(kept) > 0) | (F.size(both) == 0), kept).otherwise(F.slice(both, 1, 1))


def fingerprint(sketch_: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch_, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one has."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(shared / least)


def resemblance(a: Column, b: Column) -> Column:
    """Share of all hashes that both sketches have."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_next(docs: DataFrame) -> tuple[DataFrame, W]:
    """(doc_id, text) with range and guest, and the window in which the next row is that of the next document.

    Rows are cut into ranges of doc_id that begin at ids which occur; the first document of a range is also a guest at the
    end of the range before, so that no window goes over all rows."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    spark = docs.sparkSession
    ranges = RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 64)
    points = [i / ranges for i in range(ranges)]
    found = rows.agg(F.min("key"), F.percentile_approx("key", points, 100 * ranges)).first()
    bounds = sorted({*(found[1] or []), *([] if found[0] is None else [found[0]])})
    n = max(len(bounds), 1)
    if not bounds:
        own, begins = F.lit(0), F.lit(False)
    else:
        at = F.array(*map(F.lit, bounds))
        own = (F.size(F.filter(at, lambda b: b <= F.col("key"))) - 1)
        begins = F.array_contains(at, F.col("key"))
    here = F.struct(own.alias("range"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(own - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))
    places = F.when(begins, F.array(here, before)).otherwise(F.array(here))
    spread = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "key", "place.range", "place.guest")
    return spread, W.partitionBy("range").orderBy("guest", "key", "text")


def edited(text: Column, next_text: Column) -> Column:
    """text, its last floor(n/2) code points replaced by the first as many of the next one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    rows, order = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sketched = rows.withColumn("own", sketch(F.col("text")))
    texts = (sketched.withColumn("next_text", F.lead("text").over(order)).withColumn("next", F.lead("own").over(order))
             .filter("NOT guest").select("doc_id", "text", "own", "next", edited(F.col("text"), F.col("next_text")).alias("edited")))
    both = texts.withColumn("other", sketch(F.col("edited")))
    own, other, next_ = F.col("own"), F.col("other"), F.col("next")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
        containment(own, other).alias("near_edited"), containment(own, next_).alias("near_next"),
        resemblance(own, other).alias("resemblance_edited"), resemblance(own, next_).alias("resemblance_next"))
