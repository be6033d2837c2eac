"""Repeated passages by suffix order: every byte covered by a string of `length` bytes that starts anywhere else as well goes.

Cutting: of the hashes of all MER-byte strings in a window of `length` bytes the least is the window's key, so equal windows
have equal keys wherever they are. Neighbouring windows with one key make a span; a window belongs to exactly one span. Only
spans whose key occurs again can hold repeats. Equal spans are merged (by 128-bit digests) before any text moves: all
windows of a span that occurs twice are repeats, and one copy of it stands for any number when it meets the other spans of
its key.

Order: the different spans of a key, with those of other keys up to BATCH bytes, are put into one suffix array
(suffixes.py), which gives the windows that start at two places. A key with more than GROUP bytes of different spans (a
passage just short of `length` in very many surroundings) cannot be ordered in one task; there, the digests of single windows are dealt
out by their own value into parts of about GROUP bytes of text and compared, with the same result.

Documents are told apart by the digest of doc_id and text. Repeated rows are documents of equal text, so all of a repeated
row of `length` bytes or more goes.

Defined cases: a null text is an empty one; texts shorter than `length` lose nothing; a null doc_id is one like any other;
an empty table gives an empty one. A very long text is cut in parts of PART bytes, whose windows lap over; its spans and
repeats are gathered in one row, like the text itself. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import stage
from .suffixes import repeats

LENGTH = 400
MER = 32             # bytes whose hash can be a key
PART = 1 << 22       # windows of a text that are cut at once
BATCH = 1 << 20      # bytes of spans that are ordered at once
GROUP = 1 << 21      # bytes of different spans of one key that a task may order
TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mer_hashes(data: bytes) -> np.ndarray:
    """A hash of the MER bytes from every place on."""
    n = len(data) - MER + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for i, turn in enumerate(TURNS):
        h ^= eight[8 * i:8 * i + n] * turn
        h ^= h >> np.uint64(31)
        h *= TURNS[1]
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from running minima forwards and backwards over blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    table = padded.reshape(blocks, width)
    forth = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1:width - 1 + n])


def cut(data: bytes, length: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(start, windows, key, digest of the bytes, places with the key's hash) of each span."""
    for at in range(0, len(data) - length + 1, PART):
        part = data[at:at + PART + length - 1]
        h = mer_hashes(part)
        least = sliding_least(h, length - MER + 1)
        edges = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)])).tolist()
        keys = least[edges[:-1]].view(np.int64).tolist()
        for a, z, key in zip(edges, edges[1:], keys):
            places = int(np.count_nonzero(h[a:z + length - MER] == least[a]))
            yield at + a, z - a, key, xxhash.xxh3_128_digest(part[a:z + length - 1]), places


def identified(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text) with texts as bytes."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text)
    return docs.select(F.unhex(F.md5(name.cast("binary"))).alias("id"), "doc_id", text.cast("binary").alias("text"))


def spans(named: DataFrame, length: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(name, *x) for x in cut(text.as_py(), length)]
                if len(rows) > 50_000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "start", "windows", "key", "digest", "places"])
    return named.select("id", "text").mapInArrow(of, "id binary, start long, windows long, key long, digest binary, places long")


RUNS = "key long, digest binary, a long, z long"


def runs(rows: list[tuple[int, bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "digest", "a", "z"])


def ordered(texts: DataFrame, length: int) -> DataFrame:
    """Repeats among the spans (key, digest, text) of each key, by suffix order."""
    most = BATCH

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        size, last = 0, (None, None)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if row[:2] == last:      # a repeated row of the table brings its spans again
                    continue
                if size >= most and row[0] != last[0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[2]), row[:2]
        yield found(held)

    def found(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return runs([(held[i][0], held[i][1], a, z) for i, a, z in repeats([t for _, _, t in held], length)] if held else [])
    return texts.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(order, RUNS)


def compared(texts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many spans (key, digest, text, parts): windows are dealt out by their digests."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(text) - length + 1
                made = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i:i + length]) for i in range(n)), "<u8").reshape(n, 2)
                part = made[:, 0] % np.uint64(parts)
                rows = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int64()), pa.array([digest] * len(rows), pa.binary()),
                    pa.array([made[at].tobytes() for _, at in rows], pa.binary()), pa.array([at.astype("<i8").tobytes() for _, at in rows], pa.binary())],
                    names=["key", "part", "digest", "windows", "places"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if last is not None and row[:3] == last:
                    continue
                if last is not None and row[:2] != last[:2]:
                    yield twice(held)
                    held = []
                held.append(row)
                last = row[:3]
        yield twice(held)

    def twice(held: list[tuple]) -> pa.RecordBatch:
        if not held:
            return runs([])
        windows = np.frombuffer(b"".join(r[3] for r in held), "<u8").reshape(-1, 2)
        by = np.lexsort((windows[:, 1], windows[:, 0]))
        equal = np.flatnonzero((windows[by[1:]] == windows[by[:-1]]).all(axis=1))
        hit = np.zeros(len(by), bool)
        hit[by[equal]] = hit[by[equal + 1]] = True
        out, at = [], 0
        for key, _, digest, _, places in held:
            own = np.frombuffer(places, "<i8")
            own, at = own[hit[at:at + len(own)]], at + len(own)
            if len(own):
                breaks = np.flatnonzero(np.diff(own) > 1)
                out += [(key, digest, a, z + 1) for a, z in zip(own[np.concatenate(([0], breaks + 1))].tolist(), own[np.concatenate((breaks, [-1]))].tolist())]
        return runs(out)
    dealt = texts.mapInArrow(deal, "key long, part long, digest binary, windows binary, places binary")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "digest").mapInArrow(same, RUNS)


def repeated(named: DataFrame, length: int) -> DataFrame:
    """(id, spans): the repeats of each document, as an array of (start of a span, runs of windows in it)."""
    found = stage(spans(named, length), "spans")
    again = found.groupBy("key").agg(F.sum("places").alias("n")).filter("n > 1").select("key")
    found = stage(found.join(again, "key"), "spans-again")
    each = stage(found.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max("places").alias("places"),
                                                   F.min(F.struct("id", "start", "windows")).alias("first")), "spans-each")
    whole = each.filter("n > 1").select("key", "digest", F.lit(0).cast("long").alias("a"), F.col("first.windows").alias("z"))
    # a key whose spans are all whole repeats, or whose one span holds its hash once, leaves nothing to compare
    keys = (each.groupBy("key").agg(F.count("*").alias("spans"), F.count_if(F.col("n") == 1).alias("lone"), F.max("places").alias("places"),
                                    F.sum(F.col("first.windows") + length - 1).alias("bytes"))
            .filter("lone > 0 AND (spans > 1 OR places > 1)"))
    parts = F.when(F.col("bytes") > GROUP, F.ceil(F.col("bytes") / GROUP)).otherwise(F.lit(0))
    wanted = (each.join(keys.select("key", parts.alias("parts")), "key")
              .select("first.id", F.struct("key", "digest", "parts", F.col("first.start").alias("start"), F.col("first.windows").alias("windows")).alias("span"))
              .groupBy("id").agg(F.collect_list("span").alias("spans")))
    texts = stage(named.select("id", "text").join(wanted, "id").select("text", F.explode("spans").alias("s")).select(
        "s.key", "s.digest", F.expr(f"substring(text, CAST(s.start + 1 AS INT), CAST(s.windows + {length - 1} AS INT))").alias("text"),
        "s.parts"), "span-texts")
    marked = (whole.union(ordered(texts.filter("parts = 0").drop("parts"), length))
              .union(compared(texts.filter("parts > 0"), length)))
    # one row for each different span, so that the join gives one row for each span, however its repeats were found
    runs_ = marked.groupBy("key", "digest").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("runs"))
    runs_ = stage(runs_.select("key", "digest", F.expr(MERGED).alias("runs")), "repeats")
    return (found.join(runs_, ["key", "digest"]).groupBy("id").agg(F.collect_set(F.struct("start", "runs")).alias("spans")))


#: Sorted runs with those joined that meet.
MERGED = """aggregate(runs, cast(array() AS array<struct<a: bigint, z: bigint>>), (done, r) -> CASE
    WHEN size(done) > 0 AND r.a <= element_at(done, -1).z
    THEN concat(slice(done, 1, size(done) - 1), array(named_struct('a', element_at(done, -1).a, 'z', greatest(element_at(done, -1).z, r.z))))
    ELSE concat(done, array(r)) END)"""


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per document: doc_id, kept (the remaining bytes), n_bytes, n_removed, spans (lo, hi of each removed run)."""
    named = identified(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                data, parts, cuts, at = text.as_py(), [], [], 0
                ranges = [(s["start"] + r["a"], s["start"] + r["z"] + length - 1) for s in spans or [] for r in s["runs"]]
                for lo, hi in sorted(ranges):
                    if cuts and lo <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], hi)
                    else:
                        cuts.append([lo, hi])
                for lo, hi in cuts:
                    parts.append(data[at:lo])
                    at = hi
                kept.append(b"".join([*parts, data[at:]]))
                gone.append([{"lo": lo, "hi": hi} for lo, hi in cuts])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()),
                                              pa.array(gone, kind)], names=["doc_id", "kept", "n_bytes", "spans"])
    rows = named.join(repeated(named, length), "id", "left").select("doc_id", "text", "spans")
    made = rows.mapInArrow(keep, f"doc_id {dict(docs.dtypes)['doc_id']}, kept binary, n_bytes long, spans array<struct<lo: long, hi: long>>")
    return made.withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed passages of every document."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
