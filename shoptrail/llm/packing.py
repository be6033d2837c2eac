"""Best-fit packing by patterns: the histogram of piece lengths is fitted by repeats of few-document patterns that fill a
sequence exactly, by non-negative least squares; what rounding leaves is packed best-fit, longest first.

Only the histogram (one count per length) comes to the driver. Pieces get their place by their rank among those of their
length; ranks are counted in buckets and then added up, so a length that a third of all pieces has is not one task's.

Defined cases: a null text is an empty one, which still has its end id; equal doc_ids are packed as separate documents;
a null doc_id is kept; an empty table packs nothing. A document longer than a sequence is cut into full pieces and, first,
the rest.
"""
from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import ship, stage
from .tokens import encoder, portions

CAPACITY = 1024
END = 2
SHARE = 0.8          # of the fitted repeats is used, so that the residuals keep short pieces that go with long ones
BUCKETS = 64         # buckets in which the ranks of a length are counted, at least
BUCKET_ROWS = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    rest = n % capacity if n > capacity else n
    full = range(rest, n, capacity)
    return ([(0, rest)] if rest else []) + [(at, capacity) for at in full]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents (doc_id, text), as PIECES."""
    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stop = encoder(path, True), end.to_bytes(4, "little")
        for part in (batch.slice(a, z - a) for batch in batches for a, z in portions(batch.column(1))):
            out = []
            found, many = coder.batch(part.column(1))
            for doc_id, own in zip(part.column(0).to_pylist(), np.split(found, np.cumsum(many)[:-1])):
                ids = memoryview(own.tobytes() + stop)
                out += [(doc_id, i, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]))
                        for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(tokenized, PIECES)


def patterns(counts: np.ndarray) -> np.ndarray:
    """All pairs and triples of lengths that occur and fill a sequence, longest first; rows of three, 0 for none."""
    c = len(counts) - 1
    a, b = np.meshgrid(np.arange(1, c), np.arange(0, c), indexing="ij")
    a, b = a.ravel(), b.ravel()
    third = c - a - b
    keep = (a >= b) & (b >= third) & (third >= 0) & (b > 0)
    rows = np.column_stack((a, b, third))[keep]
    there = counts > 0
    there[0] = True
    return rows[there[rows].all(axis=1)]


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 of the patterns whose pieces come closest to counts, by accelerated projected gradient. Errors weigh
    as the length does: long pieces that are left over are the ones that waste room."""
    size, most = len(counts), max(counts.max(), 1)
    weight = np.arange(size) / (size - 1)

    def error(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(rows[:, k], x, size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(50):  # the largest eigenvalue, for the step
        v = back(error(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(rows))
    t, goal = 1.0, weight * counts / most
    for _ in range(rounds):
        z = np.maximum(y - back(error(y) - goal) / (1.1 * bound), 0)
        if np.sum((y - z) * (z - x)) > 0:  # it overshoots: without momentum again
            t = 1.0
        t, s = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = z, z + (s - 1) / t * (z - x)
    return x * most


def best_fit(left: np.ndarray) -> Counter:
    """Packs counts of lengths, longest first, each where least room remains; sequences of equal content are one entry."""
    capacity = len(left) - 1
    room: dict[int, Counter] = defaultdict(Counter)  # room left -> contents -> number
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        for gap in range(n, capacity):
            while todo and room[gap]:
                content, k = room[gap].popitem()
                took = min(k, todo)
                if k > took:
                    room[gap][content] = k - took
                room[gap - n][(*content, n)] += took
                todo -= took
        per = capacity // n
        if todo // per:
            room[capacity - per * n][(n,) * per] += todo // per
        if todo % per:
            room[capacity - todo % per * n][(n,) * (todo % per)] += 1
    done: Counter = Counter()
    for contents in room.values():
        done.update(contents)
    return done


def plan(counts: np.ndarray) -> Counter:
    """Contents of sequences (lengths) and how many of each, which hold counts[n] pieces of length n."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    out: Counter = Counter()
    if left[capacity]:
        out[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    rows = patterns(left)
    if len(rows):
        x = SHARE * fit(rows, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            need = Counter(int(n) for n in rows[i] if n)
            k = min(int(x[i] + 0.5), *(int(left[n]) // m for n, m in need.items()))
            if k > 0:
                out[tuple(int(n) for n in rows[i] if n)] += k
                for n, m in need.items():
                    left[n] -= k * m
    out.update(best_fit(left))
    return out


def ranked(rows: DataFrame, keys: list[Column], buckets: int) -> DataFrame:
    """rows with rank: their place, from 0, among the rows of equal length, in any fixed order."""
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    own = W.partitionBy("length", "_bucket")
    sizes = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (spread.withColumn("_in", F.row_number().over(own.orderBy(*keys)))
            .join(offsets, ["length", "_bucket"])
            .withColumn("rank", F.col("_before") + F.col("_in") - 1).drop("_bucket", "_in", "_before"))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (a written table of PIECES) with sequence_id and offset."""
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row per length
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (number of pieces, first sequence, offset)
    made = 0
    for content, repeats in plan(counts).items():
        at = 0
        for n in content:
            slots[n].append((repeats, made, at))
            at += n
        made += repeats
    table = {n: (np.cumsum([0] + [s[0] for s in own]), np.array([s[1] for s in own]), np.array([s[2] for s in own]))
             for n, own in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                start, first, at = table[int(n)]
                slot = np.searchsorted(start, rank[mine], "right") - 1
                sequence[mine] = first[slot] + rank[mine] - start[slot]
                offset[mine] = at[slot]
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    buckets = max(BUCKETS, int(counts.sum()) // BUCKET_ROWS)
    places = ranked(rows, [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], buckets)
    names = [c for c, _ in rows.dtypes]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return places.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str) -> DataFrame:
    return pack(stage(pieces(docs, path), "pieces"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the packed pieces of the documents that are left."""
    ship(spark)
    return packed(docs, tokenizer_path())
