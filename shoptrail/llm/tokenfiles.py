"""Token files compressed by a grammar (Re-Pair): frequent pairs of neighbouring symbols become one new symbol, again and
again, for each shard. A shard's file holds the rules, the length each expands to, and the symbols that are left, so that
any stretch of ids can be decoded without the rest.

Format of a shard, little-endian: head (magic 'RPG1', documents, rules, symbols, first rule's symbol, place of the first id
within the part: int64 each but the magic), doc_ids int64, null flags uint8, tokens per document int64, rules uint16 pairs,
expansion lengths uint32, symbols uint16, crc32 uint32 of all before. Ids below the first rule's symbol are themselves; rule
k is symbol first + k, and refers to smaller symbols only.

Method: each round counts neighbouring pairs, takes those that are at least 1/SPREAD as frequent as the most frequent one,
most frequent first, and replaces them from left to right. Rounds follow until no symbol is free or no pair pays for its
rule: a rule takes RULE bytes and saves a symbol of two bytes at each occurrence. Once a round has taken all that pay, the next one
looks only at pairs with a new symbol and at those that paid and were left: no other pair has become more frequent.

Defined cases: a null text is an empty one, with its end id; null doc_ids come first; rows of equal doc_id are ordered by
their text; a document longer than a shard has a shard of its own; no rows, no files.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .files import put
from .shared import folder, stage
from .tokens import encoder, gathered

MAGIC = b"RPG1"
END = 1
IDS = 49408            # ids of the vocabulary; the rest of 16 bits is for rules
SHARD = 1 << 20        # ids after which a shard is closed
RULE = 8               # bytes of a rule and its length
LEAST = RULE // 2 + 1  # occurrences from which a pair pays
SPREAD = 128           # how much rarer than the most frequent pair those may be that are taken in the same round
HEAD = struct.Struct("<4s5q")


class Broken(ValueError):
    """A file that does not keep the format."""


def apart(at: np.ndarray) -> np.ndarray:
    """Of places of pairs, sorted, those that do not overlap; of overlapping ones the left one."""
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
    return place & 1 == 0


def paying(at: np.ndarray, pair: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """at and pair of the replacements: places of pairs, sorted, and their numbers below n. Pairs that overlap with others so often
    that fewer than `least` places are left to them are given up for this round."""
    take = np.flatnonzero(apart(at))
    at, pair = at[take], pair[take]
    good = np.flatnonzero((np.bincount(pair, minlength=n) >= least)[pair])
    return at[good], pair[good]


def grammar(ids: np.ndarray, first: int = IDS, least: int = LEAST, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols) of ids: rules is a table of pairs, symbols what is left. rounds: None for as many as there are."""
    x, rules, done = ids.astype(np.int32), np.empty((0, 2), np.int32), 0
    look = None  # places of the pairs to look at, None for all
    while done != rounds:
        done += 1
        room = (1 << 16) - first - len(rules)
        if len(x) < 2 or room <= 0:
            break
        left, right = (x[:-1], x[1:]) if look is None else (x[look], x[look + 1])
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.intp)
        counts = np.bincount(slot, minlength=1 << 20)
        bound = max(least, int(counts.max()) // SPREAD)
        often = np.flatnonzero((counts >= bound)[slot])  # no pair is more frequent than its slot
        key, slot = key[often], slot[often]
        often = often if look is None else look[often]
        keys, counts = np.unique(key, return_counts=True)
        good = counts >= max(least, int(counts.max(initial=0)) // SPREAD)
        keys, counts = keys[good], counts[good]
        if not len(keys):
            break
        keys = keys[np.argsort(-counts, kind="stable")[:room]]
        number = np.zeros(1 << 20, np.int32)  # of two keys in one slot the other one waits for the next round
        number[(keys * np.uint32(0x9E3779B1)) >> np.uint32(12)] = np.arange(len(keys))
        found = number[slot]
        hit = np.flatnonzero(keys[found] == key)
        at, pair = paying(often[hit], found[hit], len(keys), least)
        if not len(at):
            break
        there = np.bincount(pair, minlength=len(keys)) > 0
        used, pair = np.flatnonzero(there), (np.cumsum(there) - 1)[pair]
        kept = np.ones(len(x), bool)
        kept[at + 1] = False
        x[at] = first + len(rules) + pair
        if bound == least:  # all pairs that may pay are in `often`
            place = np.cumsum(kept) - 1
            new, old = place[at], place[often[kept[often] & kept[often + 1]]]
            hot = np.zeros(int(place[-1]) + 2, bool)
            hot[new], hot[new - 1], hot[old] = True, True, True
            hot[-2:] = False  # the last symbol has no neighbour; the place before the first one is the last
            look = np.flatnonzero(hot)
        x = x[np.flatnonzero(kept)]
        rules = np.concatenate((rules, np.column_stack((keys[used] >> np.uint32(16), keys[used] & np.uint32(0xFFFF))).astype(np.int32)))
    return rules, x


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): what the rules expand to, one after the other."""
    parts: list[bytes] = []
    for pair in rules.tolist():
        a, b = (parts[s - first] if s >= first else s.to_bytes(4, "little") for s in pair)
        parts.append(a + b)
    return np.cumsum([0] + [len(p) // 4 for p in parts]), np.frombuffer(b"".join(parts), "<u4")


def spans(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, "<u4")


class Shard:
    """A shard's file: expand(start, stop) gives ids without decoding the others."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or data[:4] != MAGIC:
            raise Broken("no shard")
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise Broken("checksum")
        _, docs, rules, symbols, self.first, self.base = HEAD.unpack_from(data)
        if len(data) != HEAD.size + 17 * docs + 8 * rules + 2 * symbols + 4:
            raise Broken("length")
        at = HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.tokens = part("<i8", docs), part("u1", docs), part("<i8", docs)
        self.rules = part("<u2", 2 * rules).reshape(-1, 2)
        self.spans, self.symbols = part("<u4", rules), part("<u2", symbols)
        offsets, texts = expansions(self.rules, self.first)
        if not np.array_equal(np.diff(offsets), self.spans):
            raise Broken("expansion lengths")
        self.table = np.concatenate((np.arange(self.first, dtype=np.uint32), texts))
        self.places = np.concatenate((np.arange(self.first), self.first + offsets))
        width = np.concatenate((np.ones(self.first, np.int64), self.spans))[self.symbols]
        self.ends = np.cumsum(width)
        self.starts = np.concatenate(([0], np.cumsum(self.tokens)))
        if self.starts[-1] != (self.ends[-1] if symbols else 0):
            raise Broken("number of ids")

    def expand(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to, without, stop."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        symbols = self.symbols[a:b].astype(np.int64)
        begin, ends = int(self.ends[a - 1]) if a else 0, self.ends[a:b]
        width = np.diff(ends, prepend=begin)
        # what a symbol expands to stands in one table: ids are themselves, rules follow them
        ids = self.table[np.repeat(self.places[symbols] - ends + width, width) + np.arange(begin, int(ends[-1]))]
        return ids[start - begin:stop - begin]


def shard_bytes(doc_ids: list[int | None], tokens: list[int], ids: np.ndarray, base: int, first: int = IDS) -> bytes:
    rules, symbols = grammar(ids, first)
    parts = [HEAD.pack(MAGIC, len(doc_ids), len(rules), len(symbols), first, base),
             np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
             np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(tokens, "<i8").tobytes(),
             rules.astype("<u2").tobytes(), spans(rules, first).tobytes(), symbols.astype("<u2").tobytes()]
    data = b"".join(parts)
    return data + zlib.crc32(data).to_bytes(4, "little")


def write_shards(docs: DataFrame, into: str, path: str, parts: int, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order into the folder. One row per shard: file, part, ids."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, base = TaskContext.get(), 0, 0
        part, coder = task.partitionId(), encoder(path, False)
        doc_ids: list[int | None] = []
        tokens: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:05d}-{made:05d}-{task.taskAttemptId()}.rpg"
            put(into, name, shard_bytes(doc_ids, tokens, np.concatenate(held), base))
            return pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "ids": [sum(tokens)]})

        for batch in gathered(batches):
            ids, many = coder.batch(batch.column(1))
            stops = np.cumsum(many)
            ids = np.insert(ids, stops, end)
            stops += np.arange(1, len(many) + 1)
            for doc_id, n, stop in zip(batch.column(0).to_pylist(), (many + 1).tolist(), stops.tolist()):
                doc_ids.append(doc_id)
                tokens.append(n)
                held.append(ids[stop - n:stop])
                size += n
                if size >= SHARD:
                    yield close()
                    base, made, doc_ids, tokens, held, size = base + size, made + 1, [], [], [], 0
        if doc_ids:
            yield close()

    ordered = (docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))))
    return stage(ordered.mapInArrow(write, "file string, part int, ids long"), "shards")


def read_shards(shards: DataFrame, into: str) -> DataFrame:
    """One row per document of the listed shards: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    spark = shards.sparkSession
    if shards.isEmpty():
        return spark.createDataFrame([], schema).drop("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                ids = shard.expand(0, int(shard.starts[-1])).astype("<u4")
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.nulls.astype(bool)), pa.array(shard.base + shard.starts[:-1]),
                     pa.array(shard.tokens), pa.array(crc, pa.int64()), pa.array([name] * len(crc))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    # a row per part, of which there are as many as the writer had tasks
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    bases = shards.join(before, "part").select("file", "before")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpg").load(into)
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(shards, "file", "left_semi")
    rows = listed.select("file", "content").mapInArrow(read, schema)
    return rows.join(bases, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    into = folder(spark, "tokens")
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_shards(write_shards(docs, into, public_tokenizers.path("word_bpe_49k.json"), parts), into)
