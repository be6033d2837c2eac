"""Phrase collocations by SETM: relations of occurrences, joined by adjacent position, counted by group, and cut down to the
frequent groups before the next length.

A relation holds the occurrences of each document in order of piece and position, so that the merge join with the next position
is a walk along the row. R1 has the frequent words, R2 the frequent pairs; both are written as runs of neighbouring words, without the
occurrences that no longer phrase can use. Each length joins the relation with itself at the next position and
counts the groups by the numbers of their words. A word's number is a hash of its lang and itself, tried on all words until none that
share one are frequent, even together, so that these counts are exact and the words can be looked up afterwards. A task adds up
what it has before it sends it. The semi-join with the frequent groups runs by a filter of a fixed number of bits, which
may let rare groups pass but loses none; what passed in vain is removed by its count.

Scores are compared as whole numbers of up to 38 digits, which hold counts below 10^14.

Defined cases: a null text is an empty one, a null lang is `und`; other white space than space and tab does not part words,
but line ends (0A to 0D) end pieces; repeated rows count as often as they come; an empty table gives an empty one. Very
long texts are taken whole, one at a time. doc_id and other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import forget, stage, tidy

ENDS = b".,;:!?\n\x0b\x0c\r"   # bytes that end a piece
BITS = 1 << 26                 # bits of the filter of frequent groups
HELD = 1 << 23                 # bytes of texts that a task joins at once
GROUPS = 3 << 20               # groups that a task adds up before it sends them
TRIES = 16                     # numberings of the words that are tried
TABLE = bytes(10 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbering(NamedTuple):
    """Numbers words by the first `wide` bits of their hashes."""
    salt: str
    wide: int

    def hashes(self, lang: str, words: list[str]) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang, xxhash.xxh64_intdigest(self.salt, 42))
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.wide)

    def hash_column(self) -> Column:
        """hashes() of the columns lang and w1."""
        return F.xxhash64(F.lit(self.salt), F.col("lang"), F.col("w1"))

    def column(self) -> Column:
        return F.shiftrightunsigned(self.hash_column(), 64 - self.wide)


class Rows:
    """The occurrences of some rows: code of each word, its place in the vocabulary, and the rows' ends. `\\n` ends a run."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(lists.flatten())
        self.words, codes = pa.concat_arrays([coded.dictionary, pa.array(["\n"])]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = self.words.to_pylist()
        real = ~np.isin(codes, [i for i, w in enumerate(names) if w == ""])
        offsets = lists.offsets.to_numpy()
        before = np.concatenate(([0], np.cumsum(real)))
        self.codes, self.offsets, self.stop = codes[real], before[offsets - offsets[0]], len(names) - 1
        self.inside = self.codes != names.index("\n")
        self.joins = np.zeros(len(self.codes), bool)      # whether the next word stands beside this one
        self.joins[:-1] = self.inside[:-1] & self.inside[1:]
        self.joins[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = False

    def groups(self, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The groups of k neighbours, 2 or 3: codes of their first, second, ... words, and how often each group occurs. This is
        the join of a relation with itself at the next position."""
        v, codes = len(self.words), self.codes
        i = np.flatnonzero(self.joins if k == 2 else self.joins[:-1] & self.joins[1:])
        two = codes[i] * v + codes[i + 1]
        if k == 2:
            two, n = np.unique(two, return_counts=True)
            return [two // v, two % v], n
        if v ** 3 < 1 << 63:
            three, n = np.unique(two * v + codes[i + 2], return_counts=True)
            two = three // v
        else:
            pairs, at = np.unique(two, return_inverse=True)
            three, n = np.unique(at * v + codes[i + 2], return_counts=True)
            two = pairs[three // v]
        return [two // v, two % v, three % v], n

    def runs(self, joins: np.ndarray, least: int) -> pa.Array:
        """The runs of neighbours of each row that have `least` joins or more, as one text."""
        ends = np.flatnonzero(~joins)
        sizes = np.diff(np.concatenate(([-1], ends)))
        kept = np.repeat(sizes > least, sizes)
        at = np.flatnonzero(kept)
        last = ~joins[at]
        out = np.empty(len(at) + int(last.sum()), np.int64)
        place = np.arange(len(at)) + np.cumsum(last) - last
        out[place], out[place[last] + 1] = self.codes[at], self.stop
        before = np.concatenate(([0], np.cumsum(kept.astype(np.int64) + (kept & ~joins))))
        lists = pa.ListArray.from_arrays(pa.array(before[self.offsets].astype(np.int32)), self.words.take(pa.array(out)))
        return pc.binary_join(lists, " ")


def joined(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hash of a group from that of its first words and that of its last one."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (then + np.uint64(0x632BE59BD9B4E019))
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)) & np.uint64(BITS - 1)


def frequent_filter(groups: DataFrame) -> np.ndarray:
    """BITS bits in which those of the hashes (column h) are set."""
    made = (groups.select((F.expr(f"shiftright(h, 20) & {BITS - 1}") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("part")))
    out = np.zeros(BITS // 8, np.uint8)
    for row in made.collect():  # BITS / 32768 rows of 4 KB at most
        out[(row["at"] - 1) * 4096:row["at"] * 4096] = np.frombuffer(row["part"], np.uint8)
    return out


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bits(hashes)
    return (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-case words between spaces, and `\\n` between pieces."""
    made = [(t.as_py() or "").encode().translate(TABLE).replace(b"\n", b" \n ") for t in texts]
    return pa.array(made, pa.binary()).cast(pa.string())


def by_lang(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each lang, as many as make about `held` bytes at once."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def take() -> Iterator[tuple[str, pa.Table]]:
        table = pa.Table.from_batches(waiting)
        for lang in pc.unique(table["lang"]).to_pylist():
            yield lang, table.filter(pc.equal(table["lang"], lang)).combine_chunks()
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= held:
            yield from take()
            waiting, size = [], 0
    if waiting:
        yield from take()


def chunk(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of numbers, and n as the last, of several parts as one; equal numbers are added up. Groups whose hashes are equal may
    stay in more than one row."""
    *numbers, n = [np.concatenate(c) for c in zip(*parts)]
    if len(parts) == 1 or not len(n):
        return [*numbers, n]
    order = np.argsort(group_hash(numbers))
    numbers, n = [x[order] for x in numbers], n[order]
    at = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in numbers], axis=0))))
    return [*(x[at] for x in numbers), np.add.reduceat(n, at)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, n) of every word."""
    held, most = HELD, GROUPS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = {}
        for lang, table in by_lang(batches, held):
            rows = Rows(normalised(chunk(table["text"])))
            n = np.bincount(rows.codes[rows.inside], minlength=len(rows.words))
            for w, m in zip(rows.words.to_pylist(), n.tolist()):
                if m:
                    sums[lang, w] = sums.get((lang, w), 0) + m
            if len(sums) > most // 4:
                yield from sent(sums, 1)
                sums = {}
        yield from sent(sums, 1)
    return docs.mapInArrow(count, "lang string, w1 string, n long").groupBy("lang", "w1").agg(F.sum("n").alias("n"))


def sent(sums: dict[tuple, int], k: int) -> Iterator[pa.RecordBatch]:
    keys, n = list(sums), list(sums.values())
    for at in range(0, len(keys), 50_000):
        columns = list(zip(*keys[at:at + 50_000]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(n[at:at + 50_000], pa.int64())],
                                         names=["lang", *(f"w{i + 1}" for i in range(k)), "n"])


def numbering(words: DataFrame, least: int) -> Numbering:
    """A numbering of words (lang, w1, n) in which no words that occur at least `least` times, together, share a number."""
    wide = min(62, max(32, 2 * words.count().bit_length() + 6))
    for salt in map(str, range(TRIES)):
        made = Numbering(salt, wide)
        shared = words.groupBy(made.column().alias("i")).agg(F.count("*").alias("words"), F.sum("n").alias("n"))
        if not shared.filter((F.col("words") > 1) & (F.col("n") >= least)).count():
            return made
        wide = min(62, wide + 4)
    raise ArithmeticError(f"frequent words share their hashes of {wide} bits with others, {TRIES} times")


def relation(rows: DataFrame, k: int, filter_, numbered: Numbering) -> DataFrame:
    """Rk: (lang, words), the runs of the rows' occurrences in which every group of k words passes the filter and that are
    longer than k. rows: documents (lang, text) for k = 1, else the relation before."""
    held = HELD

    def semi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, table in by_lang(batches, held):
            texts = chunk(table.column(1))
            own = Rows(normalised(texts) if k == 1 else texts)
            h = numbered.hashes(lang, own.words.to_pylist())
            if k == 1:
                good = passes(filter_.value, h)[own.codes]
                joins = own.joins & good & np.concatenate((good[1:], [False]))
            else:
                joins = own.joins.copy()
                i, number = np.flatnonzero(joins), numbered.numbers(h)
                joins[i] = passes(filter_.value, joined(number[own.codes[i]], number[own.codes[i + 1]]))
            made = own.runs(joins, k)
            out = pa.Table.from_arrays([table.column(0), made], names=["lang", "words"])
            yield from out.filter(pc.not_equal(made, "")).combine_chunks().to_batches(max_chunksize=1000)
    return rows.mapInArrow(semi, "lang string, words string")


def group_hash(numbers: list[np.ndarray]) -> np.ndarray:
    """The hashes of groups of two words or more from the words' numbers."""
    h = numbers[0]
    for then in numbers[1:]:
        h = joined(h, then)
    return h


def tally(rows: DataFrame, k: int, least: int, numbered: Numbering) -> DataFrame:
    """(i1, ..., ik, n): the groups of k neighbours that the relation has at least `least` times, by the numbers of their words."""
    held, most, key = HELD, GROUPS, [f"i{j + 1}" for j in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[list[np.ndarray]]] = {}
        size = 0
        for lang, table in by_lang(batches, held):
            own = Rows(chunk(table["words"]))
            codes, n = own.groups(k)
            number = numbered.numbers(numbered.hashes(lang, own.words.to_pylist()))
            parts.setdefault(lang, []).append([*(number[c] for c in codes), n])
            size += len(n)
            if size > most:
                parts = {x: [added(p)] for x, p in parts.items()}
                size = sum(len(p[0][-1]) for p in parts.values())
                if 4 * size > 3 * most:
                    yield from numbers_sent(parts)
                    parts, size = {}, 0
        yield from numbers_sent(parts)

    def numbers_sent(parts: dict[str, list[list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang in parts:
            columns = added(parts[lang])
            for at in range(0, len(columns[-1]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 100_000].astype(np.int64)) for x in columns], names=[*key, "n"])
    return (rows.mapInArrow(count, ", ".join(f"{x} long" for x in [*key, "n"])).groupBy(*key).agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least))


def pair_hashes(pairs: DataFrame) -> DataFrame:
    """The hashes (column h) of pairs (i1, i2)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = joined(*(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
    return pairs.select("i1", "i2").mapInArrow(of, "h long")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first `top` phrases. A phrase inside a longer one that has `share`
    percent of its occurrences, or more, is left out."""
    spark = docs.sparkSession
    often = F.col("n") >= least
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def keep(groups: DataFrame):
        bits_ = spark.sparkContext.broadcast(frequent_filter(groups))
        tidy(spark)
        return bits_

    all_words = stage(word_counts(texts), "words")
    numbered = numbering(all_words, least)
    totals = all_words.groupBy("lang").agg(F.sum("n").alias("total"))
    c1 = stage(all_words.filter(often).withColumn("i", numbered.column()), "c1")
    r1 = stage(relation(texts, 1, keep(c1.select(numbered.hash_column().alias("h"))), numbered), "r1")
    c2 = stage(tally(r1, 2, least, numbered), "c2")
    r2 = stage(relation(r1, 2, keep(pair_hashes(c2)), numbered), "r2")
    forget(r1)
    c3 = stage(tally(r2, 3, least, numbered), "c3")
    forget(r2)
    tidy(spark)

    # a number that is not in c1 is shared by rare words
    one = lambda i, w, n, *more: c1.select(F.col("i").alias(i), F.col("w1").alias(w), F.col("n").alias(n), *more)
    two = lambda a, b, n: c2.select(F.col("i1").alias(a), F.col("i2").alias(b), F.col("n").alias(n))
    inside = (c3.select("n", F.inline(F.array(F.struct(F.col("i1").alias("i1"), F.col("i2").alias("i2")),
                                              F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2")))))
              .groupBy("i1", "i2").agg(F.max("n").alias("longer")))
    pair = (c2.join(inside, ["i1", "i2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
            .join(one("i1", "w1", "l", "lang"), "i1").join(one("i2", "w2", "r"), "i2")
            .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r"))
    triple = (c3.join(two("i2", "i3", "r1"), ["i2", "i3"]).join(two("i1", "i2", "l2"), ["i1", "i2"])
              .join(one("i1", "w1", "l1", "lang"), "i1")
              .join(one("i2", "w2", "n2"), "i2").join(one("i3", "w3", "r2"), "i3")
              .withColumnRenamed("n", "a"))

    def score(a: str, left: str, right: str) -> Column:
        return F.expr(f"(CAST({a} AS DECIMAL(14, 0)) * CAST({a} AS DECIMAL(14, 0)) * CAST(1000000 AS DECIMAL(7, 0))) "
                      f"DIV (CAST({left} AS DECIMAL(14, 0)) * CAST({right} AS DECIMAL(14, 0)))")
    first = score("a", "l1", "r1") <= score("a", "l2", "r2")
    triple = triple.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                           F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"))
    scored = pair.unionByName(triple).withColumn("score", score("a", "l", "r"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents
), row AS (SELECT lang, list_filter(string_split_regex(t, '[ \x09]+'), lambda x: x <> '') AS w FROM piece),
word AS (SELECT lang, unnest(w) AS phrase FROM row),
c1 AS (SELECT lang, phrase, count(*) AS n FROM word GROUP BY ALL),
two AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM row WHERE len(w) > 1),
three AS (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM row WHERE len(w) > 2),
c2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS a FROM two GROUP BY ALL HAVING count(*) >= 10),
c3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS a FROM three GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, w1, w2, max(a) AS longer FROM
  (SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL),
cut AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, a, 1 AS k, x.n AS l, y.n AS r
  FROM c2 LEFT JOIN inside USING (lang, w1, w2) JOIN c1 x USING (lang) JOIN c1 y USING (lang)
  WHERE x.phrase = w1 AND y.phrase = w2 AND (longer IS NULL OR 100 * longer < 50 * a)
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.a, 1, x.n, y.a FROM c3
  JOIN c1 x ON x.lang = c3.lang AND x.phrase = c3.w1 JOIN c2 y ON y.lang = c3.lang AND y.w1 = c3.w2 AND y.w2 = c3.w3
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.a, 2, x.a, y.n FROM c3
  JOIN c2 x ON x.lang = c3.lang AND x.w1 = c3.w1 AND x.w2 = c3.w2 JOIN c1 y ON y.lang = c3.lang AND y.phrase = c3.w3
), best AS (
  SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(n) AS total FROM c1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
