"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints: ASCII lower case, words between ASCII white space, shingles of k words with repeats joined by a space (fewer
words: all of them as one shingle), XXH64 with seed 42 of each; a bit of the fingerprint is 1 if it is set in over half
of the hashes.

Join: the distinct fingerprints are the leaves of a binary trie. Its top levels are cut into units, one for each prefix (a
longer one where a unit would hold too many); the unit of work is a pair of prefixes that differ in few enough bits, and
holds the fingerprints of these two alone. There the trie is traversed in pairs of nodes: each pair has the differing bits
of its common depth, and is dropped as soon as they exceed the error budget. Two nodes whose leaves are known to be connected need not be compared either, so
a large group of copies does not cost its square; what a unit returns is a spanning forest of its links. Components are
then joined over all units by star contraction.

The pipeline's stage asks for a Jaccard of SIMILAR on sets of shingles, which is about ten bits of a fingerprint with a wide
spread, too many for the trie alone. Texts may be alike if their fingerprints are within the budget (the trie join), or if
they share one of BANDS keys of MINS least hashes and their least hashes agree often enough; each of these gives a forest of links,
whose components are clusters. A cluster's texts are brought together once, in blocks of BLOCK, and there the sets are compared as
they are: only a Jaccard of SIMILAR or more links two texts. No step makes a row per pair.

Defined cases: null or blank texts have fingerprint zero and link like any other; repeated rows are copies; a null doc_id
belongs to a component but cannot name it (unless it has no other); an empty table gives an empty one. A very long text
is hashed BLOCK_HASHES shingles at a time; its set of hashes must fit a task. Other columns stay, whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .shared import forget, ship, stage, tidy

BLOCK_HASHES = 1 << 16  # shingles whose bits are counted at once
TOP = 6          # levels of the trie above the units
UNIT = 1 << 18   # fingerprints that a unit's own part should hold on average
DEEPER = 6       # levels by which a unit that holds more than UNIT may be split further
CHUNK = 1 << 17  # pairs of nodes that are taken on at once

SIMILAR = 0.8          # Jaccard of the shingle sets from which two texts are near copies in the pipeline
BANDS, MINS = 24, 6    # keys of a text, and least hashes in each: a pair of 0.8 shares a key in 0.9993 of all cases
AGREE = 0.66           # share of equal least hashes from which texts may be alike: 4 standard deviations below SIMILAR
BLOCK = 1024           # texts of a cluster, or of a key, that are compared at once with as many others
TURNS = np.array([xxhash.xxh64_intdigest(b"turn", i) | 1 for i in range(BANDS * MINS)], np.uint64)
SHIFTS = np.array([xxhash.xxh64_intdigest(b"shift", i) for i in range(BANDS * MINS)], np.uint64)


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text, BLOCK_HASHES at a time."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - k + 1)
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[min(k, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK_HASHES):
        yield np.array([digest(line[a:b], 42) for a, b in zip(starts[at:at + BLOCK_HASHES], stops[at:at + BLOCK_HASHES])], "<u8")


def fingerprint(text: str | None, k: int) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, k)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sets of shingles; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bands(text: str | None, k: int) -> tuple[list[int], bytes]:
    """BANDS signed keys, each of MINS least hashes, and a byte of each least hash; texts without words share a single key."""
    shingles = shingle_set(text, k)
    if not len(shingles):
        return [0], bytes(len(TURNS))
    least = np.full(len(TURNS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[None, at:at + 4096] * TURNS[:, None] + SHIFTS[:, None]).min(axis=1))
    parts = least.reshape(BANDS, MINS)
    keys = np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64).tolist()
    return keys, (least * TURNS[0] >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", k: int = 4, name: str = "fp") -> DataFrame:
    """docs with a column of signed 64-bit fingerprints of whole texts."""
    @pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint(t, k) for t in part], np.uint64).view(np.int64))
    return docs.withColumn(name, of(docs[text]))


class Trie:
    """A binary trie over sorted distinct fingerprints without its one-way branches; a node covers leaves lo to hi."""

    def __init__(self, keys: np.ndarray):
        lo, hi = np.zeros(1, np.int64), np.array([len(keys)], np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        made, done = 1, 0
        while len(lo):
            inner = hi - lo > 1
            differ = keys[lo] ^ keys[hi - 1]
            # the bits all leaves of the node share; frexp finds the highest differing bit of each half exactly
            high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
            depth = np.where(inner, np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]), 64)
            d = depth[inner].astype(np.uint64)
            bit = np.uint64(1) << (np.uint64(63) - d)
            cut = np.searchsorted(keys, (keys[lo[inner]] & ~(bit - np.uint64(1))) | bit)
            left, right = np.full(len(lo), -1), np.full(len(lo), -1)
            n = int(inner.sum())
            left[inner], right[inner] = made + 2 * np.arange(n), made + 2 * np.arange(n) + 1
            made += 2 * n
            parts.append((lo, hi, depth, left, right))
            lo, hi = np.column_stack((lo[inner], cut)).ravel(), np.column_stack((cut, hi[inner])).ravel()
            done += 1
        self.lo, self.hi, depth, self.left, self.right = (np.concatenate(x).astype(np.int32) for x in zip(*parts))
        self.depth = depth.astype(np.uint8)
        self.key = keys[self.lo]

    def marks(self, label: np.ndarray) -> np.ndarray:
        """For each node the common label of its leaves, or -1."""
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        return np.where(change[self.lo] == change[self.hi - 1], label[self.lo], -1)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label: for each node the smallest node it is known to be connected with; returns it with the links a-b added."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def near_forest(keys: np.ndarray, home: np.ndarray, budget: int, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (key, root) without roots, of the links of at most `budget` bits between sorted distinct keys;
    links between two keys that are not marked home are left out. Across: only links between the two halves that the
    keys' first differing bit makes."""
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return keys[:0], keys[:0]
    trie = Trie(keys)
    count = np.concatenate(([0], np.cumsum(home)))
    homes = count[trie.hi] > count[trie.lo]
    marks = trie.marks(label)
    common = np.array([(1 << 64) - (1 << (64 - d)) for d in range(65)], np.uint64)  # the first d bits
    zero = np.zeros(1, np.int32)
    todo: list[tuple[np.ndarray, np.ndarray]] = [(trie.left[:1], trie.right[:1]) if across else (zero, zero)]
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    waiting = 0

    while todo:
        i, j = todo.pop()
        depth = np.minimum(trie.depth[i], trie.depth[j])
        go = np.bitwise_count((trie.key[i] ^ trie.key[j]) & common[depth]) <= budget
        i, j = i[go], j[go]
        go = (homes[i] | homes[j]) & ((marks[i] < 0) | (marks[i] != marks[j]))
        i, j = i[go], j[go]
        leaves = (trie.left[i] < 0) & (trie.left[j] < 0)
        if leaves.any():
            a, b = trie.lo[i[leaves]], trie.lo[j[leaves]]
            found_a.append(a)
            found_b.append(b)
            waiting += len(a)
            i, j = i[~leaves], j[~leaves]
        if waiting > max(n, CHUNK):
            label = merge(label, np.concatenate(found_a), np.concatenate(found_b))
            marks, found_a, found_b, waiting = trie.marks(label), [], [], 0
        if len(i):
            own = i == j
            s = i[own]
            i, j = i[~own], j[~own]
            swap = (trie.depth[i] > trie.depth[j]) | (trie.left[i] < 0)   # split the node that ends higher up
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            nexts = (np.concatenate((trie.left[i], trie.right[i], trie.left[s])), np.concatenate((j, j, trie.right[s])))
            inner = s[:0]
            for child in (trie.left[s], trie.right[s]):
                inner = np.concatenate((inner, child[trie.left[child] >= 0]))
            for at in range(0, len(nexts[0]), CHUNK):
                todo.append((nexts[0][at:at + CHUNK], nexts[1][at:at + CHUNK]))
            if len(inner):  # on top: the nearest pairs first, so that groups are known early
                todo.append((inner, inner))
    if found_a:
        label = merge(label, np.concatenate(found_a), np.concatenate(found_b))
    linked = np.flatnonzero(label != np.arange(n))
    return keys[linked], keys[label[linked]]


def prefixes(distinct: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, depths) of the units: all prefixes of `top` bits that occur, split further, by DEEPER levels at most, as long
    as they hold more than UNIT fingerprints."""
    deep = max(top, min(top + DEEPER, 20))
    found = distinct.groupBy(F.shiftrightunsigned("fp", 64 - deep).alias("p")).count().toArrow()
    at, n = found.column("p").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(at)
    at, sums = at[order], np.concatenate(([0], np.cumsum(n[order])))
    out: list[tuple[int, int]] = []
    todo = [(p, top) for p in np.unique(at >> (deep - top)).tolist()]
    while todo:
        p, d = todo.pop()
        lo, hi = np.searchsorted(at, [p << (deep - d), (p + 1) << (deep - d)])
        held = sums[hi] - sums[lo]
        if held > UNIT and d < deep:
            todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        elif held:
            out.append((p << (64 - d), d))
    out.sort()
    return np.array([p for p, _ in out], np.uint64), np.array([d for _, d in out], np.int64)


def unit_pairs(distinct: DataFrame, budget: int, starts: np.ndarray, depths: np.ndarray) -> DataFrame:
    """(fp, low, high): each fingerprint once for each pair of its own unit and one that differs in few enough bits."""
    common = np.array([(1 << 64) - (1 << (64 - d)) for d in range(65)], np.uint64)  # the first d bits

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        for batch in batches:
            fp = np.sort(batch.column(0).to_numpy().view(np.uint64))
            own = np.searchsorted(starts, fp, "right") - 1
            for u in np.unique(own).tolist():
                if u not in near:
                    mask = common[np.minimum(depths, depths[u])]
                    near[u] = np.flatnonzero(np.bitwise_count((starts ^ starts[u]) & mask) <= budget)
            if len(fp):
                other = np.concatenate([near[u] for u in own.tolist()])
                times = np.array([len(near[u]) for u in own.tolist()])
                own = np.repeat(own, times)
                parts = (np.repeat(fp.view(np.int64), times), np.minimum(own, other), np.maximum(own, other))
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["fp", "low", "high"])
    return distinct.select("fp").mapInArrow(spread, "fp long, low long, high long")


def links(distinct: DataFrame, budget: int, rows: int, top: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints (column fp) within `budget` bits of each other."""
    top = top if top is not None else max(TOP, math.ceil(math.log2(max(rows, 2) / UNIT)))
    starts, depths = prefixes(distinct, top)

    def join(key, rows):
        fp = np.sort(rows.column("fp").to_numpy().view(np.uint64))
        low, high = (k.as_py() for k in key)
        if low != high and (fp[-1] < starts[high] or fp[0] >= starts[high]):  # one of the two units alone
            fp = fp[:0]
        a, b = near_forest(fp, np.ones(len(fp), bool), budget, low != high)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})
    return unit_pairs(distinct, budget, starts, depths).groupBy("low", "high").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b); root is the smallest node reachable. Alternates large and small stars,
    each round a written table, until nothing changes."""
    def around(df: DataFrame) -> DataFrame:
        return df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(df.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(df: DataFrame, larger: bool) -> DataFrame:
        both = around(df) if larger else df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(low, "u").filter("v > u" if larger else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger:
            moved = moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = digest(now)
    while True:
        now = stage(star(star(now, True), False), "stars")
        if (got := digest(now)) == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def group_roots(own: DataFrame, budget: int) -> DataFrame:
    """(fp, root) for the fingerprints of own; equal roots are one component."""
    distinct = stage(own.select("fp").distinct(), "distinct")
    roots = components(links(distinct, budget, distinct.count()))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, k: int = 4, budget: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id of its component)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = stage(fingerprints(rows, "text", k).select("doc_id", "fp"), "fingerprints")
    named = own.groupBy("fp").agg(F.min("doc_id").alias("leader")).join(group_roots(own, budget), "fp")
    names = named.groupBy("root").agg(F.min("leader").alias("component_id"))
    return own.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group; batches are sorted by their first `keys` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def forest(nodes: list[int], near) -> Iterator[tuple[int, int]]:
    """(node, first node of its component) without the first ones; near(i, rest) tells which of the rest are linked with i."""
    rest = np.arange(len(nodes))
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        todo = [first]
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            for i in rest[hit].tolist():
                yield nodes[i], nodes[first]
                todo.append(i)
            rest = rest[~hit]


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def in_pairs_of_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows with low and high: a row for each pair of blocks of its group, which are as many as BLOCK rows a block ask for."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1")
    dealt = (rows.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "own", "other")


def agreeing(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect the texts of each key (key, node, sketch) whose least hashes agree often enough."""
    enough = AGREE

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in groups_of(batches, 3):
            sketches = np.frombuffer(b"".join(r[4] for r in group), np.uint8).reshape(len(group), -1)
            edges += forest([r[3] for r in group], lambda i, rest: (sketches[rest] == sketches[i]).mean(axis=1) >= enough)
            if len(edges) > 10_000:
                yield edge_batch(edges)
                edges = []
        yield edge_batch(edges)
    columns = ["key", "low", "high", "node"]
    return (in_pairs_of_blocks(members, "key").select(*columns, "sketch").repartition("key", "low", "high")
            .sortWithinPartitions(*columns).mapInArrow(link, "a long, b long"))


def alike(texts: DataFrame, k: int, similar: float) -> DataFrame:
    """Links (a, b) that connect the texts of each cluster (cluster, node, text) whose sets have a Jaccard of `similar`."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            group = [r for i, r in enumerate(group) if not i or r[3] != group[i - 1][3]]   # repeated rows
            sets = [shingle_set(r[4], k) for r in group]
            sizes = np.array([len(x) for x in sets])
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                has = np.zeros(len(names) + 1, bool)
                has[flat[starts[i]:starts[i] + sizes[i]]] = True
                sums = np.concatenate(([0], np.cumsum(has[flat])))
                both = sums[starts[rest] + sizes[rest]] - sums[starts[rest]]
                either = sizes[i] + sizes[rest] - both
                return np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similar
            yield edge_batch(list(forest([r[3] for r in group], near)))
    columns = ["cluster", "low", "high", "node"]
    return (in_pairs_of_blocks(texts, "cluster").select(*columns, "text").repartition("cluster", "low", "high")
            .sortWithinPartitions(*columns).mapInArrow(link, "a long, b long"))


def unused(name: str, columns: list[str]) -> str:
    """A column name like this one that the table does not have."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, k: int = 5, budget: int = 4, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each component of texts whose sets of k-word shingles have a Jaccard of `similar` at least: that
    with the smallest doc_id (a null one counts as largest). Links of up to `budget` bits and shared keys are candidates."""
    @pandas_udf("keys array<long>, sketch binary, fp long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            both = [bands(t, k) for t in part]
            yield pd.DataFrame({"keys": [x for x, _ in both], "sketch": [y for _, y in both],
                                "fp": np.array([fingerprint(t, k) for t in part], np.uint64).view(np.int64)})
    spark, digest = docs.sparkSession, unused("text_digest", docs.columns)
    named = docs.withColumn(digest, F.unhex(F.md5(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))).cast("binary"))))
    own = stage(named.select("doc_id", F.col(digest).alias("digest"), of("text").alias("s")), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    nodes = stage(own.groupBy("digest").agg(F.first("s").alias("s"), F.min(order).alias("first"))
                  .select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "s.*"), "nodes")

    keys = nodes.select("node", F.explode("keys").alias("key"))
    again = keys.groupBy("key").count().filter("count > 1").select("key")
    shared = stage(keys.join(again, "key"), "shared")
    tidy(spark)
    # sketches travel only with the keys that texts share
    members = shared.join(nodes.select("node", "sketch"), "node").select("key", "node", "sketch")
    fps = nodes.groupBy("fp").agg(F.min("node").alias("leader"))
    same_fp = nodes.join(fps, "fp").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    distinct = stage(fps, "distinct")
    name = lambda c, to: distinct.select(F.col("fp").alias(c), F.col("leader").alias(to))
    by_trie = (links(distinct.select("fp"), budget, distinct.count()).withColumnsRenamed({"a": "fa", "b": "fb"})
               .join(name("fa", "a"), "fa").join(name("fb", "b"), "fb").select("a", "b"))
    near = stage(agreeing(members).union(same_fp).union(by_trie), "candidates")
    tidy(spark)
    found = components(near)
    tidy(spark)
    clusters = stage(found.select("node", F.col("root").alias("cluster")).join(nodes.select("node", "digest", "doc_id"), "node"), "clusters")

    # one key for text and doc_id deals copies out by their doc_id, and the rows that stay need no further exchange
    key = lambda text_, id_: F.unhex(F.md5(F.concat(F.hex(text_), F.lit(" "), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")))
    row = unused("row_key", docs.columns)
    keyed = named.withColumn(row, key(F.col(digest), F.col("doc_id")))
    places = clusters.select(key(F.col("digest"), F.col("doc_id")).alias("place"), "cluster", "node")
    wanted = keyed.select(F.col(row).alias("key"), F.col("text").alias("body"))
    once = stage(wanted.join(places, wanted.key == places.place).select("cluster", "node", F.col("body").alias("text")), "cluster-texts")
    tidy(spark)
    near = stage(alike(once, k, similar), "links")
    forget(once)
    tidy(spark)
    roots = components(near)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    stays = (nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("first"))
             .select(key(F.col("first.digest"), F.col("first.doc_id")).alias("stays")))
    stays = stage(stays, "stays")
    tidy(spark)
    return keyed.join(stays, keyed[row] == stays.stays, "left_semi").dropDuplicates([row]).drop(row, digest)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays."""
    ship(spark)
    return one_of_each(docs)
