"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of templates are
hash-joined with those of the benchmark, and what stands in the placeholders must be consistent, so that a question whose
figures or names were exchanged throughout is found as well as a literal copy.

Tokens are numbers (with decimals) and runs of letters; letters are lower-cased unless their case is mixed. In the strict
reading a name is a capitalised token that does not begin a sentence; as sentences lose and gain a beginning where they are
pasted, and may begin with a name, windows are also hashed in the free readings: of an item each capitalised token at the
start of a sentence that is none of OPENERS, of a document each capitalised token is a name as well as a word. A unit is one of UNITS behind a
number. A window is WINDOW tokens (a shorter item is one window of its own length). If over half of them are placeholders,
the window matches with the same values only. Windows on one diagonal (place in the
document less place in the item) are consistent if the values of each placeholder type map one to one. A document is
contaminated by an item if consistent windows cover SHARE of the item's, or RUN of them stand on one diagonal. A pair that
the strict reading finds has its figures, others those of all readings.

The benchmark's words and window hashes go to all tasks as a filter if there are at most FILTER of each; beyond that all
windows of the documents go into the join, with the same result.

The work of a window grows with the readings it has, one more for each capitalised token in it (at most WINDOW); a very long text is
taken whole, in arrays of its tokens.

Defined cases: null and empty texts, and items without a window, match nothing; rows of equal doc_id and text are one
document; equal item_ids are one item, of whose texts each is judged alone (the figures are those of the one
covered best); empty tables give an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import ship, stage

WINDOW, SHARE, RUN = 8, 0.5, 6
FILTER = 1 << 20
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")

#: Units of measure.
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz gram grams kilogram
kilograms pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h
hr hour hours day days week weeks month months year years mph kmh hz khz mhz ghz v volt volts w watt watts kw kwh j joule
joules n newton newtons pa bar k c f degree degrees percent usd eur dollar dollars euro euros cent cents""".split())

#: Words that begin a sentence and are no names.
OPENERS = frozenset("""a an the this that these those there here it its he she they we you i his her their our your my what which
who whom whose when where why how if is are was were do does did can could would should has have had in on at by for from to
of with without and or but not no yes all each every some any both either neither one two three four five six seven eight
nine ten after before during while since because then so given let suppose assume consider find compute calculate solve
determine show prove explain describe write choose select name list identify complete answer question""".split())

NUMBER, TITLE, END = 1, 2, 3  # places in a vocabulary; 0 is an unknown word
NUMBER_HASH, NAME_HASH, UNIT_HASH = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<name>", "<unit>"))
STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)
LITERAL = xxhash.xxh64_intdigest(b"<literal>") >> 8
WINDOWS = "doc long, text_hash long, pos int, hash long, slots array<string>, strict boolean"


@dataclass
class Vocabulary:
    """Places of the words (in the cases in which they may stand) and, by place, hash, capital and unit."""
    place: dict[str, int]
    hashes: np.ndarray
    title: np.ndarray
    unit: np.ndarray


def vocabulary(words: set[str]) -> Vocabulary:
    """Of plain (lower-case, or mixed-case) words."""
    place = {".": END, "!": END, "?": END, "\n": END}
    hashes, title, unit = [0, 0, 0, 0], [False, False, True, False], [False] * 4  # TITLE is the one capital among these
    for word in sorted(words | UNITS):  # a unit counts as one, whether the benchmark has it or not
        h = xxhash.xxh64_intdigest(word.encode()) or 1
        for form in dict.fromkeys((word, word.title(), word.upper())) if word == word.lower() else (word,):
            if plain(form) == word and form not in place:
                place[form] = len(hashes)
                hashes.append(h)
                title.append(capital(form))
                unit.append(word in UNITS)
    return Vocabulary(place, np.array(hashes, np.uint64), np.array(title), np.array(unit))


def capital(token: str) -> bool:
    return token[0].isupper() and (len(token) == 1 or token[1:].islower())


def plain(token: str) -> str:
    """The token in lower case, or as it stands if its case is mixed."""
    return token.lower() if token.islower() or token.isupper() or capital(token) else token


def other(token: str) -> int:
    """The place of a token that is no word of the vocabulary."""
    return NUMBER if token[0].isdigit() else TITLE if capital(token) else 0


def words(text: str | None) -> set[str]:
    return {plain(t) for t in TOKEN.findall(text or "") if t[0].isalpha()}


@dataclass
class Tokens:
    """A text without sentence ends, as arrays over its tokens."""
    tokens: list[str]
    free: np.ndarray     # hashes with every capitalised token read as a name, 0 for an unknown word
    word: np.ndarray     # of capitalised tokens that may also be a plain word its hash, else 0
    first: np.ndarray    # whether a capitalised token begins a sentence, where the strict reading takes it for a word
    kind: np.ndarray     # '#', '@' or '~' for placeholders of the free reading, else ''


def template(text: str, known: Vocabulary, anywhere: bool) -> Tokens:
    """anywhere: a capitalised token may be a plain word wherever it stands, not at the start of a sentence alone."""
    tokens = TOKEN.findall(text)
    get = known.place.get
    # most unknown words begin with a small letter, and are neither number nor name
    at = np.array([get(t) or (0 if "a" <= t[0] <= "z" else other(t)) for t in tokens], np.int32)
    end = at == END
    begins = np.concatenate((np.ones(1, bool), end[:-1]))
    keep = np.flatnonzero(~end)
    at, begins = at[keep], begins[keep]
    number, name = at == NUMBER, known.title[at].copy()
    first = name & begins
    if not anywhere:  # of an item; in a document either reading is open
        name &= ~(begins & np.array([tokens[i].lower() in OPENERS for i in keep.tolist()], bool))
    unit = known.unit[at] & np.concatenate((np.zeros(1, bool), number[:-1]))[:len(at)] & ~name
    h = known.hashes[at].copy()
    word = np.where(name & (begins | anywhere), h, np.uint64(0))
    h[name], h[unit], h[number] = NAME_HASH, UNIT_HASH, NUMBER_HASH
    kind = np.where(number, "#", np.where(name, "@", np.where(unit, "~", "")))
    return Tokens([tokens[i] for i in keep.tolist()], h, word, first & name, kind)


def windows(text: str | None, known: Vocabulary, sizes: list[int], wanted: np.ndarray | None,
            anywhere: bool = False) -> Iterator[tuple[int, int, list[str], bool]]:
    """(place, hash, values of the placeholders, whether this is the strict reading) of the windows of the sizes, in each of
    their readings; of those in sorted `wanted` only, if given."""
    t = template(text or "", known, anywhere)
    slot = t.kind != ""
    gaps, slots = (np.concatenate(([0], np.cumsum(x))) for x in (t.free == 0, slot))
    literal = None

    def those(at: np.ndarray, total: np.ndarray) -> np.ndarray:
        if wanted is None:
            return np.ones(len(at), bool)
        near = np.searchsorted(wanted, total)
        near[near == len(wanted)] = 0
        return wanted[near] == total if len(wanted) else np.zeros(len(total), bool)

    for n in sizes:
        m = len(t.free) - n + 1
        if m <= 0:
            continue
        good = np.flatnonzero(gaps[n:] == gaps[:m])
        if not len(good):
            continue
        total, strict = np.full(len(good), n, np.uint64), np.zeros(len(good), np.int32)
        for k in range(n):
            total += t.free[good + k] * STEPS[k]
            strict |= t.first[good + k].astype(np.int32) << k
        heavy = good[2 * (slots[good + n] - slots[good]) > n]
        at, left, turned = good, slots[good + n] - slots[good], np.zeros(len(good), np.int32)
        for k in range(n):  # each reading once more with this token as a word
            i = np.flatnonzero(t.word[at + k])
            if len(i):
                more = total[i] + (t.word[at[i] + k] - NAME_HASH) * STEPS[k]
                at, total, strict = np.concatenate((at, at[i])), np.concatenate((total, more)), np.concatenate((strict, strict[i]))
                left, turned = np.concatenate((left, left[i] - 1)), np.concatenate((turned, turned[i] | np.int32(1 << k)))
        light = np.flatnonzero(2 * left <= n)
        light = light[those(at[light], total[light])]
        for i, w, x, plain_ in zip(at[light].tolist(), total[light].view(np.int64).tolist(), turned[light].tolist(), (turned == strict)[light].tolist()):
            yield i, w, [t.kind[j] + t.tokens[j] for j in range(i, i + n) if slot[j] and not x >> (j - i) & 1], plain_
        # mainly placeholders, or figures alone: these match with the same values only
        if len(heavy):
            if literal is None:
                literal = t.free.copy()
                for j in np.flatnonzero(slot).tolist():
                    literal[j] = xxhash.xxh64_intdigest((plain(t.tokens[j]) if t.kind[j] == "@" else t.kind[j] + t.tokens[j]).encode())
            total = np.full(len(heavy), LITERAL + n, np.uint64)
            for k in range(n):
                total += literal[heavy + k] * STEPS[k]
            found = those(heavy, total)
            for i, w in zip(heavy[found].tolist(), total[found].view(np.int64).tolist()):
                yield i, w, [], False


def window_rows(docs: DataFrame, key: str, sizes: list[int], known: Vocabulary | None = None, wanted: np.ndarray | None = None,
                anywhere: bool = False) -> DataFrame:
    """Windows of docs (key, text), as WINDOWS."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "text_hash", "pos", "hash", "slots", "strict"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                own = known or vocabulary(words(text))
                for w in windows(text, own, sizes, wanted, anywhere):
                    out.append((doc, text_hash, *w))
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    return docs.select(F.col(key).alias("doc"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, WINDOWS)


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, item_text, item_pos, hash, item_slots, item_strict, n_strict, n_free), written, and the window sizes that occur."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(t not in ".!?\n" for t in TOKEN.findall(x or "")) for x in batch.column("text").to_pylist()]
            yield batch.append_column("n", pa.array([min(k, WINDOW) for k in n], pa.int32()))
    sized = stage(items.select("item_id", "text").mapInArrow(lengths, "item_id long, text string, n int"), "items")
    sizes = [r.n for r in sized.filter("n > 0").select("n").distinct().collect()]  # WINDOW at most
    made = None
    for n in sizes:
        own = window_rows(sized.filter(F.col("n") == n), "item_id", [n])
        made = own if made is None else made.union(own)
    if made is None:
        made = window_rows(sized, "item_id", [])
    # rows of one item_id may differ in their texts; each text is judged by its own places
    rows = made.select(F.col("doc").alias("item_id"), F.col("text_hash").alias("item_text"), F.col("pos").alias("item_pos"), "hash",
                       F.col("slots").alias("item_slots"), F.col("strict").alias("item_strict")).distinct()
    rows = stage(rows, "windows")
    count = rows.groupBy("item_id", "item_text").agg(F.count_distinct(F.when(F.col("item_strict"), F.col("item_pos"))).alias("n_strict"),
                                                     F.count_distinct("item_pos").alias("n_free"))
    same = rows.item_id.eqNullSafe(count.item_id) & (rows.item_text == count.item_text)
    return rows.join(count, same).select(rows["*"], "n_strict", "n_free"), sizes


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of documents and items: doc_id, text_hash, item_id, matched and n_windows, coverage, longest (windows on one
    diagonal), literal (whether all placeholders hold the item's own values)."""
    bench, sizes = benchmark_windows(items)
    hashes = bench.select("hash").distinct().limit(FILTER + 1)
    wanted = np.sort(hashes.toArrow().column(0).to_numpy().view(np.uint64))
    known = None
    if len(wanted) > FILTER:
        wanted = None
    else:
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"word": [w for t in batch.column(0).to_pylist() for w in words(t)]}, schema=pa.schema([("word", pa.string())]))
        found = items.select("text").mapInArrow(split, "word string").distinct().limit(FILTER + 1).toArrow().column(0).to_pylist()
        known = vocabulary(set(found)) if len(found) <= FILTER else None
    hits = window_rows(docs, "doc_id", sizes, known, wanted, True).join(bench, "hash")
    pairs = F.arrays_zip(F.col("slots").alias("own"), F.col("item_slots").alias("its"))
    layers = F.when(F.col("strict") & F.col("item_strict"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    item = ["doc", "text_hash", "item_id", "item_text", "layer", "n_windows"]
    diagonal = (hits.withColumn("pairs", pairs).withColumn("layer", F.explode(layers))
                .withColumn("n_windows", F.when(F.col("layer") == 0, F.col("n_strict")).otherwise(F.col("n_free")))
                .groupBy(*item, (F.col("pos") - F.col("item_pos")).alias("diagonal"))
                .agg(F.collect_set("item_pos").alias("seen"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")))
    n = F.size("pairs")
    consistent = diagonal.filter((F.size(F.array_distinct("pairs.own")) == n) & (F.size(F.array_distinct("pairs.its")) == n))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).cast("long")
    found = (consistent.groupBy(*item).agg(
        covered.alias("matched"), F.max(F.size("seen")).cast("long").alias("longest"),
        F.max(F.forall("pairs", lambda p: p.own == p.its)).alias("literal"))
             .withColumn("coverage", F.col("matched") / F.col("n_windows"))
             .filter((F.col("coverage") >= SHARE) | (F.col("longest") >= RUN)))
    figures = ["matched", "n_windows", "coverage", "longest", "literal"]
    best = F.max_by(F.struct(*figures), F.struct(-F.col("layer"), "coverage", "longest", "matched", "literal", "item_text")).alias("best")
    return (found.groupBy("doc", "text_hash", "item_id").agg(best)
            .select(F.col("doc").alias("doc_id"), "text_hash", "item_id", *(f"best.{c}" for c in figures)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated documents with the items they hold."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).select(
        "doc_id", "item_id", "matched", "n_windows", "coverage", "longest", "literal").distinct()


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    ship(spark)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stage(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["_id"]) & (F.xxhash64(docs.text) == bad["_hash"]), "left_anti")
