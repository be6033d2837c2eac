"""Secret scans: patterns of known forms, and values in credential contexts that would be hard to guess.

How hard a value is to guess is the least cost over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force spans, by dynamic programming; the cost is the sum of the base-10 logarithms of each part's guesses, and one
more for each further part. A context value of at least `hard` is a secret of kind 'guess', whose span is the value.

Words and their ranks come from the corpus itself (a count of the words of its prose, of which the LEXICON most frequent are
kept) beside a short list of frequent passwords, so that a plain word behind `auth:` is cheap whatever the language.

Base kinds: 'assign' (span of the whole match), 'access', 'hex'; ASCII letters only, in either case where said; matches
are leftmost and do not overlap within a kind, and those that fail the length test are dropped.

Defined cases: a null or empty text has no spans; repeated rows are repeated results; spans count code points. Values
are taken whole, however long: a start that costs no less than the whole value, or than ENOUGH, is not followed further.
What the bounds leave out: costs above ENOUGH are reported as ENOUGH and are secrets all the same; a brute-force span or walk over SPAN
characters costs more than ENOUGH (ten digits cost 10), so longer ones are never cheaper; units of repeats longer than UNIT
count by brute force once more for each repeat, which can only make a value harder. A name of a credential that begins more than LONGEST
characters before the end of another value, has more than eight parts behind its first word or parts of more than 64 letters is not seen as one.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .shared import ship

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Words before a value that say it is a credential, also as part of a longer name, and URLs with one.
NAME = (r"""(?:password|passwd|secret|token|api[_-]?key|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|credentials?|auth"""
        r"""|authorization|bearer|signature|private[_-]?key|access[_-]?key))(?:[_-][A-Za-z0-9]{1,64}+){0,8}+""")
VALUE = r"""(?:(?![&,;](?:[\s"']|$|[A-Za-z_][A-Za-z0-9_]*["']?[=:]))[^\s"'<>]){6,}"""  # up to the next name or the end of a clause
CONTEXT = re.compile(
    rf"""(?:{NAME}["']?\x20*[:=]\x20*(?:(?:bearer|basic|digest|token)\x20+)?|(?<![A-Za-z0-9])bearer\x20+)"""
    rf"""(?:"(?P<double>[^"\s]{{6,}})"|'(?P<single>[^'\s]{{6,}})'|["']?(?P<bare>{VALUE}))"""
    r"""|://[A-Za-z0-9._-]+:(?P<url>[^\s"'<>@,;]{6,})""", re.I | re.A)

#: Frequent words of passwords and credentials, most frequent first.
WORDS = """password the secret token admin user login pass key test qwerty welcome monkey dragon master hello love money
letmein sunshine princess football baseball shadow superman michael jordan summer winter spring autumn monday friday january
march april june july august october december root system server default change example sample private public access guest
office company computer internet windows apple google orange flower purple silver golden black white green house happy lucky
star angel tiger ninja killer soccer hockey charlie thomas robert daniel andrew jessica ashley nicole""".split()
RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
LEXICON = 50_000  # words of the corpus that are kept
#: A word of prose: small letters, perhaps with a capital, between spaces or before a mark, not behind a name's mark.
PROSE = re.compile(r"(?<![^\s(])(?<![:=]\s)[^\W\d_][^\W\d_A-Z]{2,23}(?=[\s.,;!?)])")
#: Rows of a keyboard, and letters that stand for others.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@431!0$5+7", "aaeiiosstt")
BESIDE = {(a, b) for row in ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
BESIDE |= {(a, b) for up, down in zip(ROWS, ROWS[1:]) for x, y in zip(up, down) for a, b in ((x, y), (y, x))}
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12][0-9]|3[01]))?)?"
                  r"|(?:0[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?[0-9]{2}")
MARK = re.compile(r"\[(?:ASSIGN|ACCESS|HEX|GUESS)\]")  # what redaction leaves
#: Values that are placeholders as a whole.
PLACEHOLDER = re.compile(r"\$?\{+[^{}]*\}+|%[A-Z0-9_]+%|<[^<>]*>|\*+|x+|\.+", re.I | re.A)
LONGEST = 80   # characters before the end of a value in which the name of another one may stand
HARD = 10.0    # ten thousand million guesses
ENOUGH = 30.0  # higher costs are not told apart
SPAN, UNIT = 64, 8  # characters of a brute-force span or a walk, and of a unit that repeats, at most


def _pool(c: str) -> float:
    """log10 of the characters a brute-force guess tries for one like c."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


class Ranks:
    """Costs of known words: log10 of the rank, in the list of passwords or among the words of the corpus, whichever is less."""

    def __init__(self, words: list[str]):
        self.cost = {w: math.log10(i + 2) for i, w in enumerate(words)}
        for w, cost in RANK.items():
            self.cost[w] = min(cost, self.cost.get(w, cost))
        self.longest = max(map(len, self.cost))
        self.guess = lru_cache(1 << 14)(lambda value: guess_cost(value, self))


def lexicon(docs: DataFrame, size: int = LEXICON) -> list[str]:
    """The most frequent words of the texts' prose, most frequent first; equal ones by their letters."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(w.lower() for w in PROSE.findall(t.as_py() or ""))
            if len(seen) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
                seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
    found = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.filter("n > 1").orderBy(F.desc("n"), "word").limit(size).collect()]


def guess_cost(value: str, ranks: Ranks | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs, or ENOUGH if that is less; 0 for an empty one."""
    known, most_word = (ranks or PASSWORDS).cost, (ranks or PASSWORDS).longest
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    brute, ends = [0.0], list(range(1, n + 1))  # cost of all characters so far; where a keyboard walk from here ends
    for c in value:
        brute.append(brute[-1] + _pool(c))
    for a in range(n - 2, -1, -1):
        if (low[a], low[a + 1]) in BESIDE:
            ends[a] = ends[a + 1]
    repeats = {}  # unit -> how often the unit from here on stands in a row
    for unit in range(1, min(UNIT, n // 2) + 1):
        times = repeats[unit] = [1] * (n + 1)
        for a in range(n - 2 * unit, -1, -1):
            if value[a:a + unit] == value[a + unit:a + 2 * unit]:
                times[a] = times[a + unit] + 1

    def offer(a: int, b: int, cost: float) -> None:
        best[b] = min(best[b], best[a] + cost + (1.0 if a else 0.0))  # ten times as many guesses for a further part

    for a in range(n):
        if best[a] >= min(best[n], ENOUGH):  # costs only grow: no cheaper way leads through here
            continue
        for b in range(a + 1, min(n, a + SPAN) + 1):  # brute force
            offer(a, b, brute[b] - brute[a] + 0.3)
        for size in range(3, min(most_word, n - a) + 1):  # words, with capitals or letters exchanged
            word = low[a:a + size]
            cost = known.get(word)
            if cost is None and plain[a:a + size] in known:
                cost = known[plain[a:a + size]] + 0.6
            if cost is not None:
                offer(a, a + size, cost + (0.3 if word != value[a:a + size] else 0))
        if m := DATE.match(value, a):
            offer(a, m.end(), math.log10(365 * 120) if m.end() - a > 4 else math.log10(120))
        turns, last = 0, None  # keyboard walks
        for b in range(a + 2, min(ends[a], a + SPAN) + 1):
            step = ord(low[b - 1]) > ord(low[b - 2])
            turns, last = turns + (last is not None and step != last), step
            if b - a >= 3:
                offer(a, b, math.log10(48 * (b - a)) + 0.6 * turns)
        for unit, times in repeats.items():  # repeats of a short unit
            if times[a] > 1:
                offer(a, a + unit * times[a], brute[a + unit] - brute[a] + math.log10(times[a]) + 0.3)
    return min(best[n], ENOUGH)


PASSWORDS = Ranks([])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of whole values in credential contexts that are no placeholders."""
    if "=" not in text and ":" not in text and "earer" not in text and "EARER" not in text:
        return
    at = 0
    while m := CONTEXT.search(text, at):
        value, start, end = m[m.lastgroup], m.start(m.lastgroup), m.end(m.lastgroup)
        if not PLACEHOLDER.fullmatch(value):
            yield start, end
        at = max(start, end - LONGEST) if value[-1] in ":=" else end  # it may be the name of a credential itself


def guess_spans(text: str, hard: float = HARD, ranks: Ranks = PASSWORDS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in credential contexts that need at least 10 ** hard guesses."""
    out: list[tuple[int, int, int]] = []
    for start, end in values(text):
        if (not out or start >= out[-1][2]) and ranks.guess(MARK.sub("", text[start:end])) >= hard:
            out.append((start, 3, end))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(text: Column, words: list[str] = ()) -> Column:
    """base and spans of a text: comma-joined kind:start:end, ordered by start and kind; and the cost of the hardest value. words:
    frequent ones, most frequent first."""
    words = list(words)

    @pandas_udf("base string, spans string, hardest double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks = Ranks(words)
        for part in parts:
            rows = []
            for t in part:
                t = t or ""
                base = base_spans(t)
                costs = [ranks.guess(ASSIGN.match(t, a)[2]) for a, kind, _ in base if kind == 0]
                rows.append((written(base), written(base + guess_spans(t, ranks=ranks)), max(costs, default=None)))
            yield pd.DataFrame(rows, columns=["base", "spans", "hardest"])
    return of(text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = (docs.select("doc_id", scan(F.col("text"), lexicon(docs)).alias("s"))
             .select("doc_id", "s.base", "s.spans", "s.hardest"))
    count = lambda kind: F.regexp_count("base", F.lit(kind + ":")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2("base", 256).alias("base_sha256"), "spans",
                        F.col("hardest").alias("hardest_assigned"))


def redact(text: Column, words: list[str] = ()) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the union is replaced."""
    words = list(words)

    @pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = Ranks(words)
        for part in parts:
            yield pd.Series([None if t is None else redacted(t, ranks) for t in part], dtype=object)
    return of(text)


def redacted(text: str, ranks: Ranks = PASSWORDS) -> str:
    out, at, upto = [], 0, -1
    whole = {}  # where the value that a base span cuts short ends
    for start, end in values(text):
        whole[start] = end
    base = [(a, kind, max(b, whole.get(ASSIGN.match(text, a).start(2), b) if kind == 0 else b)) for a, kind, b in base_spans(text)]
    for start, kind, end in sorted(base + guess_spans(text, ranks=ranks)):
        if start >= upto:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = upto = max(upto, end)
    return "".join([*out, text[at:]])


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are taken out of the texts, n_chars follows; no document goes."""
    ship(spark)
    out = docs.withColumn("text", redact(docs["text"], lexicon(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
