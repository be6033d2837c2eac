"""URL filters in time: dated list entries become validity intervals, and every capture is held against the entries that
were active when it was fetched. Column expressions only.

A list entry names a host or a domain; it holds for that host and all hosts below it. The most specific active entry is
reported. Defined cases: entries of one key and day count once, an add wins over a remove on the same day; a remove
without an add has no effect; an interval holds from its first day up to, without, its last; captures without a valid
URL or a day are never listed; repeated captures are repeated rows; an empty list lists nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """The host of a URL in lower case; '' where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def keys(host_: Column) -> Column:
    """The host and its parent domains down to two labels, as list keys."""
    labels = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_key, action 'add' or 'remove', day) to disjoint intervals: list_key, listed_from, listed_to (null: still listed).

    Entries are merged by key and day first, so a key has a row per day at most, however often it is reported."""
    days = (entries.filter("list_key IS NOT NULL AND day IS NOT NULL").groupBy("list_key", "day")
            .agg(F.max(F.col("action") == "add").alias("on")))
    key = W.partitionBy("list_key").orderBy("day")
    changes = days.withColumn("was", F.lag("on", 1, False).over(key)).filter("on <> was")
    return (changes.select("list_key", F.col("day").alias("listed_from"), F.lead("day").over(key).alias("listed_to"), "on")
            .filter("on").drop("on"))


def listed(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct (host, day) of captures that an interval covers: host, day, list_key, listed_from, listed_to.

    Both sides are cut into months: an interval stands in each month it touches, up to the last capture, and meets only
    the captures of that month, so a key and month has as many intervals as days at most."""
    seen = captures.filter("host <> '' AND day IS NOT NULL").select("host", "day").distinct()
    last = seen.agg(F.max("day")).first()[0]
    month = F.date_format("day", "yyyy-MM")
    asked = seen.select("host", "day", month.alias("month"), F.explode(keys(F.col("host"))).alias("list_key"))
    ends = F.least(F.coalesce(F.date_sub("listed_to", 1), F.lit(last)), F.lit(last))
    active = (spans.filter(F.col("listed_from") <= F.lit(last))
              .withColumn("month", F.explode(F.sequence(F.trunc("listed_from", "MM"), F.trunc(ends, "MM"), F.expr("INTERVAL 1 MONTH"))))
              .withColumn("month", F.date_format("month", "yyyy-MM")))
    inside = (F.col("day") >= F.col("listed_from")) & (F.col("listed_to").isNull() | (F.col("day") < F.col("listed_to")))
    best = F.max_by(F.struct("list_key", "listed_from", "listed_to"), F.length("list_key"))
    return (asked.join(active, ["list_key", "month"]).filter(inside).groupBy("host", "day").agg(best.alias("hit"))
            .select("host", "day", "hit.*"))


def flag(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (with url and day) plus host, blocked and the interval that blocks; all rows and columns are kept.

    The names host, blocked, list_key, listed_from and listed_to are the result's; such columns of captures are replaced."""
    rows = captures.drop("blocked", "list_key", "listed_from", "listed_to").withColumn("host", host(F.col("url")))
    return (rows.join(listed(rows, intervals(entries)), ["host", "day"], "left")
            .withColumn("blocked", F.col("list_key").isNotNull()))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a list that the pages themselves make.

    The tables have neither fetch times nor lists, so both are derived from every page: the day it was fetched, and one
    report on a later or earlier day that adds or removes its host (even ids) or its domain (odd ids)."""
    number = F.pmod("page_id", F.lit(366)).cast("int")
    day = lambda step, more: F.date_add(F.lit("2024-01-01").cast("date"), ((number * step + more) % 366).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", day(37, 0))
    at = host(F.col("url"))
    domain = F.element_at(keys(at), -1)
    entries = (pages.select(
        F.when(F.pmod("page_id", F.lit(2)) == 0, at).otherwise(domain).alias("list_key"),
        F.when(F.pmod("page_id", F.lit(5)) == 0, "add").otherwise("remove").alias("action"), day(53, 11).alias("day"))
        .filter("list_key <> ''"))
    return flag(captures, entries).select("page_id", "host", "day", "blocked", "list_key", "listed_from", "listed_to")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host,
    DATE '2024-01-01' + CAST((((page_id % 366) + 366) % 366 * 37) % 366 AS INTEGER) AS day,
    DATE '2024-01-01' + CAST((((page_id % 366) + 366) % 366 * 53 + 11) % 366 AS INTEGER) AS reported
  FROM pages
), e AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS list_key,
    reported, bool_or(page_id % 5 = 0) AS listed
  FROM p WHERE host <> '' AND reported IS NOT NULL GROUP BY ALL
), c AS (
  SELECT *, lag(listed, 1, false) OVER (PARTITION BY list_key ORDER BY reported) AS was FROM e
), i AS (
  SELECT list_key, listed, reported AS listed_from, lead(reported) OVER (PARTITION BY list_key ORDER BY reported) AS listed_to
  FROM c WHERE listed <> was
), h AS (
  SELECT q.host, q.day, arg_max(struct_pack(k := i.list_key, f := i.listed_from, t := i.listed_to), length(i.list_key)) AS hit
  FROM (SELECT DISTINCT host, day FROM p) q JOIN i
    ON i.listed AND (q.host = i.list_key OR q.host LIKE '%.' || i.list_key)
    AND q.day >= i.listed_from AND (i.listed_to IS NULL OR q.day < i.listed_to)
  GROUP BY ALL
)
SELECT page_id, p.host, p.day, hit IS NOT NULL AS blocked, hit.k AS list_key, hit.f AS listed_from, hit.t AS listed_to
FROM p LEFT JOIN h ON p.host = h.host AND p.day = h.day
"""
