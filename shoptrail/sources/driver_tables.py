"""Adapter: the generic star-schema test tables, re-read as a nested event export.

Only mapping, no analysis. The result goes through the same flatten jobs as a real export.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..contract import CALENDAR, TRADING_WINDOWS

FIRST_DAY = dt.date(2024, 1, 1)
ONSET = dt.date(2024, 1, 5)
INCIDENT = (dt.date(2024, 1, 15), dt.date(2024, 1, 21))
# Users that appear as new visitors again from this day on (their cookie was cleared), and the users concerned.
CLEARED, CLEARED_USERS = dt.date(2024, 1, 22), "user_id % 7 = 3"
# Minutes after midnight that still belong to the session of the day before.
LATE = 30
# Users whose device is never reported, the k of purchases that all carry one order ID, the k of page views that carry one
# parameter key twice.
NO_DEVICE, SHARED_ORDER, REPEATED_KEY = "user_id % 97 = 5", 20, 13

# event_type, event_name, k from, k to, seconds after the source event
EXPANSION = (
    ("view", "page_view", 0, 99, 0), ("view", "view_item", 0, 99, 1),
    ("click", "page_view", 0, 99, 0), ("click", "view_search_results", 0, 29, 1),
    ("click", "view_item", 20, 99, 2), ("click", "add_to_cart", 60, 99, 3),
    ("signup", "first_visit", 0, 99, 0), ("signup", "page_view", 0, 99, 1), ("signup", "user_engagement", 0, 99, 2),
    ("error", "page_view", 0, 99, 0), ("error", "view_search_results", 80, 99, 1),
    ("purchase", "page_view", 0, 99, 0), ("purchase", "view_item", 0, 79, 1), ("purchase", "add_to_cart", 0, 69, 2),
    ("purchase", "begin_checkout", 0, 6, 3), ("purchase", "begin_checkout", 9, 54, 3),
    ("purchase", "add_shipping_info", 0, 6, 4), ("purchase", "add_shipping_info", 9, 54, 4),
    ("purchase", "add_payment_info", 0, 34, 5), ("purchase", "purchase", 0, 24, 6), ("purchase", "purchase", 4, 6, 8),
)

CALENDAR_ROWS = (
    (dt.date(2024, 1, 1), "New Year's Day"),
    (dt.date(2024, 1, 15), "Holiday Monday"),
    (dt.date(2024, 1, 26), "Payday Friday"),
)

WINDOW_ROWS = (
    ("Opening week", dt.date(2024, 1, 1), dt.date(2024, 1, 7), "baseline"),
    ("Second week", dt.date(2024, 1, 8), dt.date(2024, 1, 14), "event"),
    ("Incident week", dt.date(2024, 1, 15), dt.date(2024, 1, 21), "event"),
    ("Month end", dt.date(2024, 1, 22), dt.date(2024, 1, 30), "event"),
    ("Sizing", dt.date(2024, 1, 8), dt.date(2024, 1, 28), "sizing"),
)


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALENDAR_ROWS, CALENDAR)


def trading_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOW_ROWS, TRADING_WINDOWS)


def write_reference(spark: SparkSession, folder: str) -> None:
    """The two reference tables as CSV."""
    for name, table in (("calendar", calendar(spark)), ("trading_windows", trading_windows(spark))):
        table.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k -> its nine products in order. 100 rows of nine: k is two digits and a basket has at most nine lines."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n_parts = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    slots = (spark.range(100).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("i"))
             .withColumn("p_partkey", F.pmod(F.col("k") * 7 + F.col("i"), n_parts)))
    products = (part.select("p_partkey", "p_name", "p_type", "p_retailprice")
                .join(F.broadcast(slots), "p_partkey"))
    line = F.struct("i", F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("item_name"),
                    F.col("p_type").alias("item_category"), F.col("p_retailprice").alias("price_in_usd"))
    return products.groupBy("k").agg(F.sort_array(F.collect_list(line)).alias("products"))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source events with k, their day and the day their visit began."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"),
                          F.get_json_object("props", "$.k").cast("long").alias("k"))
            .withColumns({"day": F.to_date("ts"), "visit_day": F.to_date(F.col("ts") - F.expr(f"INTERVAL {LATE} MINUTES"))}))


def _visits(source: DataFrame) -> DataFrame:
    """One row per user and day a visit began: its first event and the running number of the visit for that user."""
    first = F.min(F.struct("ts", "event_id", "event_type", "k", "value", "day")).alias("first")
    # A user has at most one visit per calendar day here, so the window never holds more than the days of the data.
    cleared = F.expr(CLEARED_USERS) & (F.col("visit_day") >= F.lit(CLEARED))
    return (source.groupBy("user_id", "visit_day").agg(first).withColumn("cleared", cleared)
            .withColumn("session_number", F.row_number().over(Window.partitionBy("user_id", "cleared").orderBy("visit_day")).cast("long")))


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less time, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _n_items(name: Column, k: Column) -> Column:
    return F.when(_lists_items(name), F.when(k == 9, 0).when((name == "add_to_cart") & (k >= 92), 9)
                  .otherwise(1 + F.pmod(k, F.lit(4)))).cast("int")


def _lists_items(name: Column) -> Column:
    return name.isin("view_item", "add_to_cart", "begin_checkout", "purchase")


def _lines(products: Column, n_items: Column, revenue: Column) -> Column:
    """The first products as item lines."""
    return F.when(n_items.isNotNull(), F.transform(
        F.slice(products, F.lit(1), n_items),
        lambda p: F.struct(p["item_id"].alias("item_id"), p["item_name"].alias("item_name"),
                           p["item_category"].alias("item_category"), p["price_in_usd"].alias("price_in_usd"),
                           F.lit(1).cast("long").alias("quantity"), revenue.alias("item_revenue_in_usd"))))


def _entry(key: str, text: Column | None = None, number: Column | None = None) -> Column:
    """One event parameter."""
    slots = F.struct((F.lit(None) if text is None else text).cast("string").alias("string_value"),
                     (F.lit(None) if number is None else number).cast("long").alias("int_value"),
                     F.lit(None).cast("double").alias("float_value"),
                     F.lit(None).cast("double").alias("double_value"))
    return F.struct(F.lit(key).alias("key"), slots.alias("value"))


def _mixed(k: Column, value: Column) -> dict[str, Column]:
    """Numbers sit in the text slot on odd k and in the number slot on even k, as real exports mix them."""
    odd = F.pmod(k, F.lit(2)) == 1
    return {"text": F.when(odd, value.cast("string")), "number": F.when(~odd, value)}


def _params(name: Column, k: Column) -> Column:
    """The parameters that follow from an event's name and k, in order."""
    term = F.when(F.pmod(k, F.lit(40)) == 5, F.lit(None)).when(F.pmod(k, F.lit(10)) == 0, "<Other>").otherwise(
        F.concat(F.lit("term "), k.cast("string")))
    engaged = F.when(F.pmod(k, F.lit(5)) == 0, 0).otherwise(1)
    return F.array_compact(F.array(
        F.when((name == "page_view") & (F.pmod(k, F.lit(50)) != 7),
               _entry("page_location", text=F.concat(F.lit("https://shop.example/p/"), k.cast("string")))),
        F.when((name == "page_view") & (F.pmod(k, F.lit(12)) != 0),
               _entry("page_title", text=F.concat(F.lit("Page "), k.cast("string")))),
        F.when((name == "page_view") & (k == REPEATED_KEY), _entry("page_title", text=F.lit("Page again"))),
        F.when(name == "view_search_results", _entry("search_term", text=term)),
        F.when(name == "user_engagement", _entry("engagement_time_msec", number=1000 * (k + 1))),
        _entry("session_engaged", **_mixed(k, engaged)),
    ))


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_name, k) -> what all such events share: their parameters, their item lines without revenue, and the products of
    those that have revenue. A row per name and two-digit k."""
    name, k = F.col("event_name"), F.col("k")
    names = spark.createDataFrame([(n,) for n in sorted({e[1] for e in EXPANSION} | {"session_start"})], "event_name string")
    return (spark.range(100).select(F.col("id").alias("k")).crossJoin(names).join(F.broadcast(_catalogue(spark, sf_dir)), "k", "left")
            .select("event_name", "k", _params(name, k).alias("params"),
                    _lines(F.col("products"), _n_items(name, k), F.lit(None).cast("double")).alias("lines"),
                    F.when(name == "purchase", F.col("products")).alias("products")))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the export, narrow: what their source event and their visit say of them."""
    # Dealt out before anything is expanded, however few files the events come in; adaptive execution sets the number.
    source = _source(spark, sf_dir).repartition("event_id")
    visits = _visits(source)
    steps = F.broadcast(spark.createDataFrame(
        EXPANSION, "event_type string, event_name string, lo long, hi long, after long"))
    # The narrow source rows meet their visit; the three rows that each becomes are made after that.
    hits = (source.join(visits.select("user_id", "visit_day", "session_number"), ["user_id", "visit_day"], "left")
            .join(steps, "event_type").where("k BETWEEN lo AND hi").drop("lo", "hi")
            .where((F.col("event_name") != "add_payment_info") | (F.col("day") >= F.lit(ONSET))))
    starts = (visits.where("first.k NOT IN (33, 66)")
              .select("user_id", "visit_day", "session_number", "first.*",
                      F.explode(F.when(F.col("first.k") == 50, F.expr("array(-1L, -2L)"))
                                .otherwise(F.expr("array(-1L)"))).alias("after"))
              .withColumn("event_name", F.lit("session_start")))
    return hits.unionByName(starts)


def nested_export(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """The export. `keep(df, name)` may store its narrow events and the small table they meet; the nested columns are made as
    they are read, so each reader makes those it needs and none is written."""
    rows, looks = keep(_hits(spark, sf_dir), "export"), keep(_looks(spark, sf_dir), "export_looks")
    nation = F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")
                         .select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("country")))
    # Parameters and lines are made once per name and k, not per event; only lines with revenue are made here.
    rows = (rows.withColumn("nation", F.pmod("user_id", F.lit(25))).join(nation, "nation", "left")
            .join(F.broadcast(looks), ["event_name", "k"], "left"))

    name, k, user = F.col("event_name"), F.col("k"), F.col("user_id")
    d, m = F.pmod(user, F.lit(20)), F.pmod(user + F.floor(user / 20), F.lit(10))
    incident = F.col("day").between(F.lit(INCIDENT[0]), F.lit(INCIDENT[1])) & (k < 12)
    session = F.when((F.col("event_type") == "view") & (k == 97), F.lit(None)).otherwise(
        F.datediff("visit_day", F.lit(FIRST_DAY)) + 1).cast("long")
    n_items = _n_items(name, k)
    revenue = F.when(name == "purchase", F.when(incident | (k == 3), 0.0).otherwise(F.col("value")))
    order_id = F.when(name == "purchase", F.when(incident | (k == 1), F.lit(None)).when(k == 2, "(not set)")
                      .when(k == 3, "").when(k == SHARED_ORDER, "shared").otherwise(F.col("event_id").cast("string")))
    line_revenue = revenue / n_items * F.when(F.pmod(k, F.lit(10)) == 6, 1.2).otherwise(1.0)
    number = _entry("ga_session_number", **_mixed(k, F.col("session_number")))
    own = F.when(session.isNotNull(), F.array(_entry("ga_session_id", number=session), number)).otherwise(F.array(number))
    # A session start may have any k.
    params = F.concat(own, F.coalesce("params", _params(name, k)))
    items = F.when(name == "purchase", _lines(F.col("products"), n_items, line_revenue)).otherwise(F.col("lines"))
    return rows.select(
        F.date_format("day", "yyyyMMdd").alias("event_date"),
        (_micros(F.col("ts")) + F.col("after") * 1_000_000).alias("event_timestamp"),
        "event_name", user.cast("string").alias("user_pseudo_id"), params.alias("event_params"),
        F.struct(F.when((name != "session_start") & ~F.expr(NO_DEVICE), F.when(d < 11, "desktop").when(d < 19, "mobile").otherwise("tablet"))
                 .alias("category")).alias("device"),
        F.struct("country").alias("geo"),
        F.struct(
            F.when(m < 4, "organic").when(m < 6, "(none)").when(m < 8, "referral").when(m == 8, "cpc")
            .otherwise("<Other>").alias("medium"),
            F.when((m < 4) | (m == 8), "google").when(m < 6, "(direct)").when(m < 8, "partner.example")
            .otherwise("<Other>").alias("source")).alias("traffic_source"),
        F.struct(order_id.alias("transaction_id"), revenue.alias("purchase_revenue_in_usd"),
                 n_items.cast("long").alias("total_item_quantity")).alias("ecommerce"),
        items.alias("items"),
    )
