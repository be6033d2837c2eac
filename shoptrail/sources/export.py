"""Flatten the nested event export into the flat tables: one lazy plan over any range of days."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..contract import ECOMMERCE_EVENTS, EVENTS, EXPORT, INVENTORY, ITEMS, require_columns

# Event parameters lifted to columns, and the type each becomes.
PARAMS = (
    ("ga_session_id", "long"),
    ("ga_session_number", "long"),
    ("page_location", "string"),
    ("page_title", "string"),
    ("search_term", "string"),
    ("engagement_time_msec", "long"),
    ("session_engaged", "string"),
)


def in_days(export: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Inclusive day range, compared on the raw partition text so whole days are pruned before they are read."""
    if first is not None:
        export = export.where(F.col("event_date") >= first.strftime("%Y%m%d"))
    if last is not None:
        export = export.where(F.col("event_date") <= last.strftime("%Y%m%d"))
    return export


def param(key: str, kind: str = "string") -> Column:
    """One event parameter by key, whichever typed slot it was stored in. A repeated key gives its first value.

    Looking the position up in the array of keys stays inside generated code, shares the arrays between parameters and
    reads only the slots used, none of which a lambda over the entries would do.
    """
    at = f"CAST(array_position(event_params.key, '{key}') AS INT) - 1"
    text, number = f"get(event_params.value.string_value, {at})", f"get(event_params.value.int_value, {at})"
    if kind == "long":
        return F.expr(f"coalesce({number}, try_cast({text} AS BIGINT))")
    return F.expr(f"coalesce({text}, CAST({number} AS STRING))")


def _day() -> Column:
    return F.to_date("event_date", "yyyyMMdd").alias("event_date")


def _ts() -> Column:
    return F.timestamp_micros("event_timestamp").alias("event_ts")


def flatten_events(export: DataFrame) -> DataFrame:
    return require_columns(export.select(
        _day(), _ts(), "event_name", "user_pseudo_id",
        *[param(key, kind).alias(key) for key, kind in PARAMS],
        F.col("device.category").alias("device_category"),
        F.col("geo.country").alias("country"),
        F.col("traffic_source.medium").alias("first_medium"),
        F.col("traffic_source.source").alias("first_source"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
        F.col("ecommerce.purchase_revenue_in_usd").alias("purchase_revenue_usd"),
        # Counting one field of the lines reads only that field.
        F.array_size("items.item_id").cast("long").alias("n_items"),
        F.col("ecommerce.total_item_quantity").alias("item_quantity"),
    ), EVENTS, "events")


def flatten_items(export: DataFrame) -> DataFrame:
    """One row per product line of the e-commerce events; events without products drop out."""
    return require_columns(
        export.where(F.col("event_name").isin(*ECOMMERCE_EVENTS))
        .select(_day(), _ts(), "event_name", "user_pseudo_id", param("ga_session_id", "long").alias("ga_session_id"),
                F.explode("items").alias("item"))
        .select("event_date", "event_ts", "event_name", "user_pseudo_id", "ga_session_id",
                "item.item_id", "item.item_name", "item.item_category",
                F.col("item.price_in_usd").alias("price_usd"), "item.quantity",
                F.col("item.item_revenue_in_usd").alias("item_revenue_usd")),
        ITEMS, "items")


def param_inventory(export: DataFrame, per_day: bool = False) -> DataFrame:
    """Which parameters each event carries, and how often with a value in any slot; `per_day` splits the counts by day."""
    day = [_day()] if per_day else []
    counted = (export.select(*day, "event_name", F.explode("event_params").alias("p"))
               .groupBy(*[F.col("event_date") for _ in day], "event_name", F.col("p.key").alias("param_key"))
               .agg(F.expr("count(*) AS n_present"), F.expr(
                   "count_if(p.value.string_value IS NOT NULL OR p.value.int_value IS NOT NULL "
                   "OR p.value.double_value IS NOT NULL OR p.value.float_value IS NOT NULL) AS n_nonnull")))
    return counted if per_day else require_columns(counted, INVENTORY, "parameter inventory")


def repeated_params(export: DataFrame) -> DataFrame:
    """Events that carry one parameter key more than once, per event name: their first value is the one used."""
    return (export.select("event_name", F.transform("event_params", lambda p: p["key"]).alias("keys"))
            .groupBy("event_name")
            .agg(F.count_if(F.size("keys") > F.size(F.array_distinct("keys"))).alias("n_events_with_repeated_keys")))


def check_day(export: DataFrame, day: dt.date) -> tuple[DataFrame, DataFrame]:
    """Schema check on one day: the flattened frames of that day, already checked against their contracts."""
    one = in_days(require_columns(export, EXPORT, "export"), day, day)
    return flatten_events(one), flatten_items(one)
