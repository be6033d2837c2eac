"""From purchase events to orders.

An event with a valid ID counts once per user; later ones are repeats. Without a usable ID an event counts when it
carries revenue, and is empty otherwise.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..contract import MONEY, MONEY_TOTAL, valid_id
from ..functions.columns import exprs, one_row, sessions_sql, weighted

PURCHASE_KEY = ("user_pseudo_id", "ga_session_id", "event_ts", "event_date", "transaction_id", "purchase_revenue_usd")


def purchases(events: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Distinct purchase events with how often each was sent (`n_events`) and what became of those events.

    Identical events are merged before anything is shuffled, and the first event of each (ID, user) is an aggregate
    joined back on the complete row, so neither a hot order ID nor a pile of copies lands in one task. `keep` may
    store the merged events, a thousandth of all events, which are read twice.
    """
    rows = keep(events.where(F.col("event_name") == "purchase")
                .groupBy(*PURCHASE_KEY).agg(F.count(F.lit(1)).alias("n_events")))
    # Earliest, then dearest, then lowest session; NULLs last throughout.
    order = ("struct(event_ts IS NULL AS no_ts, event_ts, purchase_revenue_usd IS NULL AS no_revenue, "
             "-purchase_revenue_usd AS dearest, ga_session_id IS NULL AS no_session, ga_session_id, event_date)")
    first = (rows.groupBy("transaction_id", "user_pseudo_id").agg(F.expr(f"min({order}) AS f"))
             .selectExpr("transaction_id AS f_id", "user_pseudo_id AS f_user", "f.event_ts AS f_ts",
                         "-f.dearest AS f_revenue", "f.ga_session_id AS f_session", "f.event_date AS f_date", "true AS found"))
    same = F.expr("transaction_id <=> f_id AND user_pseudo_id <=> f_user AND event_ts <=> f_ts AND "
                  "purchase_revenue_usd <=> f_revenue AND ga_session_id <=> f_session AND event_date <=> f_date")
    return (rows.join(first, same, "left")
            .withColumn("has_valid_id", F.expr(valid_id("transaction_id")))
            .withColumn("is_first", F.expr("has_valid_id AND coalesce(found, false)"))
            .withColumn("is_empty", F.expr("NOT has_valid_id AND coalesce(purchase_revenue_usd, 0D) <= 0"))
            .select(*PURCHASE_KEY, "n_events", "has_valid_id", "is_first", "is_empty", *exprs({
                "n_repeats": "CASE WHEN has_valid_id THEN n_events - CAST(is_first AS BIGINT) ELSE 0L END",
                "n_orders": "CASE WHEN has_valid_id THEN CAST(is_first AS BIGINT) WHEN is_empty THEN 0L ELSE n_events END",
            })))


def purchase_events(purchases: DataFrame, block: int = 10_000) -> DataFrame:
    """One row per purchase event with its flags.

    Copies are written out in blocks that are spread over the tasks, so an event sent very often neither builds one
    huge array nor fills one task.
    """
    blocks = F.expr(f"explode(sequence(0L, (n_events - 1) DIV {block}))")
    copies = F.expr(f"explode(sequence(block * {block} + 1, least((block + 1) * {block}, n_events)))")
    return (purchases.withColumn("block", blocks).repartition(*PURCHASE_KEY, "block").withColumn("copy", copies)
            .withColumn("is_repeat", F.col("has_valid_id") & ~(F.col("is_first") & (F.col("copy") == 1)))
            .withColumn("counts_as_order", ~F.col("is_repeat") & ~F.col("is_empty"))
            .select(*PURCHASE_KEY, "has_valid_id", "is_repeat", "is_empty", "counts_as_order"))


def session_orders(purchases: DataFrame) -> DataFrame:
    """Orders and order revenue per session."""
    spent = f"CAST(CAST(purchase_revenue_usd AS {MONEY}) * n_orders AS {MONEY_TOTAL})"
    return (purchases.where("ga_session_id IS NOT NULL")
            .groupBy("user_pseudo_id", "ga_session_id")
            .agg(*exprs({"orders": "sum(n_orders)",
                         "revenue_usd": f"CAST(sum({spent}) FILTER (WHERE n_orders > 0) AS DOUBLE)"})))


def order_summary(purchases: DataFrame, sessions: DataFrame) -> DataFrame:
    """How purchase events became orders, and session conversion with and without the order rule."""
    counted = purchases.agg(*exprs({
        "purchase_events": "coalesce(sum(n_events), 0L)",
        "repeats": "coalesce(sum(n_repeats), 0L)",
        "empty": "coalesce(sum(n_events) FILTER (WHERE is_empty), 0L)",
        "orders": "coalesce(sum(n_orders), 0L)",
        "orders_without_id": "coalesce(sum(n_orders) FILTER (WHERE NOT has_valid_id), 0L)",
    }))
    converted = weighted(sessions).agg(*exprs({
        "conversion_orders": f"try_divide({sessions_sql('has_purchase')}, {sessions_sql()})",
        "conversion_raw_events": f"try_divide({sessions_sql('has_purchase_event')}, {sessions_sql()})",
    }))
    return counted.withColumn("c", one_row(converted)).select("*", "c.*").drop("c")
