"""Daily KPIs, conversion trend and trading-window comparison."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import exprs, sessions_sql, total_sql, week_start, weighted
from ..functions.stats import with_two_proportions
from .cells import users_by_day

PURCHASE_METRICS = ("purchase_events", "purchases_missing_id", "empty_purchase_events", "repeat_purchase_events",
                    "orders_without_id")


def daily_kpis(sessions: DataFrame, purchases: DataFrame, calendar: DataFrame, timeline: DataFrame,
               visitors: DataFrame | None = None) -> DataFrame:
    """One row per day with sessions. Session metrics use the session's day, purchase metrics the event's. For cells of sessions
    the users come from `visitors`, the bitmaps of the days."""
    visits = weighted(sessions).groupBy(F.col("session_date").alias("date")).agg(*exprs({
        "sessions": sessions_sql(),
        "users": "count(DISTINCT user_pseudo_id)" if visitors is None else "0L",
        "purchasing_sessions": sessions_sql("has_purchase"),
        "orders": "sum(orders)",
        "revenue_usd": total_sql("revenue_usd"),
        "search_sessions": sessions_sql("has_search"),
        "product_view_sessions": sessions_sql("has_view_item"),
        "basket_sessions": sessions_sql("has_add_to_cart"),
        "checkout_sessions": sessions_sql("has_begin_checkout"),
        "checkout_completed": sessions_sql("has_begin_checkout AND has_purchase"),
        "sessions_missing_start": sessions_sql("n_session_start = 0"),
    }))
    if visitors is not None:
        came = users_by_day(visitors).select(F.col("date").alias("day"), F.col("users").alias("came"))
        visits = (visits.join(came, F.col("date").eqNullSafe(F.col("day")), "left")
                  .withColumn("users", F.coalesce("came", F.lit(0))).drop("day", "came"))
    sent = purchases.groupBy(F.col("event_date").alias("date")).agg(*exprs({
        "purchase_events": "sum(n_events)",
        "purchases_missing_id": "sum(n_events) FILTER (WHERE NOT has_valid_id)",
        "empty_purchase_events": "sum(n_events) FILTER (WHERE is_empty)",
        "repeat_purchase_events": "sum(n_repeats)",
        "orders_without_id": "sum(n_orders) FILTER (WHERE NOT has_valid_id)",
    }))
    return (visits.join(sent, "date", "left").fillna(0, list(PURCHASE_METRICS))
            .join(calendar.withColumnRenamed("label", "calendar_label"), "date", "left")
            .join(timeline.selectExpr("date", "in_journey_window AS journey_tracked"), "date", "left")
            .select("date", *[c for c in visits.columns if c != "date"], *PURCHASE_METRICS, "calendar_label", *exprs({
                "conversion": "try_divide(purchasing_sessions, sessions)",
                "checkout_completion": "try_divide(checkout_completed, checkout_sessions)",
                "search_share": "try_divide(search_sessions, sessions)",
            }), "journey_tracked"))


def conversion_trend(daily: DataFrame) -> DataFrame:
    """Daily conversion and its mean over the last seven days present, from the fourth day on."""
    week = Window.orderBy("date").rowsBetween(-6, 0)
    return daily.select(
        "date", "conversion", "calendar_label",
        F.when(F.count("conversion").over(week) >= 4, F.avg("conversion").over(week)).alias("conversion_7_day"))


def window_days(trading_windows: DataFrame) -> DataFrame:
    """Each window as one row per day, so the date ranges become plain equality joins; NULL for a window without days."""
    return trading_windows.withColumn("date", F.expr(
        "explode_outer(CASE WHEN start_date <= end_date THEN sequence(start_date, end_date) END)"))


WINDOW_SUMS = ("sessions", "purchasing_sessions", "orders", "orders_without_id", "checkout_sessions",
               "checkout_completed", "search_sessions")


def compare_windows(daily: DataFrame, trading_windows: DataFrame, gate: DataFrame, journey_start: DataFrame) -> DataFrame:
    """Each trading window against the baseline, held weeks left out but counted.

    Checkout completion is compared only for windows starting inside the journey window. A window that is configured
    twice is two rows.
    """
    # The configuration has a row per window, so numbering it in one task is cheap.
    asked = (trading_windows.where(F.col("role").isin("baseline", "event"))
             .withColumn("window_number", F.row_number().over(Window.orderBy("start_date", "window_name", "role", "end_date"))))
    held = gate.where("held").select("week_start", F.lit(True).alias("in_held_week"))
    days = (daily.withColumn("week_start", week_start(F.col("date")))
            .join(held, "week_start", "left").withColumn("used", F.col("in_held_week").isNull()))
    spans = (window_days(asked)
             .join(days, "date", "left")
             .groupBy("window_number", "window_name", "role", "start_date", "end_date")
             .agg(*exprs({
                 "days": "count_if(used)",
                 "days_excluded": "count_if(NOT used)",
                 **{c: f"coalesce(sum({c}) FILTER (WHERE used), 0)" for c in WINDOW_SUMS},
                 "revenue": total_sql("CASE WHEN used THEN revenue_usd END"),
             })))
    # One row per configured window, so the unpartitioned window that shares the first baseline holds only those.
    first_baseline = F.when(F.col("role") == "baseline", F.struct("start_date", "window_name"))
    missing = F.raise_error(F.lit("trading_windows has no baseline window"))
    rows = (spans.withColumn("b", F.min_by(F.struct(*WINDOW_SUMS), first_baseline).over(Window.partitionBy()))
            .withColumn("b", F.when(F.col("b").isNull(), missing).otherwise(F.col("b")))
            .withColumn("tracked", F.col("start_date") >= journey_start.select("start").scalar()))
    rows = with_two_proportions(rows, "conv", "purchasing_sessions", "sessions", "b.purchasing_sessions", "b.sessions")
    rows = with_two_proportions(rows, "comp", "checkout_completed", "if(tracked, checkout_sessions, 0)",
                                "b.checkout_completed", "b.checkout_sessions")
    return rows.selectExpr(
        "window_name AS `window`", "role", "start_date AS `start`", "end_date AS `end`", "days", "days_excluded",
        "try_divide(sessions, days) AS sessions_per_day",
        "conv.p1 AS conversion", "conv.diff AS conversion_change_pp", "conv.rel AS conversion_change_rel",
        "conv.p_value AS conversion_p_value",
        "try_divide(revenue, orders) AS revenue_per_order",
        "try_divide(orders_without_id, orders) AS share_orders_without_id",
        "comp.p1 AS checkout_completion", "comp.diff AS checkout_completion_change_pp",
        "comp.p_value AS checkout_completion_p_value",
        "try_divide(search_sessions, sessions) AS search_share")
