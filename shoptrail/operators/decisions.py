"""One-row decision tables composed from the analyses."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import one_row

# Fixed values of the targets.
RELATIVE_GOAL, GOAL_CAP, VALID_ID_GOAL = 1.1, 0.99, 0.995


def okr_targets(summary: DataFrame, funnel: DataFrame, checkout: DataFrame, scorecard: DataFrame,
                window_overview: DataFrame) -> DataFrame:
    """Baselines measured in the analysis window and the targets they imply."""
    basket = funnel.where("breakdown = 'overall' AND step = 'Added to basket'").select("rate_from_previous")
    missing = scorecard.where("check = 'purchases_missing_transaction_id'").select("rate")
    high = scorecard.where("status = 'fail' AND severity = 'high'").agg(F.count(F.lit(1)))
    goal = lambda c: f"CASE WHEN {c} IS NOT NULL THEN least({c} * {RELATIVE_GOAL}D, {GOAL_CAP}D) END"
    rows = (summary.select(F.col("product_view_rate_search").alias("search_sees_products"))
            .withColumn("view_to_basket", basket.scalar())
            .withColumn("c", one_row(checkout))
            .withColumn("missing_id", missing.scalar())
            .withColumn("o", one_row(window_overview.select("conversion", "engaged_share")))
            .withColumn("high_severity_failures", high.scalar()))
    return rows.selectExpr(
        "search_sees_products", f"{goal('search_sees_products')} AS search_sees_products_target",
        "view_to_basket", f"{goal('view_to_basket')} AS view_to_basket_target",
        "c.mobile AS mobile_completion", "c.desktop AS desktop_completion",
        # Half the gap to desktop, or hold when mobile is not behind.
        "CASE WHEN c.desktop > c.mobile THEN c.mobile + (c.desktop - c.mobile) / 2 ELSE c.mobile END AS mobile_completion_target",
        "1 - missing_id AS valid_id_share", f"{VALID_ID_GOAL}D AS valid_id_target",
        "o.conversion AS conversion", "o.engaged_share AS engaged_share", "high_severity_failures")


def headline(overview: DataFrame, window: DataFrame, window_overview: DataFrame, orders: DataFrame,
             scorecard: DataFrame, drop: DataFrame, summary: DataFrame, checkout: DataFrame) -> DataFrame:
    """The whole readout in one row."""
    failed = scorecard.agg(F.count_if(F.col("status") == "fail").alias("failed"), F.count(F.lit(1)).alias("checks"))
    return (overview.select("sessions", "users", "first_day", "last_day")
            .withColumn("w", one_row(window)).withColumn("wo", one_row(window_overview))
            .withColumn("o", one_row(orders)).withColumn("a", one_row(failed)).withColumn("d", one_row(drop))
            .withColumn("s", one_row(summary)).withColumn("c", one_row(checkout))
            .selectExpr("sessions", "users", "first_day", "last_day",
                        "w.start AS window_start", "w.sessions AS window_sessions", "w.excluded_weeks AS excluded_weeks",
                        "o.purchase_events", "o.orders", "o.repeats", "o.empty AS empty_events",
                        "a.failed AS checks_failed", "a.checks AS checks",
                        "wo.conversion AS conversion", "wo.conversion_lo AS conversion_lo", "wo.conversion_hi AS conversion_hi",
                        "d.from_step AS drop_from", "d.to_step AS drop_to", "d.kept AS drop_kept",
                        "s.search_share AS search_share", "s.naive_diff AS search_naive_diff",
                        "s.adjusted_diff AS search_adjusted_diff", "s.adjusted_lo AS search_adjusted_lo",
                        "s.adjusted_hi AS search_adjusted_hi",
                        "c.mobile AS mobile_completion", "c.desktop AS desktop_completion", "c.diff AS completion_diff"))
