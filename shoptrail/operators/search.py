"""Does search help, or do likely buyers search? Comparison like for like, and the experiment that would settle it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import exprs, sessions_sql, week_start, weighted
from ..functions.stats import standardised_difference, with_n_per_arm, with_two_proportions
from .cells import user_days
from .kpis import window_days

# Attributes that are settled when a visit begins: searching cannot have changed them.
STRATA = ("device_category", "user_type", "medium_group", "prior_purchaser")
MIN_SEARCHES = 100
LIFTS = (0.05, 0.10, 0.20)
BOUGHT, SAW_PRODUCTS = "Bought within the week", "Saw products in a search session"


def search_cells(sessions: DataFrame) -> DataFrame:
    """Counts per stratum for searching and other sessions, NULL devices included."""
    return weighted(sessions).groupBy(*STRATA).agg(*exprs({
        "n_search": sessions_sql("has_search"),
        "x_search": sessions_sql("has_search AND has_purchase"),
        "n_other": sessions_sql("NOT has_search"),
        "x_other": sessions_sql("NOT has_search AND has_purchase"),
        "v_search": sessions_sql("has_search AND has_view_item"),
        "v_other": sessions_sql("NOT has_search AND has_view_item"),
    }))


def search_strata(cells: DataFrame) -> DataFrame:
    """The strata compared like for like; sessions without a known device belong to none."""
    return (cells.where(F.col("device_category").isNotNull())
            .select(*STRATA, "n_search", "x_search", "n_other", "x_other"))


def search_vs_intent(cells: DataFrame) -> DataFrame:
    """Naive and like-for-like difference in conversion between searching and other sessions."""
    strata = ("n_search", "x_search", "n_other", "x_other")
    # Product-view rates count every session; the comparison leaves out NULL devices.
    cells = cells.selectExpr("n_search AS all_search", "n_other AS all_other", "v_search", "v_other",
                             *[f"CASE WHEN device_category IS NOT NULL THEN {c} END AS {c}" for c in strata])
    totals = cells.agg(*exprs({
        **{c: f"coalesce(sum({c}), 0L)" for c in strata},
        "product_view_rate_search": "try_divide(sum(v_search), sum(all_search))",
        "product_view_rate_other": "try_divide(sum(v_other), sum(all_other))",
    }), standardised_difference(*strata).alias("adj"))
    rows = with_two_proportions(totals, "naive", "x_search", "n_search", "x_other", "n_other")
    return rows.selectExpr(
        f"n_search >= {MIN_SEARCHES} AS enough", "n_search AS search_sessions", "n_other AS other_sessions",
        "try_divide(n_search, n_search + n_other) AS search_share",
        "naive.p1 AS conversion_search", "naive.p0 AS conversion_other", "naive.diff AS naive_diff", "naive.lo AS naive_lo",
        "naive.hi AS naive_hi", "naive.p_value AS naive_p_value", "naive.rel AS naive_rel",
        "adj.diff AS adjusted_diff", "adj.se AS adjusted_se", "adj.lo AS adjusted_lo", "adj.hi AS adjusted_hi",
        "adj.coverage AS coverage", "adj.strata_used AS strata_used", "adj.strata_total AS strata_total",
        "1D - try_divide(adj.diff, naive.diff) AS share_explained",
        "product_view_rate_search", "product_view_rate_other")


def search_verdict(summary: DataFrame) -> DataFrame:
    """What the comparison allows to be said."""
    return summary.selectExpr(
        "adjusted_diff", "naive_diff", "share_explained",
        "CASE WHEN NOT enough THEN 'too few searches' "
        "WHEN adjusted_lo <= 0 AND adjusted_hi >= 0 THEN 'indistinguishable from zero' "
        "WHEN adjusted_diff > 0 THEN 'positive difference remains' ELSE 'negative difference' END AS verdict",
        "CASE WHEN NOT enough OR share_explained IS NULL OR naive_diff <= 0 THEN NULL "
        "WHEN share_explained >= 1 THEN 'all' WHEN share_explained <= 0.05 THEN 'none' ELSE 'part' END AS explained",
    ).selectExpr(
        "verdict", "explained", "share_explained",
        "CASE WHEN explained = 'none' THEN if(adjusted_diff > naive_diff, 'slightly larger', 'about the same') END AS like_for_like_gap")


def experiment_sizing(sessions: DataFrame, trading_windows: DataFrame, lifts=LIFTS) -> DataFrame:
    """Users per arm and weeks of traffic for two candidate metrics, from the weeks marked for sizing.

    The unit is a user's week, added up from the days of users, or from sessions. The sizing days are a short day list, so the
    range becomes a semi-join that drops other rows before the one shuffle.
    """
    days = (window_days(trading_windows.where("role = 'sizing'"))
            .select(F.col("date").alias("session_date")).distinct())
    came = sessions if "saw_products" in sessions.columns else user_days(sessions)
    user_weeks = (came.join(F.broadcast(days), "session_date", "left_semi")
                  .groupBy(week_start(F.col("session_date")).alias("week_start"), "user_pseudo_id")
                  .agg(*exprs({c: f"bool_or({c})" for c in ("searched", "bought", "saw_products")})))
    weeks = user_weeks.groupBy("week_start").agg(*exprs({
        "searchers": "count_if(searched)", "buyers": "count_if(searched AND bought)", "viewers": "count_if(saw_products)"}))
    base = (weeks.agg(*exprs({"searchers": "sum(searchers)", "buyers": "sum(buyers)", "viewers": "sum(viewers)",
                              "sizing_weeks": "count(*)"}))
            .where("searchers > 0 AND buyers > 0")
            .selectExpr("*", "try_divide(searchers, sizing_weeks) AS weekly_searching_users"))
    metrics = (f"inline(array(struct(0 AS metric_order, '{BOUGHT}' AS metric, try_divide(buyers, searchers) AS baseline), "
               f"struct(1 AS metric_order, '{SAW_PRODUCTS}' AS metric, try_divide(viewers, searchers) AS baseline)))")
    plans = (base.selectExpr("sizing_weeks", "searchers", "buyers", "weekly_searching_users", metrics)
             .withColumn("relative_lift", F.explode(F.array(*[F.lit(x) for x in lifts])))
             .where("baseline * (1 + relative_lift) > 0 AND baseline * (1 + relative_lift) < 1"))
    return (with_n_per_arm(plans, "users_per_arm", "baseline", "relative_lift")
            .selectExpr("*", "CAST(ceil(try_divide(2D * users_per_arm, weekly_searching_users)) AS BIGINT) AS weeks"))


def primary_metric(plans: DataFrame, lift: float = 0.10) -> DataFrame:
    """Which metric is practical at this traffic: seeing products when it needs fewer weeks than buying."""
    weeks = lambda metric: f"max(weeks) FILTER (WHERE metric = '{metric}' AND abs(relative_lift - {lift}) < 1e-9)"
    row = plans.agg(*exprs({"weeks_bought": weeks(BOUGHT), "weeks_saw_products": weeks(SAW_PRODUCTS)}))
    return row.selectExpr("*", f"CASE WHEN weeks_saw_products < weeks_bought THEN '{SAW_PRODUCTS}' "
                          f"WHEN weeks_bought IS NOT NULL THEN '{BOUGHT}' END AS primary_metric")
