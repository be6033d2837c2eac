"""The tracking audit: each check is a share of faulty rows judged against a threshold."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contract import ECOMMERCE_EVENTS, MONEY, MONEY_TOTAL
from ..functions.columns import exprs, sessions_sql, weighted
from ..functions.skew import exact_median, salted_join

COVERAGE_TARGET = 0.95
TOLERANCE = 0.01
NOISE_BAND = (0.35, 0.65)

# Fixed values of the scorecard: check, question, owner, severity, threshold (None = information only).
CHECKS = (
    ("events_missing_session_id", "Can every event be joined to a visit?", "engineering", "high", 0.005),
    ("sessions_without_session_start", "Does every visit record its start?", "engineering", "high", 0.02),
    ("sessions_with_repeated_session_start", "Is any visit's start recorded twice?", "engineering", "medium", 0.01),
    ("purchases_missing_transaction_id", "Can every order be counted once?", "engineering", "high", 0.005),
    ("duplicate_purchase_events", "Is any order sent more than once by the same user?", "engineering", "high", 0.002),
    ("purchases_without_revenue", "Does every order carry its value?", "engineering", "high", 0.005),
    ("ecommerce_events_without_items", "Do product, basket and order events say which products?", "engineering",
     "medium", 0.01),
    ("add_to_cart_with_many_products", "Does an add-to-basket event list what was added, not a whole page of products?",
     "engineering", "medium", 0.05),
    ("purchase_sessions_without_checkout", "Does every buyer pass through checkout as tracked?",
     "product and engineering", "medium", 0.02),
    ("searches_without_term", "Does every search record what was searched for?", "engineering", "medium", 0.01),
    ("search_terms_obfuscated", "How many search terms did Google's obfuscation replace?",
     "dataset, not a tracking fault", "info", None),
    ("page_views_without_location", "Does every page view say which page?", "engineering", "medium", 0.005),
    ("purchase_revenue_mismatch", "Does each order's value match the sum of its items (within 1%)?",
     "check the direction of the gaps first", "info", None),
    ("tracking_plan_fields_below_target", "Is every tracking-plan field on at least 95% of its events?",
     "engineering", "medium", 0.0),
)

# Fixed values of the tracking plan: event, journey stage, field, where it is stored, why it is needed.
PLAN = (
    ("session_start", "Arrive", "ga_session_id", "event_param", "Joins every event to its visit"),
    ("session_start", "Arrive", "ga_session_number", "event_param", "Separates first visits from returning ones"),
    ("page_view", "Arrive and browse", "page_location", "event_param", "Which page the shopper saw"),
    ("page_view", "Arrive and browse", "page_title", "event_param", "A readable page name for reporting"),
    ("page_view", "Arrive and browse", "ga_session_id", "event_param", "Joins the page view to its visit"),
    ("view_search_results", "Search", "search_term", "event_param", "What the shopper was looking for"),
    ("view_search_results", "Search", "ga_session_id", "event_param", "Joins the search to its visit"),
    ("view_item", "Product", "items", "items", "Which product was viewed"),
    ("add_to_cart", "Basket", "items", "items", "What went into the basket"),
    ("begin_checkout", "Checkout", "items", "items", "The basket at the start of checkout"),
    ("add_shipping_info", "Checkout", "ga_session_id", "event_param", "Delivery step reached, joined to its visit"),
    ("add_payment_info", "Checkout", "ga_session_id", "event_param", "Payment step reached, joined to its visit"),
    ("purchase", "Purchase", "transaction_id", "ecommerce", "Counts each order once"),
    ("purchase", "Purchase", "purchase_revenue_in_usd", "ecommerce", "Order value"),
    ("purchase", "Purchase", "items", "items", "What was bought"),
)


def tracking_plan(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(PLAN)]
    return spark.createDataFrame(rows, "plan_order int, event string, stage string, field string, source string, why string")


def _checks(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CHECKS)]
    return spark.createDataFrame(
        rows, "check_order int, check string, question string, owner string, severity string, threshold double")


def revenue_pairs(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """Purchase revenue beside the sum of its items, with how many events the pair stands for.

    Item revenue is one row per (user, session, time) before it is joined; NULL sessions never match.
    """
    key = ["user_pseudo_id", "ga_session_id", "event_ts"]
    known = f"CAST(CAST(item_revenue_usd AS {MONEY}) AS {MONEY_TOTAL})"
    lines = (items.where("event_name = 'purchase' AND item_revenue_usd IS NOT NULL")
             .groupBy(*key).agg(F.expr(f"CAST(sum({known}) AS DOUBLE) AS items_usd")))
    orders = (purchases.where("purchase_revenue_usd IS NOT NULL")
              .selectExpr(*key, "transaction_id", "purchase_revenue_usd AS order_usd", "n_events"))
    # Many orders at one (user, session, time) would be a tracking fault, so few pieces are enough here.
    joined = salted_join(orders, lines, key, ["transaction_id", "order_usd"], pieces=4, how="inner")
    return joined.selectExpr("n_events", "items_usd", "order_usd - items_usd AS gap",
                             f"{TOLERANCE}D * greatest(abs(items_usd), 0.01D) AS limit")


def revenue_gap(pairs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs that match, order above items, order below items, and the median relative gap of the mismatches.

    `keep(df, name)` stores the distinct gaps."""
    total = lambda rule: f"coalesce(sum(n_events) FILTER (WHERE {rule}), 0L)"
    median = exact_median(pairs.where("abs(gap) > limit"), F.expr("try_divide(abs(gap), abs(items_usd))"),
                          F.col("n_events"), "median_gap", keep)
    return (pairs.agg(*exprs({"match": total("abs(gap) <= limit"), "above": total("gap > limit"), "below": total("-gap > limit")}))
            .withColumn("median_gap", median.scalar()))


def revenue_gap_verdict(gap: DataFrame) -> DataFrame:
    """Gaps both ways look like noise; gaps mostly one way suggest charges inside the order value."""
    low, high = NOISE_BAND
    return (gap.selectExpr("match + above + below AS comparable", "above + below AS mismatches",
                           "try_divide(above, above + below) AS share_above")
            .selectExpr("*", f"CASE WHEN mismatches = 0 THEN 'all match' WHEN share_above BETWEEN {low}D AND {high}D THEN 'noise' "
                        "ELSE 'one-sided' END AS verdict"))


def tracking_coverage(spark: SparkSession, profile: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per plan row: the share of the event's rows that carry the field."""
    totals = profile.groupBy(F.col("event_name").alias("event")).agg(
        *exprs({c: f"sum({c})" for c in ("n", "with_items", "with_id", "with_revenue")}))
    filled = inventory.groupBy(F.col("event_name").alias("event"), F.col("param_key").alias("field")).agg(
        F.expr("sum(n_nonnull) AS n_nonnull"))
    ok = ("CASE WHEN source = 'event_param' THEN n_nonnull WHEN source = 'items' THEN with_items "
          "WHEN field = 'transaction_id' THEN with_id WHEN field = 'purchase_revenue_in_usd' THEN with_revenue END")
    return (tracking_plan(spark).join(totals, "event", "left").join(filled, ["event", "field"], "left")
            .selectExpr("plan_order", "stage", "event", "field", "source", f"coalesce({ok}, 0L) AS n_ok", "coalesce(n, 0L) AS n_events")
            .selectExpr("*", "try_divide(n_ok, n_events) AS coverage", f"{COVERAGE_TARGET}D AS target")
            .selectExpr("*", "CASE WHEN n_events = 0 THEN 'not tracked' WHEN coverage >= target THEN 'pass' ELSE 'fail' END AS status"))


def _long(df: DataFrame, measured: dict[str, tuple[str, str]]) -> DataFrame:
    """Numerator and denominator aggregates by check -> one row per check, all from one pass."""
    checks = ", ".join(f"named_struct('check', '{check}', 'numerator', CAST(coalesce({num}, 0) AS BIGINT), "
                       f"'denominator', CAST(coalesce({den}, 0) AS BIGINT))" for check, (num, den) in measured.items())
    return df.agg(F.expr(f"array({checks}) AS checks")).selectExpr("inline(checks)")


def audit_scorecard(spark: SparkSession, profile: DataFrame, sessions: DataFrame, purchases: DataFrame,
                    pairs: DataFrame, coverage: DataFrame) -> DataFrame:
    """All checks: one pass over each source, and the event-level ones only over the per-day event counts."""
    def tally(column: str, *events: str) -> str:
        return f"sum({column}) FILTER (WHERE event_name IN ({', '.join(repr(e) for e in events)}))"

    event_checks = _long(profile, {
        "events_missing_session_id": ("sum(no_session)", "sum(n)"),
        "purchases_missing_transaction_id": (tally("n - with_id", "purchase"), tally("n", "purchase")),
        "purchases_without_revenue": (tally("n - with_revenue", "purchase"), tally("n", "purchase")),
        "ecommerce_events_without_items": (tally("n - with_items", *ECOMMERCE_EVENTS), tally("n", *ECOMMERCE_EVENTS)),
        "add_to_cart_with_many_products": (tally("many_items", "add_to_cart"), tally("n", "add_to_cart")),
        "searches_without_term": (tally("no_term", "view_search_results"), tally("n", "view_search_results")),
        "search_terms_obfuscated": (tally("placeholder_term", "view_search_results"), tally("n", "view_search_results")),
        "page_views_without_location": (tally("no_location", "page_view"), tally("n", "page_view")),
    })
    session_checks = _long(weighted(sessions), {
        "sessions_without_session_start": (sessions_sql("n_session_start = 0"), sessions_sql()),
        "sessions_with_repeated_session_start": (sessions_sql("n_session_start > 1"), sessions_sql()),
        "purchase_sessions_without_checkout": (
            sessions_sql("has_purchase AND NOT has_begin_checkout"), sessions_sql("has_purchase")),
    })
    purchase_checks = _long(purchases, {
        "duplicate_purchase_events": ("sum(n_repeats)", "sum(n_events)"),
    })
    pair_checks = _long(pairs, {
        "purchase_revenue_mismatch": ("sum(n_events) FILTER (WHERE abs(gap) > limit)", "sum(n_events)"),
    })
    plan_checks = _long(coverage, {
        "tracking_plan_fields_below_target": ("count_if(status <> 'pass')", "count(*)"),
    })
    measured = (event_checks.unionByName(session_checks).unionByName(purchase_checks)
                .unionByName(pair_checks).unionByName(plan_checks))
    return (measured.join(F.broadcast(_checks(spark)), "check")
            .selectExpr("check_order", "check", "question", "owner", "severity", "numerator", "denominator",
                        "try_divide(numerator, denominator) AS rate", "threshold")
            .selectExpr("*", "CASE WHEN denominator = 0 THEN 'n/a' WHEN threshold IS NULL THEN 'info' "
                        "WHEN rate > threshold THEN 'fail' ELSE 'pass' END AS status"))


def audit_failures(scorecard: DataFrame) -> DataFrame:
    """Failed checks, most severe first."""
    return (scorecard.where("status = 'fail'")
            .selectExpr("CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank", "check_order", "check",
                        "severity", "owner", "numerator", "denominator", "rate", "threshold")
            .orderBy("severity_rank", "check_order"))
