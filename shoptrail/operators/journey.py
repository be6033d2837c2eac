"""Funnel, checkout and segments over a session table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import exprs, sessions_sql, total_sql, weighted
from ..functions.stats import with_two_proportions, with_wilson

# Funnel step labels with their flag (the first step is every session).
STEPS = (("Started a visit", None), ("Viewed products", "f_view_item"), ("Added to basket", "f_add_to_cart"),
         ("Began checkout", "f_checkout"), ("Added delivery details", "f_shipping"),
         ("Added payment details", "f_payment"), ("Purchased", "f_purchase"))
BREAKDOWNS = (("overall", None), ("device", "device_category"), ("visitor type", "user_type"), ("channel", "medium_group"))

# Segment name and its rule on the session table. Segments overlap; add your own pairs freely.
SEGMENTS = (
    ("All sessions", "TRUE"),
    ("Searched", "has_search"),
    ("Did not search", "NOT has_search"),
    ("Viewed products, added nothing", "has_view_item AND NOT has_add_to_cart"),
    ("Abandoned basket", "has_add_to_cart AND NOT has_purchase"),
    ("Abandoned checkout", "has_begin_checkout AND NOT has_purchase"),
    ("New visitors on mobile", "user_type = 'new' AND device_category = 'mobile'"),
    ("Returning previous buyers", "prior_purchaser"),
    ("Paid search visitors", "medium_group = 'paid search'"),
)
MIN_AUTOMATIC = 100


def funnel(sessions: DataFrame) -> DataFrame:
    """Nested funnel, long form: breakdown x group x step.

    The sessions are reduced once to device x visitor type x channel; the breakdowns are grouping sets over that
    small result, so no session row is repeated. A NULL group stays NULL.
    """
    dims = [column for _, column in BREAKDOWNS if column]
    counts = {f"s{i}": sessions_sql(flag or "TRUE") for i, (_, flag) in enumerate(STEPS)}
    cells = weighted(sessions).groupBy(*dims).agg(*exprs(counts))
    sets = cells.groupingSets([[F.col(column)] if column else [] for _, column in BREAKDOWNS], *[F.col(d) for d in dims]).agg(
        *exprs({f"no_{d}": f"grouping({d})" for d in dims}), *exprs({c: f"sum({c})" for c in counts}))
    # grouping() tells a NULL group from a rolled-up column.
    own = [(label, column) for label, column in BREAKDOWNS if column]
    breakdown = " ".join(f"WHEN no_{column} = 0 THEN '{label}'" for label, column in own)
    group = " ".join(f"WHEN no_{column} = 0 THEN {column}" for _, column in own)
    labels = ", ".join(f"'{label}'" for label, _ in STEPS)
    rows = sets.where("s0 IS NOT NULL").selectExpr(
        f"CASE {breakdown} ELSE 'overall' END AS breakdown", f"CASE {group} ELSE 'all sessions' END AS `group`",
        f"array({', '.join(counts)}) AS reached", f"posexplode(array({', '.join(counts)})) AS (step_order, sessions)")
    return rows.selectExpr(
        "breakdown", "`group`", "step_order", f"array({labels})[step_order] AS step", "sessions",
        "try_divide(sessions, reached[0]) AS rate_from_start",
        "try_divide(sessions, reached[greatest(step_order - 1, 0)]) AS rate_from_previous")


def _overall(funnel: DataFrame) -> DataFrame:
    """The overall funnel as one row: an array of its seven steps in order."""
    return funnel.where("breakdown = 'overall'").agg(
        F.expr("array_sort(collect_list(struct(step_order, step, sessions, rate_from_previous))) AS steps"))


def biggest_drop(funnel: DataFrame) -> DataFrame:
    """The overall step that keeps the smallest share of the step before; the earlier one on ties."""
    worst = ("array_min(transform(filter(steps, s -> s.step_order > 0 AND s.rate_from_previous IS NOT NULL), "
             "s -> struct(s.rate_from_previous AS kept, s.step_order AS step_order)))")
    return (_overall(funnel).withColumn("worst", F.expr(worst)).where("worst IS NOT NULL")
            .selectExpr("worst.kept AS kept", "get(steps, worst.step_order - 1) AS b", "get(steps, worst.step_order) AS a")
            .selectExpr("b.step AS from_step", "a.step AS to_step", "kept", "b.sessions AS sessions_before",
                        "a.sessions AS sessions_after"))


def automatic_steps(funnel: DataFrame) -> DataFrame:
    """Neighbouring steps after the first with equal counts: the second is probably sent with the first."""
    return (_overall(funnel).selectExpr("steps", "explode(slice(steps, 2, size(steps) - 2)) AS b")
            .selectExpr("b", "get(steps, b.step_order + 1) AS a")
            .where(f"b.sessions >= {MIN_AUTOMATIC} AND a.sessions = b.sessions")
            .selectExpr("b.step AS from_step", "a.step AS to_step", "b.sessions AS sessions"))


def untracked_orders(sessions: DataFrame) -> DataFrame:
    """Ordering sessions that miss an earlier tracked step, so they count in conversion but not in the funnel."""
    return (weighted(sessions).agg(*exprs({"ordering_sessions": sessions_sql("has_purchase"), "funnel_sessions": sessions_sql("f_purchase")}))
            .selectExpr("*", "ordering_sessions - funnel_sessions AS missing_a_step")
            .selectExpr("*", "try_divide(missing_a_step, ordering_sessions) AS share_missing"))


def checkout_by_device(sessions: DataFrame) -> DataFrame:
    """Of the sessions that began checkout, how many took each later step, per device."""
    later = {"added_delivery": "has_shipping", "added_payment": "has_payment", "purchased": "has_purchase"}
    rows = (weighted(sessions).where("has_begin_checkout").groupBy("device_category")
            .agg(*exprs({"began_checkout": sessions_sql(), **{c: sessions_sql(flag) for c, flag in later.items()}})))
    return with_wilson(rows, "ci", "purchased", "began_checkout").selectExpr(
        "device_category", "began_checkout", *later, *[f"try_divide({c}, began_checkout) AS {c}_rate" for c in later],
        "ci.lo AS completion_lo", "ci.hi AS completion_hi")


def mobile_vs_desktop(checkout: DataFrame) -> DataFrame:
    """Checkout completion on mobile against desktop; no row unless both exist."""
    pick = lambda device, c: f"max({c}) FILTER (WHERE device_category = '{device}')"
    pair = checkout.agg(*exprs({"x1": pick("mobile", "purchased"), "n1": pick("mobile", "began_checkout"),
                                "x0": pick("desktop", "purchased"), "n0": pick("desktop", "began_checkout")}))
    return (with_two_proportions(pair, "t", "x1", "n1", "x0", "n0").where("t IS NOT NULL")
            .selectExpr("t.p1 AS mobile", "t.p0 AS desktop", "n1 AS mobile_n", "n0 AS desktop_n",
                        "t.diff", "t.lo", "t.hi", "t.p_value", "t.rel"))


def segments(sessions: DataFrame, rules=SEGMENTS) -> DataFrame:
    """Overlapping segments in one scan: every rule is a conditional aggregate, so empty segments still appear.

    Rules may use every column of the table given: those of the cells, or of the sessions for any other rule."""
    parts = [F.struct(F.lit(i).alias("segment_order"), F.lit(name).alias("segment"), F.lit(rule).alias("definition"), *exprs({
        "sessions": sessions_sql(rule),
        "purchasing_sessions": sessions_sql(f"({rule}) AND has_purchase"),
        "revenue_usd": total_sql(f"CASE WHEN {rule} THEN revenue_usd END"),
    })) for i, (name, rule) in enumerate(rules)]
    rows = (weighted(sessions).agg(F.expr(f"{sessions_sql()} AS total"), F.array(*parts).alias("parts"))
            .selectExpr("total", "inline(parts)"))
    return with_wilson(rows, "ci", "purchasing_sessions", "sessions").selectExpr(
        "segment_order", "segment", "definition", "sessions", "try_divide(sessions, total) AS share_of_sessions",
        "purchasing_sessions", "ci.p AS conversion", "ci.lo AS conversion_lo", "ci.hi AS conversion_hi", "revenue_usd",
        "try_divide(revenue_usd, sessions) AS revenue_per_session")
