"""Weekly KPIs, the data-quality gate and the week-on-week report, all weeks in one pass over the daily table."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from ..functions.columns import exprs, iso_week, total_sql, week_start
from ..functions.stats import with_two_proportions, with_wilson

# Fixed values of the gate: points above the median of the trailing weeks that hold a week.
MAX_EMPTY_RISE = 0.10
MAX_MISSING_START_RISE = 0.05
TRAILING_WEEKS = 4

COUNTS = ("sessions", "purchasing_sessions", "orders", "search_sessions", "product_view_sessions", "basket_sessions",
          "checkout_sessions", "checkout_completed", "purchase_events", "purchases_missing_id", "empty_purchase_events",
          "repeat_purchase_events", "orders_without_id", "sessions_missing_start")


def _by_week() -> WindowSpec:
    """One row per week: the window holds the weeks of the calendar, whatever the size of the data."""
    return Window.orderBy("week_start")


def weekly_kpis(daily: DataFrame) -> DataFrame:
    return (daily.groupBy(week_start(F.col("date")).alias("week_start"))
            .agg(*exprs({
                **{c: f"sum({c})" for c in COUNTS},
                "revenue_usd": total_sql("revenue_usd"),
                "days": "count(*)",
                "first_day": "min(date)",
                "last_day": "max(date)",
                "journey_tracked": "every(journey_tracked)",
            }))
            .withColumn("week", iso_week(F.col("week_start"))))


def weekly_gate(weekly: DataFrame) -> DataFrame:
    """Hold a week that is materially worse than the median of the up to four weeks present before it."""
    history = f"(ORDER BY week_start ROWS BETWEEN {TRAILING_WEEKS} PRECEDING AND 1 PRECEDING)"
    return (weekly.selectExpr(
                "week", "week_start",
                "coalesce(try_divide(empty_purchase_events, purchase_events), 0D) AS empty_rate",
                "coalesce(try_divide(sessions_missing_start, sessions), 0D) AS missing_start_rate")
            .selectExpr(
                "*",
                f"coalesce(percentile(empty_rate, 0.5) OVER {history}, 0D) AS empty_baseline",
                f"coalesce(percentile(missing_start_rate, 0.5) OVER {history}, 0D) AS missing_start_baseline")
            .selectExpr(
                "*",
                f"empty_rate > empty_baseline + {MAX_EMPTY_RISE}D AS held_empty",
                f"missing_start_rate > missing_start_baseline + {MAX_MISSING_START_RISE}D AS held_missing_start")
            .selectExpr("*", "held_empty OR held_missing_start AS held"))


def held_weeks(gate: DataFrame) -> DataFrame:
    return gate.where("held").select("week")


def weekly_notes(weekly: DataFrame, gate: DataFrame) -> DataFrame:
    """Standing notes of each week; a count is NULL when its note does not apply."""
    return weekly.join(gate.select("week", "held"), "week").selectExpr(
        "week", "held",
        "nullif(orders_without_id, 0) AS orders_without_id",
        "nullif(repeat_purchase_events, 0) AS repeats_removed",
        "CASE WHEN NOT held THEN nullif(empty_purchase_events, 0) END AS empty_events_not_counted",
        "NOT journey_tracked AS journey_not_fully_tracked")


def latest_full_week(weekly: DataFrame) -> DataFrame:
    """The last week with seven days of data, or the last week when there is none."""
    return weekly.agg(F.expr(
        "coalesce(max_by(week, week_start) FILTER (WHERE days = 7), max_by(week, week_start)) AS week"))


# Report rows: metric, value of a week, how the change is stated.
REPORT = (
    ("Sessions", "CAST(sessions AS DOUBLE)", "relative"),
    ("Session conversion", "try_divide(purchasing_sessions, sessions)", "points"),
    ("Orders", "CAST(orders AS DOUBLE)", "relative"),
    ("Revenue (USD)", "revenue_usd", "relative"),
    ("Revenue per order", "try_divide(revenue_usd, orders)", "relative"),
    ("Sessions using search", "try_divide(search_sessions, sessions)", "points"),
    ("Sessions viewing products", "try_divide(product_view_sessions, sessions)", "points"),
    ("Sessions adding to basket", "try_divide(basket_sessions, sessions)", "points"),
    ("Checkout completion", "try_divide(checkout_completed, checkout_sessions)", "points"),
)


def weekly_report(weekly: DataFrame, gate: DataFrame) -> DataFrame:
    """Long form: one row per week and metric with the previous present week's value and the change.

    Conversion also has its Wilson interval and whether the change is significant at 5%.
    """
    values = F.expr("array({})".format(", ".join(
        f"named_struct('metric_order', {i}, 'metric', '{name}', 'current', {value}, 'change_kind', '{kind}')"
        for i, (name, value, kind) in enumerate(REPORT))))
    order = _by_week()
    weeks = (weekly.withColumn("values", values)
             .withColumn("previous_week", F.lag("week").over(order))
             .withColumn("before", F.lag("values").over(order))
             .withColumn("x0", F.lag("purchasing_sessions").over(order))
             .withColumn("n0", F.lag("sessions").over(order))
             .join(gate.select("week", "held"), "week"))
    weeks = with_wilson(weeks, "ci", "purchasing_sessions", "sessions")
    weeks = with_two_proportions(weeks, "test", "purchasing_sessions", "sessions", "x0", "n0")
    rows = (weeks.selectExpr("week", "previous_week", "held", "days", "ci", "test", "before", "inline(values)")
            .selectExpr("*", "before[metric_order].current AS previous"))
    conversion = "CASE WHEN metric = 'Session conversion' THEN"
    return rows.selectExpr(
        "week", "previous_week", "held", "days", "metric_order", "metric", "current", "previous",
        "CASE WHEN change_kind = 'points' THEN current - previous ELSE try_divide(current - previous, previous) END AS change",
        "change_kind", f"{conversion} ci.lo END AS interval_lo", f"{conversion} ci.hi END AS interval_hi",
        f"{conversion} test.p_value < 0.05 END AS significant")
