"""When can tracking be trusted: daily event rates, the journey window and the sessions analyses may use."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..contract import JOURNEY_EVENTS, PLACEHOLDERS, valid_id

from ..functions.columns import exprs, one_row, ratio, sessions_sql, week_start, weighted

# An event counts as tracked on a day when its rate over the three days to that day is at least this share of typical.
TRACKED_SHARE = 0.25
MANY_PRODUCTS = 5


def event_profile(events: DataFrame) -> DataFrame:
    """Per day and event name: every count the timeline, the audit and the coverage table need, in one scan."""
    return events.groupBy(F.col("event_date").alias("date"), "event_name").agg(*exprs({
        "n": "count(*)",
        "no_session": "count_if(ga_session_id IS NULL)",
        "with_items": "count_if(n_items > 0)",
        "many_items": f"count_if(n_items > {MANY_PRODUCTS})",
        "with_id": f"count_if({valid_id('transaction_id')})",
        "with_revenue": "count_if(purchase_revenue_usd > 0)",
        "no_term": "count_if(coalesce(search_term, '') = '')",
        "placeholder_term": f"count_if(search_term IN ({', '.join(repr(p) for p in PLACEHOLDERS)}))",
        "no_location": "count_if(coalesce(page_location, '') = '')",
    }))


def tracking_timeline(sessions: DataFrame, profile: DataFrame) -> DataFrame:
    """Per day with sessions: journey events, their rates, whether all are tracked, and the journey window."""
    name = F.col("event_name")
    per_day = profile.groupBy("date").agg(
        *[F.expr(f"sum(n) FILTER (WHERE event_name = '{e}')").alias(e) for e in JOURNEY_EVENTS],
        F.sum(F.when(name == "purchase", F.col("with_id"))).alias("purchases_with_id"),
        F.sum(F.when(name == "begin_checkout", F.col("with_items"))).alias("checkouts_with_items"))
    counts = [*JOURNEY_EVENTS, "purchases_with_id", "checkouts_with_items"]
    days = (weighted(sessions).groupBy(F.col("session_date").alias("date")).agg(F.sum("n_sessions").alias("sessions"))
            .join(per_day, "date", "left").fillna(0, counts))
    # One row per day: the unpartitioned windows below hold the calendar, not the data. Both count days present.
    last_3, all_days = "(ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", Window.partitionBy()
    rolling = {f"rate_{e}": F.expr(f"try_divide(sum({e}) OVER {last_3}, sum(sessions) OVER {last_3})") for e in JOURNEY_EVENTS}
    typical = {f"typical_{e}": F.expr(f"percentile(rate_{e}, 0.5) OVER ()") for e in JOURNEY_EVENTS}
    tracked = F.expr(" AND ".join(
        f"typical_{e} > 0 AND rate_{e} >= {TRACKED_SHARE} * typical_{e}" for e in JOURNEY_EVENTS))
    last_failing = F.max(F.when(~F.col("all_journey_events_tracked"), F.col("date"))).over(all_days)
    in_last_run = F.col("last_failing").isNull() | (F.col("date") > F.col("last_failing"))
    return (days.withColumns(rolling).withColumns(typical)
            .withColumn("all_journey_events_tracked", tracked)
            .withColumn("last_failing", last_failing)
            .withColumn("run_start", F.min(F.when(in_last_run, F.col("date"))).over(all_days))
            .withColumn("in_journey_window", F.coalesce(F.col("date") >= F.col("run_start"), F.lit(True)))
            .select("date", "sessions", *counts,
                    *[F.expr(f"try_divide(100D * {e}, sessions)").alias(f"{e}_per_100_sessions") for e in JOURNEY_EVENTS],
                    "all_journey_events_tracked", "in_journey_window"))


def journey_window(timeline: DataFrame) -> DataFrame:
    """One row: first day of the final unbroken run of tracked days, or the first day when the last day fails."""
    return timeline.agg(
        F.min(F.when(F.col("in_journey_window"), F.col("date"))).alias("start"),
        F.max_by("all_journey_events_tracked", "date").alias("detected"))


def analysis_days(daily: DataFrame, gate: DataFrame) -> DataFrame:
    """Days analyses may use: inside the journey window and not in a held week. One row per day."""
    return (daily.where("journey_tracked").withColumn("week_start", week_start(F.col("date")))
            .join(gate.where("held").select("week_start"), "week_start", "left_anti").select("date"))


def analysis_sessions(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """Sessions on the given days. The day list is one row per calendar day, so it is always small enough to broadcast."""
    return sessions.join(F.broadcast(days.withColumnRenamed("date", "session_date")), "session_date", "left_semi")


def analysis_event_counts(events: DataFrame, daily: DataFrame, gate: DataFrame) -> DataFrame:
    """Per event name: events and days in the analysis window. From a table stored by day only the window's days are read: its day
    list, known when the query runs, prunes the partitions."""
    days = (daily.where("journey_tracked AND sessions > 0").withColumn("week_start", week_start(F.col("date")))
            .join(F.broadcast(gate.where("held").select("week_start")), "week_start", "left_anti").select(F.col("date").alias("event_date")))
    return (events.join(F.broadcast(days), "event_date", "left_semi").groupBy("event_name")
            .agg(*exprs({"events": "count(*)", "days": "count(DISTINCT event_date)", "no_session": "count_if(ga_session_id IS NULL)"})))


def analysis_summary(analysis: DataFrame, window: DataFrame, gate: DataFrame) -> DataFrame:
    """One row describing the analysis window."""
    held = gate.where("held").agg(F.array_join(F.array_sort(F.collect_list("week")), ", ").alias("weeks"))
    return (weighted(analysis).agg(F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"),
                                   F.expr(sessions_sql()).alias("sessions"))
            .withColumn("w", one_row(window)).withColumn("excluded_weeks", held.scalar())
            .select("w.start", "w.detected", "first_day", "last_day", "sessions", "excluded_weeks"))


def weekly_completeness(timeline: DataFrame) -> DataFrame:
    """Per week, never starting before the data does: identified purchases, itemised checkouts, events firing."""
    # One row per day, so the unpartitioned window finding the first one is small.
    week = F.greatest(week_start(F.col("date")), F.min("date").over(Window.partitionBy()))
    per_100 = lambda num, den: ratio(100 * F.sum(num), F.sum(den))
    return (timeline.withColumn("week_start", week).groupBy("week_start").agg(
        per_100("purchases_with_id", "purchase").alias("pct_purchases_with_id"),
        per_100("checkouts_with_items", "begin_checkout").alias("pct_checkouts_with_items"),
        per_100("add_to_cart", "sessions").alias("add_to_cart_per_100_sessions"),
        per_100("view_search_results", "sessions").alias("searches_per_100_sessions")))
