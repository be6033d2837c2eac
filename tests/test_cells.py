"""Cells, country days and user bitmaps against the sessions they add up, and how often a build reads the sessions."""
import re

import pytest
from pyspark.sql import functions as F

from shoptrail.functions.earlier import earlier_exists
from shoptrail.operators import cells, journey, kpis, orders, search, sessions, tracking
from shoptrail.plans import build
from shoptrail.plans.stages import Stages
from shoptrail.plans.workspace import Workspace
from shoptrail.sources.inputs import from_driver_tables

from conftest import SF


def rows(df):
    return sorted(map(str, df.collect()))


def test_reports_of_cells_equal_those_of_sessions(ws):
    table, n = ws.sessions, ws.n_events
    small = cells.session_cells(table)
    bitmaps = ws.visitors
    assert small.agg(F.sum("n_sessions")).first()[0] == table.count() > small.count() / 2
    for of in (journey.funnel, journey.untracked_orders, journey.checkout_by_device, journey.segments, search.search_cells,
               lambda t: sessions.mix(t, "device_category"), lambda t: orders.order_summary(ws.purchases, t),
               lambda t: tracking.tracking_timeline(t, ws.profile)):
        assert rows(of(small)) == rows(of(table))
    assert rows(sessions.overview(small, n, bitmaps)) == rows(sessions.overview(table, n))
    daily = lambda t, *v: kpis.daily_kpis(t, ws.purchases, ws.tables.calendar, ws.timeline, *v)
    assert rows(daily(small, bitmaps)) == rows(daily(table))
    assert rows(sessions.mix(cells.country_days(table), "country")) == rows(sessions.mix(table, "country"))
    assert rows(search.experiment_sizing(cells.user_days(table), ws.tables.trading_windows)) == rows(search.experiment_sizing(table, ws.tables.trading_windows))


@pytest.mark.parametrize("users", (0, 3, 70_000))
def test_bitmaps_count_each_user_once(spark, users, monkeypatch):
    """More users than a bucket holds, on several days, with NULL users and days."""
    stages = Stages(spark)
    days = (spark.range(users).selectExpr("concat('u', id) AS user_pseudo_id", "explode(array_compact(array(DATE '2024-01-01', "
                                          "if(id % 2 = 0, DATE '2024-01-02', NULL), if(id % 3 = 0, DATE '2024-01-09', NULL)))) AS session_date")
            .unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS user_pseudo_id, DATE '2024-01-01' AS session_date UNION ALL SELECT 'late', NULL")))
    numbers = cells.user_numbers(days, stages.keep)
    assert numbers.agg(F.count("*"), F.count_distinct("user_number"), F.max("user_number")).first() == (users + 1,) * 3
    bitmaps = stages.keep(cells.visitor_bitmaps(days, numbers), "bitmaps")
    want = {str(r[0]): r[1] for r in days.where("user_pseudo_id IS NOT NULL").groupBy("session_date").agg(F.count_distinct("user_pseudo_id")).collect()}
    assert {str(r.date): r.users for r in cells.users_by_day(bitmaps).collect()} == want
    assert cells.distinct_users(bitmaps).first().users == users + 1
    weeks = {str(r.week_start): (r.users, r.days) for r in cells.users_by_week(bitmaps).collect()}
    assert weeks == ({"2024-01-01": (users, 2), "2024-01-08": ((users + 2) // 3, 1)} if users else {})
    stages.close()


def test_a_build_reads_the_sessions_three_times(spark, tmp_path):
    """Counted on the physical plans of everything a build runs."""
    stages = Stages(spark)
    ws = Workspace(spark, from_driver_tables(spark, SF, stages.keep), stages)
    ws.sessions
    seen = spark._jsparkSession.sharedState().statusStore()
    before = seen.executionsList().size()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        build.build(ws, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = seen.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    # an adaptive plan shows its scans twice, in the final and in the initial plan
    reads = sum(len(re.findall(r"Location: [^\n]*/sessions\]", p)) / (2 if "== Initial Plan ==" in p else 1) for p in plans)
    assert len(plans) > 20 and 1 <= reads <= 6, reads
    stages.close()


def test_trading_windows_are_compared(spark):
    """The baseline week is not held, so windows have differences and p-values."""
    import __spark_entry__ as registered
    for sf in ("sf0.001", "sf0.01"):
        path = SF.replace("sf0.001", sf)
        got = {r.window: r for r in registered.queries()["trading_windows"](spark, path).collect()}
        assert [r.week for r in registered.queries()["held_weeks"](spark, path).collect()] == ["2024-W03"]
        for name in ("Second week", "Month end"):
            row = got[name]
            assert None not in (row.conversion_change_pp, row.conversion_change_rel, row.conversion_p_value, row.checkout_completion_change_pp,
                                row.checkout_completion_p_value) and 0 < row.conversion_p_value < 1
        assert got["Incident week"].days == 0 and got["Incident week"].conversion_change_pp is None


def test_earlier_exists_spreads_a_hot_key(spark):
    stages = Stages(spark)
    left = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('u', id % 900)) AS k", "if(id % 50 = 7, NULL, id % 1000) AS t")
    right = spark.range(2_000).selectExpr("if(id % 3 = 0, 'hot', concat('u', id)) AS k", "if(id % 9 = 0, NULL, (id * 7) % 1000 + 300) AS t")
    left = left.unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS STRING) AS k, 5L AS t"))
    got = earlier_exists(left, right, "k", "t", "met", stages.keep, parts=40)
    first = right.groupBy("k").agg(F.min("t").alias("first"))
    want = left.join(first, "k", "left").select("id", F.coalesce(F.col("t") > F.col("first"), F.lit(False)).alias("met"))
    assert sorted(map(tuple, got.select("id", "met").collect())) == sorted(map(tuple, want.collect()))
    merged = stages._kept["met_ranges"]
    counts = [r["count"] for r in merged.groupBy("k", "part").count().collect()]
    assert max(counts) < 0.1 * merged.count()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    stages.close()


def test_written_tables_are_pruned_by_days_known_at_run_time(spark, ws):
    df = tracking.analysis_event_counts(ws.stored.events, ws.daily, ws.gate)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert df.count() == 11
