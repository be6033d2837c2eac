import json

import pytest

from shoptrail.plans import build
from shoptrail.plans.stages import Stages
from shoptrail.plans.workspace import Workspace
from shoptrail.sources.inputs import from_driver_tables

from conftest import SF


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    dirs = []
    for _ in range(2):
        out = str(tmp_path_factory.mktemp("build"))
        stages = Stages(spark)
        build.build(Workspace(spark, from_driver_tables(spark, SF, stages.keep), stages), out, csv=True)
        dirs.append(out)
    return dirs


def test_two_builds_give_the_same_rows_in_the_same_order(spark, outputs):
    for name in build.MARTS:
        a, b = (spark.read.parquet(f"{out}/marts/{name}") for out in outputs)
        assert a.schema == b.schema and a.collect() == b.collect() and a.count() > 0, name
        assert spark.read.text(f"{outputs[0]}/marts/{name}_csv").collect() == spark.read.text(f"{outputs[1]}/marts/{name}_csv").collect()
    assert spark.read.text(f"{outputs[0]}/results.json").collect() == spark.read.text(f"{outputs[1]}/results.json").collect()


def test_mart_shapes(spark, outputs):
    columns = {n: spark.read.parquet(f"{outputs[0]}/marts/{n}").columns for n in build.MARTS}
    assert columns["audit_scorecard"] == "check question owner severity numerator denominator rate threshold status".split()
    assert columns["tracking_coverage"] == "stage event field source n_ok n_events coverage target status".split()
    assert columns["funnel"] == "breakdown group step_order step sessions rate_from_start rate_from_previous".split()
    assert columns["segments"] == ("segment definition sessions share_of_sessions purchasing_sessions conversion conversion_lo conversion_hi "
                                   "revenue_usd revenue_per_session").split()
    assert columns["daily_kpis"] == ("date sessions users purchasing_sessions orders revenue_usd search_sessions product_view_sessions "
                                     "basket_sessions checkout_sessions checkout_completed sessions_missing_start purchase_events "
                                     "purchases_missing_id empty_purchase_events repeat_purchase_events orders_without_id calendar_label "
                                     "conversion checkout_completion search_share journey_tracked").split()
    assert len(columns["tracking_timeline"]) == 20 and len(columns["trading_windows"]) == 17


def test_results_document(spark, outputs):
    text = "\n".join(r.value for r in spark.read.text(f"{outputs[0]}/results.json").collect())
    doc = json.loads(text)
    assert {"overview", "window", "window_overview", "orders", "revenue_gap", "held_weeks", "audit", "funnel_overall", "biggest_drop",
            "search", "follow_up", "checkout", "windows", "segments"} <= set(doc)
    assert doc["overview"]["totals"]["sessions"] == 401 and len(doc["audit"]) == 14 and len(doc["segments"]) == 9
    assert doc["held_weeks"] == [{"week": "2024-W03"}] and doc["window"]["start"] == "2024-01-05"
    baseline = next(w for w in doc["windows"] if w["role"] == "baseline")
    assert baseline["checkout_completion"] is None


def test_weekly_report_reads_only_the_daily_mart(spark, outputs):
    marts = f"{outputs[0]}/marts"
    everything = build.report(spark, marts, every_week=True)
    assert everything.select("week").distinct().count() == 5
    assert {r.week for r in build.report(spark, marts).collect()} == {"2024-W04"}
    held = build.report(spark, marts, week="2024-W03").collect()
    assert len(held) == 9 and all(r.held and r.previous_week == "2024-W02" for r in held)
