import datetime as dt
import math

import pytest

from shoptrail.operators import journey, search

FLAGS = ["has_search", "has_view_item", "has_add_to_cart", "has_begin_checkout", "has_shipping", "has_payment", "has_purchase"]


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        """(device, user type, channel, prior, flags that are set) -> a session table."""
        out = []
        for i, (device, kind, channel, prior, on) in enumerate(rows):
            f = {c: c in on for c in FLAGS}
            nested = [all(f[x] for x in FLAGS[1:j]) for j in range(2, 8)]
            out.append((f"u{i}", dt.date(2020, 12, 1), device, kind, channel, prior, *f.values(), *nested, 10.0 if f["has_purchase"] else 0.0))
        names = ", ".join(f"{c} boolean" for c in FLAGS + ["f_view_item", "f_add_to_cart", "f_checkout", "f_shipping", "f_payment", "f_purchase"])
        return spark.createDataFrame(out, f"user_pseudo_id string, session_date date, device_category string, user_type string, "
                                     f"medium_group string, prior_purchaser boolean, {names}, revenue_usd double")
    return make


ALL = FLAGS[1:]
ROWS = ([("mobile", "new", "direct", False, ALL)] * 3 + [("desktop", "returning", "paid search", True, ["has_search", "has_view_item"])] * 5
        + [(None, "new", "direct", False, ["has_search", "has_view_item", "has_purchase"])] * 2 + [("desktop", "new", "direct", False, [])] * 4)


def test_funnel_is_nested_and_every_breakdown_totals_all_sessions(table):
    f = journey.funnel(table(ROWS)).collect()
    for breakdown in ("overall", "device", "visitor type", "channel"):
        assert sum(r.sessions for r in f if r.breakdown == breakdown and r.step_order == 0) == 14
    overall = sorted((r for r in f if r.breakdown == "overall"), key=lambda r: r.step_order)
    assert [r.sessions for r in overall] == [14, 10, 3, 3, 3, 3, 3] and {r.group for r in overall} == {"all sessions"}
    assert overall[0].rate_from_previous == 1.0 and overall[2].rate_from_previous == 0.3 and math.isclose(overall[6].rate_from_start, 3 / 14)
    assert {r.group for r in f if r.breakdown == "device"} == {"mobile", "desktop", None}


def test_zero_sessions_at_a_step_leave_later_rates_undefined(table):
    f = [r for r in journey.funnel(table([("mobile", "new", "direct", False, [])])).collect() if r.breakdown == "overall"]
    by = {r.step_order: r for r in f}
    assert by[1].rate_from_previous == 0.0 and by[2].rate_from_previous is None and by[2].rate_from_start == 0.0


def test_biggest_drop_takes_the_earlier_step_on_ties(table):
    half = table([("m", "new", "direct", False, ["has_view_item", "has_add_to_cart"])] + [("m", "new", "direct", False, ["has_view_item"])]
                 + [("m", "new", "direct", False, [])] * 2)
    d = journey.biggest_drop(journey.funnel(half)).first()
    assert (d.from_step, d.to_step, d.kept, d.sessions_before, d.sessions_after) == ("Added to basket", "Began checkout", 0.0, 1, 0)
    even = table([("m", "new", "direct", False, ["has_view_item", "has_add_to_cart", "has_begin_checkout", "has_shipping", "has_payment", "has_purchase"])]
                 + [("m", "new", "direct", False, [])])
    assert journey.biggest_drop(journey.funnel(even)).first().to_step == "Viewed products"


def test_automatic_steps_need_enough_sessions_and_skip_the_first_pair(table):
    assert journey.automatic_steps(journey.funnel(table(ROWS))).isEmpty()
    big = table([("m", "new", "direct", False, ["has_view_item", "has_add_to_cart"])] * 120 + [("m", "new", "direct", False, ["has_view_item"])])
    assert journey.automatic_steps(journey.funnel(big)).isEmpty()
    full = table([("m", "new", "direct", False, ["has_view_item", "has_add_to_cart", "has_begin_checkout", "has_shipping"])] * 120)
    got = journey.automatic_steps(journey.funnel(full)).collect()
    assert [(r.from_step, r.to_step, r.sessions) for r in got] == [
        ("Viewed products", "Added to basket", 120), ("Added to basket", "Began checkout", 120), ("Began checkout", "Added delivery details", 120)]


def test_untracked_orders(table):
    r = journey.untracked_orders(table(ROWS)).first()
    assert (r.ordering_sessions, r.funnel_sessions, r.missing_a_step, r.share_missing) == (5, 3, 2, 0.4)


def test_segments_overlap_and_empty_ones_still_appear(table):
    s = {r.segment: r for r in journey.segments(table(ROWS)).collect()}
    assert s["Searched"].sessions + s["Did not search"].sessions == s["All sessions"].sessions == 14
    assert s["Abandoned basket"].sessions == 0 and s["Abandoned basket"].purchasing_sessions == 0
    assert s["Abandoned basket"].conversion is None and s["Abandoned basket"].revenue_usd == 0.0 and s["Abandoned basket"].revenue_per_session is None
    assert s["New visitors on mobile"].sessions == 3 and s["Returning previous buyers"].sessions == 5
    assert s["All sessions"].revenue_usd == 50.0 and s["All sessions"].share_of_sessions == 1.0


def test_own_segment_rules(table):
    s = journey.segments(table(ROWS), (("Unknown device", "device_category IS NULL"),)).first()
    assert (s.segment, s.sessions) == ("Unknown device", 2)


def test_checkout_by_device_and_comparison(table):
    rows = [("mobile", "new", "d", False, ["has_begin_checkout"])] * 6 + [("mobile", "new", "d", False, ["has_begin_checkout", "has_purchase"])] * 4 \
        + [("desktop", "new", "d", False, ["has_begin_checkout", "has_shipping", "has_purchase"])] * 5 + [("desktop", "new", "d", False, ["has_begin_checkout"])] * 5
    c = journey.checkout_by_device(table(rows))
    by = {r.device_category: r for r in c.collect()}
    assert by["mobile"].purchased_rate == 0.4 and by["desktop"].added_delivery_rate == 0.5 and by["mobile"].completion_lo < 0.4 < by["mobile"].completion_hi
    m = journey.mobile_vs_desktop(c).first()
    assert (m.mobile, m.desktop, m.mobile_n, m.desktop_n) == (0.4, 0.5, 10, 10) and math.isclose(m["diff"], -0.1)
    assert journey.mobile_vs_desktop(c.where("device_category = 'mobile'")).isEmpty()


def test_strata_leave_out_unknown_devices_but_product_views_keep_them(table):
    cells = search.search_cells(table(ROWS))
    strata = search.search_strata(cells).collect()
    assert all(r.device_category for r in strata) and sum(r.n_search for r in strata) == 5
    s = search.search_vs_intent(cells).first()
    assert (s.search_sessions, s.other_sessions, s.enough) == (5, 7, False)
    assert s.product_view_rate_search == 1.0 and s.product_view_rate_other == 3 / 7
    assert s.coverage == 0.0 and s.strata_used == 0 and s.adjusted_diff is None and s.strata_total == 3
    v = search.search_verdict(search.search_vs_intent(cells)).first()
    assert v.verdict == "too few searches" and v.explained is None


@pytest.mark.parametrize("lo, hi, diff, naive, share, verdict, explained, gap", [
    (-0.1, 0.1, 0.0, 0.05, 1.0, "indistinguishable from zero", "all", None),
    (0.01, 0.05, 0.03, 0.02, -0.5, "positive difference remains", "none", "slightly larger"),
    (0.01, 0.05, 0.02, 0.02, 0.0, "positive difference remains", "none", "about the same"),
    (-0.05, -0.01, -0.03, -0.02, -0.5, "negative difference", None, None),
    (0.01, 0.05, 0.03, 0.06, 0.5, "positive difference remains", "part", None),
])
def test_verdicts(spark, lo, hi, diff, naive, share, verdict, explained, gap):
    df = spark.createDataFrame([(True, lo, hi, diff, naive, share)], "enough boolean, adjusted_lo double, adjusted_hi double, "
                               "adjusted_diff double, naive_diff double, share_explained double")
    v = search.search_verdict(df).first()
    assert (v.verdict, v.explained, v.like_for_like_gap) == (verdict, explained, gap)


def sizing_inputs(spark, rows):
    sessions = spark.createDataFrame(rows, "user_pseudo_id string, session_date date, has_search boolean, has_purchase boolean, has_view_item boolean")
    windows = spark.createDataFrame([("S", dt.date(2021, 1, 4), dt.date(2021, 1, 17), "sizing"), ("T", dt.date(2021, 1, 10), dt.date(2021, 1, 12), "sizing"),
                                     ("E", dt.date(2021, 1, 18), dt.date(2021, 1, 31), "event")], "window_name string, start_date date, end_date date, role string")
    return sessions, windows


def test_sizing_counts_users_once_per_week(spark):
    d1, d2, out = dt.date(2021, 1, 5), dt.date(2021, 1, 12), dt.date(2021, 1, 20)
    rows = []
    for i in range(40):
        rows += [(f"u{i}", d1, True, False, i < 16), (f"u{i}", d1, False, i < 4, False), (f"u{i}", d2, i < 20, False, False), (f"u{i}", out, True, True, True)]
    p = search.experiment_sizing(*sizing_inputs(spark, rows)).orderBy("metric_order", "relative_lift").collect()
    assert (p[0].searchers, p[0].buyers, p[0].sizing_weeks, p[0].weekly_searching_users) == (60, 4, 2, 30.0)
    assert len(p) == 6 and math.isclose(p[0].baseline, 4 / 60) and math.isclose(p[3].baseline, 16 / 60)
    for metric in (0, 1):
        sizes = [r.users_per_arm for r in p if r.metric_order == metric]
        assert sizes == sorted(sizes, reverse=True)
    assert all(r.weeks == math.ceil(2 * r.users_per_arm / 30) for r in p)
    m = search.primary_metric(search.experiment_sizing(*sizing_inputs(spark, rows))).first()
    assert m.primary_metric == search.SAW_PRODUCTS and m.weeks_saw_products < m.weeks_bought


def test_sizing_without_buyers_gives_no_plan(spark):
    plans = search.experiment_sizing(*sizing_inputs(spark, [("u", dt.date(2021, 1, 5), True, False, True)]))
    assert plans.isEmpty() and search.primary_metric(plans).first().primary_metric is None
