import datetime as dt

from pyspark.sql import functions as F

from shoptrail.contract import JOURNEY_EVENTS
from shoptrail.operators import tracking

FIRST = dt.date(2020, 11, 2)   # a Monday


def day(n):
    return FIRST + dt.timedelta(days=n)


def timeline(spark, n_days, missing):
    """Ten sessions and five of every journey event per day; `missing(event, n)` leaves one out."""
    sessions = spark.createDataFrame([(day(n),) for n in range(n_days) for _ in range(10)], "session_date date")
    rows = [(day(n), e, 5, 0, 5, 0, 5, 5, 0, 0, 0) for n in range(n_days) for e in JOURNEY_EVENTS if not missing(e, n)]
    profile = spark.createDataFrame(rows, "date date, event_name string, n long, no_session long, with_items long, "
                                    "many_items long, with_id long, with_revenue long, no_term long, placeholder_term long, no_location long")
    return tracking.tracking_timeline(sessions, profile)


def test_whole_period_when_everything_is_tracked(spark):
    t = timeline(spark, 14, lambda e, n: False)
    w = tracking.journey_window(t).first()
    assert (w.start, w.detected) == (FIRST, True)
    r = t.orderBy("date").first()
    assert r.view_item_per_100_sessions == 50.0 and r.purchases_with_id == 5 and r.checkouts_with_items == 5


def test_window_starts_when_a_missing_step_starts_firing(spark):
    t = timeline(spark, 20, lambda e, n: e == "add_to_cart" and n < 8)
    w = tracking.journey_window(t).first()
    assert w.detected and w.start == day(8)     # one of the three days to day 8 is a third of the rate: enough
    assert t.where((F.col("date") < day(8)) & F.col("in_journey_window")).isEmpty()
    assert t.where("date >= DATE '2020-11-10' AND NOT in_journey_window").isEmpty()


def test_a_single_quiet_day_is_tolerated_but_three_are_not(spark):
    quiet = tracking.journey_window(timeline(spark, 20, lambda e, n: e == "purchase" and n == 10)).first()
    assert quiet.start == FIRST
    gap = tracking.journey_window(timeline(spark, 20, lambda e, n: e == "purchase" and 8 <= n <= 10)).first()
    assert gap.start == day(11) and gap.detected


def test_not_detected_when_the_last_day_fails_or_an_event_never_fires(spark):
    for missing in (lambda e, n: e == "purchase" and n >= 17, lambda e, n: e == "view_item"):
        t = timeline(spark, 20, missing)
        w = tracking.journey_window(t).first()
        assert (w.start, w.detected) == (FIRST, False)
        assert t.where("in_journey_window").count() == 20


def test_held_weeks_and_days_before_the_window_leave_the_analysis(spark):
    daily = spark.createDataFrame([(day(n), n >= 3) for n in range(21)], "date date, journey_tracked boolean")
    gate = spark.createDataFrame([(day(7), "2020-W46", True), (day(0), "2020-W45", False)], "week_start date, week string, held boolean")
    days = tracking.analysis_days(daily, gate)
    assert sorted(r.date for r in days.collect()) == [day(n) for n in [3, 4, 5, 6, *range(14, 21)]]
    sessions = spark.createDataFrame([(day(n), n) for n in range(21)] + [(day(4), 99)], "session_date date, id long")
    kept = tracking.analysis_sessions(sessions, days)
    assert kept.count() == 12
    window = spark.createDataFrame([(day(3), True)], "start date, detected boolean")
    s = tracking.analysis_summary(kept, window, gate).first()
    assert (s.first_day, s.last_day, s.sessions, s.excluded_weeks) == (day(3), day(20), 12, "2020-W46")


def test_weekly_completeness_clips_the_first_week(spark):
    rows = [(dt.date(2020, 11, 1), 10, 0, 4, 0, 5, 1, 2), (dt.date(2020, 11, 2), 10, 2, 4, 0, 0, 1, 2), (dt.date(2020, 11, 8), 10, 4, 4, 0, 0, 1, 2)]
    t = spark.createDataFrame(rows, "date date, sessions long, purchases_with_id long, purchase long, checkouts_with_items long, "
                              "begin_checkout long, add_to_cart long, view_search_results long")
    a, b = tracking.weekly_completeness(t).orderBy("week_start").collect()
    assert a.week_start == dt.date(2020, 11, 1) and b.week_start == dt.date(2020, 11, 2)
    assert a.pct_purchases_with_id == 0 and a.pct_checkouts_with_items == 0.0
    assert b.pct_purchases_with_id == 75.0 and b.pct_checkouts_with_items is None and b.searches_per_100_sessions == 20.0


def test_profile_counts(make_events):
    events = make_events([
        ("u", None, 0, "page_view", dict(page_location="")), ("u", 1, 1, "page_view", dict(page_location="x")),
        ("u", 1, 2, "view_search_results", dict(search_term="<Other>")), ("u", 1, 2, "view_search_results", {}),
        ("u", 1, 3, "add_to_cart", dict(n_items=9)), ("u", 1, 3, "add_to_cart", dict(n_items=0)),
        ("u", 1, 4, "purchase", dict(transaction_id="T", purchase_revenue_usd=1.0)),
        ("u", 1, 4, "purchase", dict(transaction_id="(not set)", purchase_revenue_usd=0.0))])
    p = {r.event_name: r for r in tracking.event_profile(events).collect()}
    assert (p["page_view"].n, p["page_view"].no_session, p["page_view"].no_location) == (2, 1, 1)
    assert (p["view_search_results"].no_term, p["view_search_results"].placeholder_term) == (1, 1)
    assert (p["add_to_cart"].with_items, p["add_to_cart"].many_items) == (1, 1)
    assert (p["purchase"].with_id, p["purchase"].with_revenue) == (1, 1)
