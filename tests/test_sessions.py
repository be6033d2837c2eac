import datetime as dt
import random

from pyspark.sql import functions as F

from shoptrail.functions.skew import salted_join
from shoptrail.operators import orders, sessions


def build(events):
    return sessions.sessions(events, orders.purchases(events))


def test_first_touch_skips_nulls_and_counts_survive_slicing(make_events):
    late_day = dict(event_date=dt.date(2020, 12, 2))
    events = make_events([
        ("u", 1, 5, "session_start", dict(device_category=None, first_medium=None, country=None)),
        ("u", 1, 6, "page_view", dict(device_category="mobile", first_medium="cpc", country="FR", session_engaged="0")),
        ("u", 1, 7, "page_view", dict(device_category="desktop", first_medium="organic", country="DE", **late_day)),
        ("u", 1, 8, "view_search_results", dict(session_engaged="1", ga_session_number=3)),
        ("u", None, 1, "page_view", {}),
    ])
    r = build(events).first()
    assert (r.device_category, r.first_medium, r.country) == ("mobile", "cpc", "FR")
    assert r.session_date == dt.date(2020, 12, 1) and r.start_ts.second == 5
    assert (r.n_session_start, r.page_views, r.searches, r.ga_session_number) == (1, 2, 1, 1)
    assert r.engaged and r.is_engaged and r.has_search and r.medium_group == "paid search" and r.user_type == "new"


def test_unknowns(make_events):
    events = make_events([("u", 1, 5, "page_view", dict(device_category=None, first_medium=None, ga_session_number=None))])
    r = build(events).first()
    assert r.device_category is None and r.engaged is None and r.is_engaged is False
    assert r.user_type == "unknown" and r.medium_group == "other or unknown"


def test_funnel_flags_need_every_earlier_step(make_events):
    buy = dict(transaction_id="T", purchase_revenue_usd=1.0)
    events = make_events([("a", 1, i, e, buy if e == "purchase" else {}) for i, e in enumerate(
        ["view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info", "purchase"])]
        + [("b", 1, i, e, buy if e == "purchase" else {}) for i, e in enumerate(["view_item", "begin_checkout", "purchase"])])
    a, b = build(events).orderBy("user_pseudo_id").collect()
    assert a.f_purchase and b.has_purchase and not b.f_purchase and b.f_view_item and not b.f_checkout


def test_previous_buyer_only_looks_strictly_backwards(make_events):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        user = "hot" if i % 3 == 0 else f"u{rng.randint(1, 30)}"
        at = rng.randint(0, 50)
        rows.append((user, i, at, "page_view", {}))
        if rng.random() < 0.15:
            rows.append((user, i, at + 1, "purchase", dict(transaction_id=f"T{i}", purchase_revenue_usd=1.0)))
    got = build(make_events(rows)).collect()
    for s in got:
        expected = any(e.user_pseudo_id == s.user_pseudo_id and e.start_ts < s.start_ts and e.has_purchase for e in got)
        assert s.prior_purchaser == expected


def test_salted_join_equals_a_plain_join(spark):
    left = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k <> 4")
    for how in ("left", "inner"):
        a = salted_join(left, right, ["k"], ["id"], how=how).select("k", "id", "v")
        b = left.join(right, "k", how).select("k", "id", "v")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == b.count()


def test_mix_is_limited_to_the_largest_groups(spark):
    df = spark.createDataFrame([(c,) for c in "aaaabbbccddeefg"], "country string")
    rows = sessions.mix(df, "country").collect()
    assert [r.group for r in rows] == ["a", "b", "c", "d", "e"] and rows[0].share == 4 / 15


def test_events_without_a_time_do_not_name_the_first_touch(make_events):
    events = make_events([("u", 1, 0, "page_view", dict(country="XX", event_ts=None, device_category="tablet")),
                          ("u", 1, 9, "page_view", dict(country="FR", device_category=None)),
                          ("v", 2, 0, "page_view", dict(country="DE", event_ts=None))])
    table = sessions.sessions(events, orders.purchases(events))
    got = {r.user_pseudo_id: (r.country, r.device_category, r.session_date, r.start_ts) for r in table.collect()}
    assert got["u"][:2] == ("FR", None) and got["u"][2] is not None and got["v"] == (None, None, None, None)
