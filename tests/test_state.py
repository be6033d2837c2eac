"""Stored session states against a full rebuild."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoptrail.operators import orders, sessions
from shoptrail.plans.state import SessionState
from shoptrail.sources.days import DayTables

DAY = dt.date(2020, 12, 1)
HOURS = 3600


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def rebuilt(events):
    return rows_of(sessions.sessions(events, orders.purchases(events)))


@pytest.fixture
def dated(make_events):
    """(user, session, day, hours, name, extra) rows."""
    def make(rows):
        return make_events([(u, s, 24 * HOURS * d + h * HOURS, n, {"event_date": DAY + dt.timedelta(days=d)} | x) for u, s, d, h, n, x in rows])
    return make


BASE = [("a", 1, 0, 23, "page_view", {"country": "FR"}), ("a", 1, 1, 0, "purchase", {"transaction_id": "T1", "purchase_revenue_usd": 5.0}),
        ("a", 2, 2, 5, "page_view", {}), ("b", 1, 1, 3, "view_item", {"device_category": "mobile"}), ("b", 1, 1, 4, "purchase", {"transaction_id": "T2", "purchase_revenue_usd": 7.0}),
        ("b", 2, 3, 4, "purchase", {"transaction_id": "T2", "purchase_revenue_usd": 7.0}), ("c", 9, 3, 1, "session_start", {}), ("c", None, 3, 1, "page_view", {})]


def test_days_run_again_equal_a_full_rebuild(spark, dated, tmp_path):
    """A session over midnight loses its first or its last day, begins on another day, goes or comes; an order moves to its repeat."""
    state = SessionState(spark, str(tmp_path / "state"))
    state.update(dated(BASE), DAY, DAY + dt.timedelta(days=4))
    assert rows_of(state.sessions()) == rebuilt(dated(BASE))
    now = list(BASE)
    changes = [(0, [("a", 1, 0, 22, "add_to_cart", {"country": "DE"})]), (0, []), (1, [("b", 1, 1, 9, "page_view", {"first_medium": "cpc"}), ("d", 4, 1, 2, "page_view", {})]),
               (3, []), (0, [("a", 1, 0, 23, "page_view", {"country": "FR"})]), (4, [("e", 1, 4, 1, "purchase", {"purchase_revenue_usd": 1.0})])]
    for day, rows in changes:
        now = [r for r in now if r[2] != day] + rows
        state.update(dated(rows), DAY + dt.timedelta(days=day), DAY + dt.timedelta(days=day))
        assert rows_of(state.sessions()) == rebuilt(dated(now)), day


def test_only_touched_days_are_written_again(spark, dated, tmp_path):
    root = str(tmp_path / "state")
    state = SessionState(spark, root)
    state.update(dated(BASE), DAY, DAY + dt.timedelta(days=4))
    before = DayTables(spark, root).current()[1]["sessions"]
    state.update(dated([("b", 2, 3, 4, "page_view", {})]), DAY + dt.timedelta(days=3), DAY + dt.timedelta(days=3))
    after = DayTables(spark, root).current()[1]["sessions"]
    assert {d for d in before if after.get(d) != before[d]} == {"2020-12-04"} and after["2020-12-01"] == before["2020-12-01"]


def test_a_run_that_dies_leaves_the_old_state(spark, dated, tmp_path, monkeypatch):
    state = SessionState(spark, str(tmp_path / "state"))
    state.update(dated(BASE), DAY, DAY + dt.timedelta(days=4))
    write = DayTables.write

    def dies(self, table, *args, **more):
        if table == "sessions":
            raise RuntimeError("lost")
        return write(self, table, *args, **more)
    monkeypatch.setattr(DayTables, "write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        state.update(dated([]), DAY, DAY)
    monkeypatch.undo()
    assert rows_of(state.sessions()) == rebuilt(dated(BASE))


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(ValueError, match="no sessions"):
        SessionState(spark, str(tmp_path / "none")).sessions()
