"""Sessions kept as stored partial states, so that a day that is run again costs its own events and the sessions it touches.

Below one root, switched all at once by the manifest of its day tables:

    slices            events of a session that agree on day, device, country and medium, merged (a state per session and day)
    purchase_events   the columns of purchases that orders need
    sessions          slices merged to one row per session, stored by the day the session began, with the days it reaches over

A run writes the slices of its days, takes the sessions that had or have a slice there, merges those again from the days they reach
over (other days are not read), and rewrites only the days on which one of them began or begins. Orders and first-order times
depend on purchases alone and are joined when sessions are read: an order that moves to another day moves everywhere.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import orders, sessions
from ..sources.days import DayTables
from .stages import Stages

NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder of a NULL day


class SessionState:
    def __init__(self, spark: SparkSession, root: str, stages: Stages | None = None):
        self.spark, self.store = spark, DayTables(spark, root)
        self.stages = stages or Stages(spark)

    def _read(self, table: str, days: dict[str, str]) -> DataFrame | None:
        if not days:
            return None
        base = f"{self.store.root}/{table}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/event_date={d}/attempt={r}" for d, r in sorted(days.items())]).drop("attempt")

    def update(self, events: DataFrame, first: dt.date, last: dt.date) -> None:
        """Replaces the days from first to last by these events of theirs."""
        days = {(first + dt.timedelta(days=i)).isoformat() for i in range((last - first).days + 1)}
        given = events.where(F.col("event_date").between(F.lit(first), F.lit(last)))
        run = uuid.uuid4().hex
        version, now = self.store.current()
        old = {t: now.get(t, {}) for t in ("slices", "purchase_events", "sessions")}
        pick = lambda table, wanted: {d: r for d, r in table.items() if d in wanted}
        keep = lambda df, name: self.stages.keep(df, f"{name}_{run}")

        def replaced(table: str, rows: DataFrame) -> dict[str, str]:
            written = self.store.write(table, rows, run)
            return {d: r for d, r in old[table].items() if d not in days} | dict.fromkeys(written, run)
        slices = replaced("slices", sessions.slices(given))
        bought = replaced("purchase_events", given.where("event_name = 'purchase'").select(*orders.PURCHASE_KEY, "event_name"))

        keys = list(sessions.SESSION_KEY)
        changed = [t.select(*keys) for t in (self._read("slices", pick(old["slices"], days)), self._read("slices", pick(slices, days))) if t is not None]
        tables = {"slices": slices, "purchase_events": bought, "sessions": old["sessions"]}
        if changed:
            touched = keep((changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])).distinct(), "touched")
            before = self._read("sessions", old["sessions"])
            was = None if before is None else keep(before.join(touched, keys, "left_semi").select("first_day", "last_day", "session_date"), "was")
            # Days of a calendar: those the touched sessions reached over, and those that are run.
            reach = days | (set() if was is None else {
                r[0].isoformat() for r in was.select(F.explode(F.sequence("first_day", "last_day")).alias("d")).distinct().collect()})
            parts = self._read("slices", pick(slices, reach))
            merged = parts and keep(sessions.merge_slices(parts.join(touched, keys, "left_semi")), "merged")
            begins = set()
            for t in (was, merged):
                begins |= set() if t is None else {NO_DAY if r[0] is None else r[0].isoformat() for r in t.select("session_date").distinct().collect()}
            rest = self._read("sessions", pick(old["sessions"], begins))
            rest = rest and rest.drop("event_date").join(touched, keys, "left_anti")
            rows = merged if rest is None else rest if merged is None else rest.unionByName(merged)
            written = [] if rows is None else self.store.write("sessions", rows.withColumn("event_date", F.col("session_date")), run, by="user_pseudo_id")
            tables["sessions"] = {d: r for d, r in old["sessions"].items() if d not in begins} | dict.fromkeys(written, run)
        self.store.switch(version, tables)
        self.store.retire()

    def sessions(self) -> DataFrame:
        """The session table of all stored days."""
        _, now = self.store.current()
        stored = self._read("sessions", now.get("sessions", {}))
        if stored is None:
            raise ValueError(f"{self.store.root} holds no sessions yet")
        sent = self._read("purchase_events", now["purchase_events"])
        sent = stored.sparkSession.createDataFrame([], "event_name string, " + ", ".join(
            f"{c} {k}" for c, k in (("user_pseudo_id", "string"), ("ga_session_id", "long"), ("event_ts", "timestamp"), ("event_date", "date"),
                                    ("transaction_id", "string"), ("purchase_revenue_usd", "double")))) if sent is None else sent
        version = self.store.current()[0]
        bought = orders.purchases(sent, lambda df: self.stages.keep(df, f"purchase_rows_{self.store.root}_{version}".replace("/", "_").replace(":", "_")))
        core = sessions.with_orders(stored.drop("event_date", "first_day", "last_day"), bought)
        return sessions.with_journey(core)
