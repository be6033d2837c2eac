"""The shared tables of one export and the order they depend on each other."""
from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, cells, journey, kpis, orders, search, sessions, tracking, weekly
from ..sources.days import resolve
from ..sources.inputs import FlatInputs
from . import build
from .extract import extract
from .stages import Stages
from .state import SessionState


def use_utc(spark: SparkSession) -> None:
    """Days and timestamps are UTC throughout; expressions take the zone when they are built, so set it first."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def state_days(events: DataFrame) -> tuple[dt.date, dt.date, dt.date]:
    """The first and last day of the events, and a day in between."""
    first, last = events.agg(F.min("event_date"), F.max("event_date")).first()
    return first, last, first + dt.timedelta(days=(last - first).days // 3)


class Workspace:
    """Shared tables over the flat inputs, each built on first use and stored as a stage table.

    `tables` is any object with `events`, `items`, `inventory`, `calendar` and `trading_windows` frames.
    """

    def __init__(self, spark: SparkSession, tables, stages: Stages | None = None):
        self.spark, self.tables = spark, tables
        self.stages = stages or Stages(spark)
        use_utc(spark)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.stages.keep(df, name)

    @cached_property
    def purchases(self) -> DataFrame:
        return self._keep(orders.purchases(
            self.tables.events, lambda df: self._keep(df, "purchase_rows")), "purchases")

    @cached_property
    def session_core(self) -> DataFrame:
        return self._keep(sessions.session_core(self.tables.events, self.purchases), "session_core")

    @cached_property
    def sessions(self) -> DataFrame:
        return self._keep(sessions.with_journey(self.session_core), "sessions")

    @cached_property
    def cells(self) -> DataFrame:
        """Sessions added up by day and every attribute the reports use."""
        return self._keep(cells.session_cells(self.sessions), "session_cells")

    @cached_property
    def country_days(self) -> DataFrame:
        return self._keep(cells.country_days(self.sessions), "country_days")

    @cached_property
    def user_days(self) -> DataFrame:
        return self._keep(cells.user_days(self.sessions), "user_days")

    @cached_property
    def visitors(self) -> DataFrame:
        """The users of each day as bitmaps."""
        return self._keep(cells.visitor_bitmaps(self.user_days, cells.user_numbers(self.user_days, self._keep)), "visitor_bitmaps")

    @cached_property
    def profile(self) -> DataFrame:
        """Event counts per day and name; the only event scan the timeline, audit and coverage need."""
        return self._keep(tracking.event_profile(self.tables.events), "event_profile")

    @cached_property
    def timeline(self) -> DataFrame:
        return self._keep(tracking.tracking_timeline(self.cells, self.profile), "timeline")

    @cached_property
    def daily(self) -> DataFrame:
        return self._keep(
            kpis.daily_kpis(self.cells, self.purchases, self.tables.calendar, self.timeline, self.visitors), "daily_kpis")

    @cached_property
    def weekly(self) -> DataFrame:
        return self._keep(weekly.weekly_kpis(self.daily), "weekly_kpis")

    @cached_property
    def gate(self) -> DataFrame:
        return self._keep(weekly.weekly_gate(self.weekly), "weekly_gate")

    @cached_property
    def window(self) -> DataFrame:
        return self._keep(tracking.journey_window(self.timeline), "journey_window")

    @cached_property
    def analysis_days(self) -> DataFrame:
        return self._keep(tracking.analysis_days(self.daily, self.gate), "analysis_days")

    @property
    def analysis(self) -> DataFrame:
        """Sessions inside the journey window and outside held weeks."""
        return tracking.analysis_sessions(self.sessions, self.analysis_days)

    def in_analysis(self, table: DataFrame) -> DataFrame:
        """The rows of a table by session day that analyses may use."""
        return tracking.analysis_sessions(table, self.analysis_days)

    @property
    def analysis_cells(self) -> DataFrame:
        return self.in_analysis(self.cells)

    @cached_property
    def stored(self) -> FlatInputs:
        """The flat tables as the daily extraction writes them, read back through their manifest. Needs a workspace on an export."""
        raw = f"{self.stages.root}/raw"
        if not resolve(self.spark, f"{raw}/events"):
            extract(self.tables.nested, raw)
        return FlatInputs(self.spark, raw, f"{self.stages.root}/reference")

    @cached_property
    def drifted(self) -> str:
        """The folder of an events table whose writers disagreed: every third day lacks a column, every third has one as a text."""
        folder = f"{self.stages.root}/drifted/events"
        kind = F.pmod(F.datediff("event_date", F.lit("1970-01-01").cast("date")), F.lit(3))
        for k, change in enumerate((lambda t: t, lambda t: t.drop("country"), lambda t: t.withColumn("n_items", F.col("n_items").cast("string")))):
            change(self.tables.events.where(kind == k)).repartition("event_date").write.mode("append").partitionBy("event_date").parquet(folder)
        return folder

    @cached_property
    def state(self) -> SessionState:
        """Sessions as stored states: all days loaded with a week lacking its purchases and every third user, and that week run again."""
        state = SessionState(self.spark, f"{self.stages.root}/state", self.stages)
        if not state.store.versions():
            first, last, again = state_days(self.tables.events)
            week = F.col("event_date").between(F.lit(again), F.lit(again + dt.timedelta(days=6)))
            state.update(self.tables.events.where(~(week & F.expr("event_name = 'purchase' OR crc32(user_pseudo_id) % 3 = 0"))), first, last)
            state.update(self.tables.events, again, again + dt.timedelta(days=6))
        return state

    @cached_property
    def document(self) -> DataFrame:
        """The results document of the build, written and read back."""
        out = f"{self.stages.root}/build"
        build.build(self, out)
        return self.spark.read.text(f"{out}/results.json", wholetext=True)

    @cached_property
    def pairs(self) -> DataFrame:
        return self._keep(audit.revenue_pairs(self.purchases, self.tables.items), "revenue_pairs")

    @cached_property
    def coverage(self) -> DataFrame:
        return self._keep(audit.tracking_coverage(self.spark, self.profile, self.tables.inventory), "tracking_coverage")

    @cached_property
    def scorecard(self) -> DataFrame:
        return self._keep(audit.audit_scorecard(
            self.spark, self.profile, self.cells, self.purchases, self.pairs, self.coverage), "audit_scorecard")

    @cached_property
    def revenue_gap(self) -> DataFrame:
        return self._keep(audit.revenue_gap(self.pairs, self._keep), "revenue_gap")

    @cached_property
    def overview(self) -> DataFrame:
        return self._keep(sessions.overview(self.cells, self.n_events, self.visitors), "overview")

    @cached_property
    def window_overview(self) -> DataFrame:
        return self._keep(sessions.overview(self.analysis_cells, self.n_events, self.in_analysis(self.visitors)), "window_overview")

    @cached_property
    def order_summary(self) -> DataFrame:
        return self._keep(orders.order_summary(self.purchases, self.analysis_cells), "order_summary")

    @cached_property
    def funnel(self) -> DataFrame:
        return self._keep(journey.funnel(self.analysis_cells), "funnel")

    @cached_property
    def search_cells(self) -> DataFrame:
        return self._keep(search.search_cells(self.analysis_cells), "search_cells")

    @cached_property
    def checkout(self) -> DataFrame:
        return self._keep(journey.checkout_by_device(self.analysis_cells), "checkout_by_device")

    @cached_property
    def sizing(self) -> DataFrame:
        return self._keep(search.experiment_sizing(self.in_analysis(self.user_days), self.tables.trading_windows), "experiment_sizing")

    @property
    def n_events(self) -> DataFrame:
        return self.profile.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
