"""The full build: every mart and the results document, from one workspace."""
from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import one_row
from ..operators import journey, kpis, search, sessions, tracking, weekly

if TYPE_CHECKING:
    from .workspace import Workspace

# Mart -> the order of its rows; columns marked with * only carry that order and are dropped.
MARTS = {
    "audit_scorecard": ("*check_order",),
    "tracking_coverage": ("*plan_order",),
    "tracking_timeline": ("date",),
    "funnel": ("breakdown", "group", "step_order"),
    "search_strata": ("device_category", "user_type", "medium_group", "prior_purchaser"),
    "checkout_by_device": ("device_category",),
    "segments": ("*segment_order",),
    "daily_kpis": ("date",),
    "trading_windows": ("start", "window"),
}


def marts(ws: Workspace) -> dict[str, DataFrame]:
    return {
        "audit_scorecard": ws.scorecard,
        "tracking_coverage": ws.coverage,
        "tracking_timeline": ws.timeline,
        "funnel": ws.funnel,
        "search_strata": search.search_strata(ws.search_cells),
        "checkout_by_device": ws.checkout,
        "segments": journey.segments(ws.analysis_cells),
        "daily_kpis": ws.daily,
        "trading_windows": kpis.compare_windows(ws.daily, ws.tables.trading_windows, ws.gate, ws.window),
    }


def write_marts(frames: dict[str, DataFrame], out: str, csv: bool = False) -> None:
    """One sorted file per mart: same rows, same order on every run.

    Marts have a row per day, group or check; those by device hold as many rows as the data has device categories, which
    is what keeps one file enough.
    """
    for name, df in frames.items():
        keys = [k.lstrip("*") for k in MARTS[name]]
        rows = df.repartition(1).sortWithinPartitions(*keys).drop(*[k[1:] for k in MARTS[name] if k.startswith("*")])
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
        if csv:
            rows.write.mode("overwrite").csv(f"{out}/{name}_csv", header=True)


def results_document(ws: Workspace, written: dict[str, DataFrame]) -> DataFrame:
    """One row holding every result as JSON, undefined values as null. `written` are the stored marts."""
    def rows(df: DataFrame, *order: str) -> Column:
        """A small result table as an array, sorted if asked; every table here has a row per group, window or check."""
        struct = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
        listed = F.collect_list(struct([*order, *[c for c in df.columns if c not in order]]))
        return df.agg(F.array_sort(listed) if order else listed).scalar()

    def shares(column: str, source: DataFrame) -> Column:
        return rows(sessions.mix(source, column))

    def described(totals: DataFrame, source: DataFrame, countries: DataFrame) -> Column:
        return F.struct(one_row(totals).alias("totals"), shares("device_category", source).alias("device_mix"),
                        shares("country", countries).alias("country_mix"), shares("medium_group", source).alias("channel_mix"))

    summary = search.search_vs_intent(ws.search_cells)
    parts = {
        "overview": described(ws.overview, ws.cells, ws.country_days),
        "window": one_row(tracking.analysis_summary(ws.analysis_cells, ws.window, ws.gate)),
        "window_overview": described(ws.window_overview, ws.analysis_cells, ws.in_analysis(ws.country_days)),
        "orders": one_row(ws.order_summary),
        "revenue_gap": one_row(ws.revenue_gap),
        "held_weeks": rows(weekly.held_weeks(ws.gate), "week"),
        "audit": rows(written["audit_scorecard"]),
        "funnel_overall": rows(written["funnel"].where("breakdown = 'overall'")),
        "biggest_drop": one_row(journey.biggest_drop(written["funnel"])),
        "search": one_row(summary),
        "search_verdict": one_row(search.search_verdict(summary)),
        "follow_up": rows(ws.sizing, "metric_order", "relative_lift"),
        "checkout": one_row(journey.mobile_vs_desktop(written["checkout_by_device"])),
        "windows": rows(written["trading_windows"]),
        "segments": rows(written["segments"]),
    }
    document = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false", "pretty": "true"})
    return ws.spark.range(1).select(document.alias("value"))


def build(ws: Workspace, out: str, csv: bool = False) -> dict[str, DataFrame]:
    """Write all marts and `results.json` below `out`; the stored marts are returned."""
    write_marts(marts(ws), f"{out}/marts", csv)
    written = {name: ws.spark.read.parquet(f"{out}/marts/{name}") for name in MARTS}
    results_document(ws, written).coalesce(1).write.mode("overwrite").text(f"{out}/results.json")
    return written


def report(spark: SparkSession, marts_dir: str, week: str | None = None, every_week: bool = False) -> DataFrame:
    """The weekly report from the stored daily mart alone: one week, every week, or the latest full week."""
    totals = weekly.weekly_kpis(spark.read.parquet(f"{marts_dir}/daily_kpis"))
    table = weekly.weekly_report(totals, weekly.weekly_gate(totals))
    if every_week:
        return table
    chosen = F.lit(week) if week else weekly.latest_full_week(totals).scalar()
    return table.where(F.col("week") == chosen)
