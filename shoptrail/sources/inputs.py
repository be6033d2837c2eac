"""Where the flat inputs of a workspace come from."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..contract import EVENTS, INVENTORY, ITEMS
from . import driver_tables, export, tables


class ExportInputs:
    """Flat tables flattened from a nested export. `keep(df, name)` stores what more than one reader needs.

    The export itself is read where it is; `nested` may be a function that makes it when it is first asked for."""

    def __init__(self, nested: DataFrame | Callable[[], DataFrame], calendar: DataFrame, trading_windows: DataFrame, keep):
        self._nested, self._keep = nested, keep
        self.calendar, self.trading_windows = tables.unique_dates(calendar), trading_windows

    @cached_property
    def nested(self) -> DataFrame:
        return self._nested() if callable(self._nested) else self._nested

    @cached_property
    def events(self) -> DataFrame:
        return self._keep(export.flatten_events(self.nested), "events")

    @cached_property
    def items(self) -> DataFrame:
        return self._keep(export.flatten_items(self.nested), "items")

    @cached_property
    def inventory(self) -> DataFrame:
        return self._keep(export.param_inventory(self.nested), "param_inventory")


class FlatInputs:
    """Flat tables already written by the flatten jobs, with the two small CSV files."""

    def __init__(self, spark: SparkSession, raw: str, reference: str):
        self.events = tables.read_table(spark, f"{raw}/events", EVENTS, "events")
        self.items = tables.read_table(spark, f"{raw}/items", ITEMS, "items")
        self.inventory = tables.read_or_empty(spark, f"{raw}/param_inventory", INVENTORY, "parameter inventory")
        self.calendar = tables.unique_dates(tables.read_calendar(spark, f"{reference}/calendar.csv"))
        self.trading_windows = tables.read_trading_windows(spark, f"{reference}/trading_windows.csv")


def from_driver_tables(spark: SparkSession, sf_dir: str, keep, reference: str | None = None) -> ExportInputs:
    """The mapping computes its export, so the events of this one are stored before several tables are flattened from it. Its two small tables are
    written as CSV below `reference`, if given, and read back as any others."""
    calendar, windows = driver_tables.calendar(spark), driver_tables.trading_windows(spark)
    if reference:
        driver_tables.write_reference(spark, reference)
        calendar = tables.read_calendar(spark, f"{reference}/calendar.csv")
        windows = tables.read_trading_windows(spark, f"{reference}/trading_windows.csv")
    return ExportInputs(lambda: driver_tables.nested_export(spark, sf_dir, keep), calendar, windows, keep)
