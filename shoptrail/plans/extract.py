"""Nested export -> flat tables by day. Running some days again replaces those days only, in all tables at once."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..sources import export
from ..sources.days import replace_days


def extract(nested: DataFrame, out: str, first: dt.date | None = None, last: dt.date | None = None) -> None:
    """Write `events`, `items` and `param_inventory` below `out`, each partitioned by day.

    The days run are those from `first` to `last`, if both are given, and else all days of the input, which every event has. A
    table that has no rows for such a day loses what an earlier run wrote for it. Readers see the tables of the last run that
    ended.
    """
    given = export.in_days(nested, first, last)
    days = {first + dt.timedelta(days=i) for i in range((last - first).days + 1)} if first and last else None
    tables = {"events": export.flatten_events(given), "items": export.flatten_items(given),
              "param_inventory": export.param_inventory(given, per_day=True)}
    # A row without a day belongs to no partition a run could replace.
    replace_days(nested.sparkSession, out, {n: t.where(F.col("event_date").isNotNull()) for n, t in tables.items()}, days)
