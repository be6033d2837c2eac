"""Tables by day that change all at once: every run writes folders of its own, and one manifest, switched at the end, names those that
count.

    <root>/<table>/event_date=<day>/attempt=<run>/...
    <root>/_manifest/<version>.json      {"tables": {table: {day: run}}}

A reader resolves the newest manifest and reads the folders it names, so a run that dies between two tables changes nothing.
A version is made by a rename that fails where the file exists, so of two runs at a time one raises. Folders that no manifest
names any more are removed after the switch; what a dead run left goes with the next one. A manifest has a line per table and day.
"""
from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


class ConcurrentRunError(RuntimeError):
    pass


class DayTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    @property
    def _store(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        found = self._store.globStatus(self._path("_manifest", "*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def current(self) -> tuple[int, dict[str, dict[str, str]]]:
        """The newest version, 0 if there is none, and its folders: table -> day -> run."""
        versions = self.versions()
        if not versions:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/_manifest/{versions[-1]:08d}.json", wholetext=True).first()[0]
        return versions[-1], json.loads(text)["tables"]

    def folders(self, table: str) -> list[str] | None:
        """The folders to read for a table, or None where nothing is managed by a manifest."""
        version, tables = self.current()
        if not version:
            return None
        return [f"{self.root}/{table}/event_date={day}/attempt={run}" for day, run in sorted(tables.get(table, {}).items())]

    def write(self, table: str, rows: DataFrame, run: str, by: str | None = None) -> list[str]:
        """Writes rows of a run, spread by day; returns the days that got any, from the folders and not from the rows.

        The rows are rebalanced by day: adaptive execution packs small days together and splits a busy day over as many
        tasks and files as its measured size asks for. Inside a file rows are ordered by event name (or by another column), so a
        reader filtering on it can skip row groups."""
        order = by or next((c for c in ("event_name", "user_pseudo_id") if c in rows.columns), "event_date")
        (rows.hint("rebalance", F.col("event_date")).withColumn("attempt", F.lit(run))
         .sortWithinPartitions("event_date", order)
         .write.mode("append").partitionBy("event_date", "attempt").parquet(f"{self.root}/{table}"))
        found = self._store.globStatus(self._path(table, "event_date=*", f"attempt={run}")) or []
        return sorted(f.getPath().getParent().getName().removeprefix("event_date=") for f in found)

    def switch(self, version: int, tables: dict[str, dict[str, str]]) -> None:
        """Makes these folders current, if `version` still is."""
        draft = self._path("_manifest", f"_{uuid.uuid4().hex}")
        out = self._store.create(draft, False)
        out.write(json.dumps({"tables": tables}).encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self._conf)
        never_replace = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._store.makeQualified(draft), self._store.makeQualified(self._path("_manifest", f"{version + 1:08d}.json")), never_replace)
        except Exception as failed:
            self._store.delete(draft, False)
            if "AlreadyExists" in str(failed):
                raise ConcurrentRunError(f"another run has written version {version + 1} of {self.root}") from failed
            raise

    def retire(self) -> None:
        """Removes the folders that the current manifest does not name, and older manifests."""
        version, tables = self.current()
        for table, days in tables.items():
            for f in self._store.globStatus(self._path(table, "event_date=*", "attempt=*")) or []:
                day, run = (p.getName().split("=", 1)[1] for p in (f.getPath().getParent(), f.getPath()))
                if days.get(day) != run:
                    self._store.delete(f.getPath(), True)
            for f in self._store.globStatus(self._path(table, "event_date=*")) or []:
                if not self._store.listStatus(f.getPath()):
                    self._store.delete(f.getPath(), True)
        for old in self.versions():
            if old < version:
                self._store.delete(self._path("_manifest", f"{old:08d}.json"), False)


def replace_days(spark: SparkSession, root: str, tables: dict[str, DataFrame], days: set[dt.date] | None) -> None:
    """Writes tables (each with event_date and event_name) and makes them current for the given days, all at once; None stands for the days
    that any of the tables has. Days a table has no rows for are gone from it."""
    store, run = DayTables(spark, root), uuid.uuid4().hex
    version, before = store.current()
    if not version and any(store._store.globStatus(store._path(name, "event_date=*", "*.parquet")) for name in tables):
        raise ValueError(f"{root} holds tables written without a manifest; write to another folder")
    written = {name: store.write(name, rows, run) for name, rows in tables.items()}
    redone = {d.isoformat() for d in days} if days is not None else {d for found in written.values() for d in found}
    store.switch(version, {name: {d: r for d, r in before.get(name, {}).items() if d not in redone} | {d: run for d in found if d in redone}
                           for name, found in written.items()} | {n: d for n, d in before.items() if n not in tables})
    store.retire()


def resolve(spark: SparkSession, path: str) -> list[str] | None:
    """The folders that are current for a table's path, or None where its parent has no manifest."""
    root, _, table = path.rstrip("/").rpartition("/")
    try:
        return DayTables(spark, root).folders(table)
    except AnalysisException:
        return None
