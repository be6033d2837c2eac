"""Readers and writers of the flat tables and the small reference tables."""
from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..contract import CALENDAR, EXPORT, TRADING_WINDOWS, ContractError, require_columns, require_stored
from .days import resolve


class EmptyInputError(FileNotFoundError):
    pass


def read_table(spark: SparkSession, path: str, contract: T.StructType, what: str, merge: bool = False) -> DataFrame:
    """All Parquet files below `path` that its manifest names (all, where there is none), matched to the contract by column name.

    The schema the files have is checked first: with `merge` that of all files together, so that a file may lack a column; else
    that of every single file, by reading the footers in tasks. Only then is the contract used as the schema.
    """
    folders = resolve(spark, path)
    if folders == []:
        raise EmptyInputError(f"no Parquet rows for {what} in {path}")
    places = folders or [path]
    reader = lambda: spark.read.option("basePath", path) if folders else spark.read
    try:
        stored = (reader().option("mergeSchema", True) if merge else reader()).parquet(*places)
    except AnalysisException as failed:
        if failed.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        raise EmptyInputError(f"no Parquet rows for {what} in {path}") from failed
    require_stored(stored.schema, contract, what)
    if not merge:
        faults = drift(spark, places, contract, path).limit(5).collect()
        if faults:
            raise ContractError(f"{what} has files of another schema: " + "; ".join(f"{f.column} {f.fault} in {f.file}" for f in faults))
    table = stored if merge else reader().schema(contract).parquet(*places)
    if table.isEmpty():
        raise EmptyInputError(f"no Parquet rows for {what} in {path}")
    return require_columns(table, contract, what)


def drift(spark: SparkSession, places: Sequence[str], contract: T.StructType, base: str | None = None) -> DataFrame:
    """(file, column, fault): a row per Parquet file and column that the file lacks or holds as another type. The footers are read in
    tasks, from stores that Arrow knows; columns that folder names give are not looked for in files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(places)).select("path")
    empty = spark.createDataFrame([], contract)
    wanted = [(f.name, g.name, str(g.type)) for f, g in zip(contract.fields, empty.toArrow().schema)]

    def look(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                plain = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
                store, inner = fs.FileSystem.from_uri(quote(plain, safe="/:=%"))
                have = {f.name: str(f.type) for f in pq.read_schema(inner, filesystem=store)}
                for name, _, kind in wanted:
                    if name not in have:
                        if f"/{name}=" not in path:
                            found.append((path, name, "missing"))
                    elif plain_type(have[name]) != plain_type(kind):
                        found.append((path, name, f"is {have[name]}"))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file", "column", "fault"])

    def plain_type(kind: str) -> str:
        """Timestamps differ by unit and zone from writer to writer, and lists by the name of their element."""
        return "timestamp" if kind.startswith("timestamp") else kind.replace("large_", "").replace("element: ", "item: ")
    return files.mapInArrow(look, "file string, column string, fault string")


def drift_by_day(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """(event_date, column, fault, files) of a table stored by day: which days' files lack a column or hold another type."""
    day = F.regexp_extract("file", "event_date=([0-9-]+)", 1).cast("date")
    return drift(spark, [path], contract).groupBy(day.alias("event_date"), "column", "fault").agg(F.count(F.lit(1)).alias("files"))


def read_or_empty(spark: SparkSession, path: str, contract: T.StructType, what: str) -> DataFrame:
    """As read_table, but no rows are no error: an export without a single parameter has an empty inventory."""
    try:
        return read_table(spark, path, contract, what)
    except EmptyInputError:
        return spark.createDataFrame([], contract)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The nested export: a folder with one `event_date=YYYYMMDD` partition per day, or plain files with that column.

    The files must have every field of the contract, at any depth; the day may be stored as a text or a number."""
    require_stored(spark.read.parquet(path).schema, EXPORT, "export", free=("event_date",))
    days = spark.read.schema(EXPORT).parquet(path)
    return days.withColumn("event_date", F.col("event_date").cast("string"))


def read_csv(spark: SparkSession, path: str, contract: T.StructType, what: str) -> DataFrame:
    """A small reference file. Its header must name the contract's columns in their order, and every line must have a value of the
    right type in each: a line that does not is an error, which shows it."""
    schema = T.StructType([*contract.fields, T.StructField("bad_line", T.StringType())])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_line",
                          ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    try:
        bad = [r.bad_line for r in rows.where("bad_line IS NOT NULL").limit(5).collect()]
    except Exception as failed:
        if "header does not conform" in str(failed):
            raise ContractError(f"{what} in {path} must have the columns {contract.fieldNames()}: {failed}") from failed
        raise
    if bad:
        raise ContractError(f"{what} in {path} has lines that are not {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in contract.fields)}: {bad}")
    return rows.drop("bad_line")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CALENDAR, "calendar")


def read_trading_windows(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TRADING_WINDOWS, "trading windows")


def unique_dates(calendar: DataFrame) -> DataFrame:
    """Two labels on one day would double that day in the daily table, so they are an error."""
    return calendar.groupBy("date").agg(
        F.when(F.count(F.lit(1)) > 1,
               F.raise_error(F.concat(F.lit("calendar has two labels for "), F.col("date").cast("string"))))
        .otherwise(F.min("label")).cast("string").alias("label"))
