"""Folders that all executors share, and stage tables in them."""
from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR = "spark.checkpoint.dir"
_MADE: list[str] = []
_LOCAL: dict[str, str] = {}  # the temporary folder of a local application that names none


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the cluster; where none is set, a local session gets a temporary one."""
    base = spark.conf.get(DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{DIR} must name a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-")
        _LOCAL[spark.sparkContext.applicationId] = base
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Deletes every folder that this process made; frames that read them can then no longer be used."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are no longer used, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes the files of a stage table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage and outlives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


#: Rows of whole texts that Spark hands to Python at once; its own default is meant for narrow rows.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of an application, once, and keeps batches of texts small in this session."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        into = tempfile.mkdtemp(prefix="ship-")  # the driver's own; Spark sends the file to the executors
        sc.addPyFile(shutil.make_archive(os.path.join(into, "shoptrail"), "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(sc.applicationId)
