"""Stage tables: intermediates that several results read are written once to shared storage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Writes stage tables below the folder the cluster names in `spark.checkpoint.dir`.

    A stage table cuts the lineage, keeps column pruning and survives the loss of executors. Where the setting is
    missing, a local session uses a fresh temporary folder; a cluster session, which shares no such folder, persists
    the frame instead and keeps its lineage. A name stands for one table: it is made when it is first kept and used
    again after that. `close()` removes everything that was kept; frames built on it can then no longer be read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="shoptrail-")
        self.root = f"{root.rstrip('/')}/shoptrail-{uuid.uuid4().hex}" if root else None
        self._kept: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = self._store(df, name)
        return self._kept[name]

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        if self.root is None:
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self.root is None:
            for df in self._kept.values():
                df.unpersist()
        else:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._kept.clear()
