"""EXISTS with an inequality, by merged sort order."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def earlier_exists(left: DataFrame, right: DataFrame, key: str, time: str, alias: str,
                   keep: Callable[[DataFrame, str], DataFrame], parts: int | None = None) -> DataFrame:
    """`left` with a flag: whether `right` has a row of the same key with a strictly earlier time.

    The rows of both sides are merged and cut into ranges of (key, time), so a hot key becomes as many ranges as its share of
    the rows asks for; `keep(df, name)` stores them with their range. Inside a range one pass in order of time carries whether
    the other side has been met. A key goes over the end of a range at most once a range, so what is carried from
    range to range is a row per range and fits a broadcast. NULL keys and times match nothing.
    """
    spark = left.sparkSession
    parts = parts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # At one time the asking row comes first: equal is not earlier.
    asked = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0).alias("side"), F.struct("*").alias("row"))
    given = (right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
             .select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(asked.schema["row"].dataType).alias("row")))
    merged = keep(asked.union(given).repartitionByRange(parts, "k", "t").withColumn("part", F.spark_partition_id()), f"{alias}_ranges")
    # Keys whose rows lie in more than one range: at most one begins before a range and goes on in it.
    spans = (merged.groupBy("k", "part").agg(F.max("side").alias("has")).where("k IS NOT NULL")
             .withColumn("first", F.min(F.when(F.col("has") == 1, F.col("part"))).over(Window.partitionBy("k")))
             .where("part > first").select("k", "part", F.lit(True).alias("carried")))
    before = F.max("side").over(Window.partitionBy("k", "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("met", before).where("side = 0").join(F.broadcast(spans), ["k", "part"], "left")
            .select("row.*", (F.col("k").isNotNull() & F.col("t").isNotNull()
                              & ((F.col("met") == 1) | F.coalesce("carried", F.lit(False)))).alias(alias)))
