"""Joins and medians that stay distributed when one key or value holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECES = 16


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str],
                pieces: int = PIECES, how: str = "left") -> DataFrame:
    """Join `right` (unique per key, narrow) to `left`, whose keys may be hot.

    Each key of `left` is cut into `pieces` by the hash of its `spread` columns and `right` is repeated once per
    piece, so a key with a third of the rows becomes as many tasks. Both sides reach the join through a plain
    exchange, which also lets adaptive execution split what is still too large, or broadcast `right` when its
    measured size is small.
    """
    piece = F.expr(f"CAST(pmod(xxhash64({', '.join(spread)}), {pieces}) AS INT)")
    cut = left.withColumn("_piece", piece)
    copies = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return cut.join(copies, [*keys, "_piece"], how).drop("_piece")


def exact_median(df: DataFrame, value: Column, weight: Column, alias: str,
                 keep: Callable[[DataFrame, str], DataFrame], ranges: int | None = None) -> DataFrame:
    """One row: the exact interpolated median of a value, each row counting `weight` times.

    Equal values are merged and the distinct ones cut into ranges of about equal size, whatever their distribution; this
    table is stored by `keep(df, name)` and so computed once. A count per range tells where the middle ranks lie, and only
    that range (or the two beside the middle) is ordered, so no task ever holds more than a range. `ranges` is at least
    the shuffle partitions of the session.
    """
    spark = df.sparkSession
    ranges = ranges or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = keep(df.select(value.alias("v"), weight.alias("n")).where("v IS NOT NULL")
                  .groupBy("v").agg(F.sum("n").alias("n"))
                  .repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id()), "median_values")

    def holds_middle(d: DataFrame) -> DataFrame:
        return d.where((F.col("upto") - F.col("n") < F.col("hi_rank")) & (F.col("upto") >= F.col("lo_rank")))

    # A row per range.
    middle = holds_middle(
        merged.groupBy("part").agg(F.sum("n").alias("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
        .withColumn("upto", F.sum("n").over(Window.orderBy("part")))
        .withColumn("lo_rank", F.floor((F.col("total") + 1) / 2.0))
        .withColumn("hi_rank", F.ceil((F.col("total") + 1) / 2.0))
    ).select("part", "lo_rank", "hi_rank", (F.col("upto") - F.col("n")).alias("before"))
    values = holds_middle(
        merged.join(F.broadcast(middle), "part")
        .withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    )
    return values.agg(F.avg("v").alias(alias))
