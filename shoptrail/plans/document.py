"""The results document as rows: one for each value, with its path."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Objects and arrays inside each other, at most: part, table, row, value.
DEPTH = 6


def document_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """(path, kind, text, number) of every value of JSON documents, such as `orders.repeats` or `segments[3].conversion`.

    kind is null, boolean, number or string; text is the value of the last two kinds but number, which is a double. A document is taken apart
    level by level as a variant, each level by Spark's own generator; empty objects and arrays have no values."""
    level = documents.select(F.lit("").alias("path"), F.parse_json(column).alias("v"))
    found = None
    for _ in range(DEPTH):
        inner = level.where("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'")
        leaves = level.where("NOT (schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%')")
        found = leaves if found is None else found.unionAll(leaves)
        each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "inner"))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
            F.concat(F.when(F.col("path") != "", F.lit(".")).otherwise(F.lit("")), F.col("key")))
        level = each.select(F.concat("path", name).alias("path"), F.col("inner").alias("v"))
    kind = F.expr("CASE WHEN v IS NULL OR is_variant_null(v) THEN 'null' WHEN schema_of_variant(v) = 'BOOLEAN' THEN 'boolean' "
                  "WHEN schema_of_variant(v) = 'STRING' THEN 'string' ELSE 'number' END")
    return (found.withColumn("kind", kind)
            .select("path", "kind", F.when(F.col("kind").isin("string", "boolean"), F.col("v").cast("string")).alias("text"),
                    F.when(F.col("kind") == "number", F.col("v").cast("double")).alias("number")))
