"""The corpus pipeline: STAGES are applied one after the other, each to the written result of the one before.

Defined cases: documents with a null text count as empty ones and are judged like any other; a null doc_id, lang, source or n_chars is
kept as it is; of repeated rows, and of rows with equal texts, one stays (that with the smallest doc_id, null ones last); rows that share a
doc_id but not their text are documents of their own; very long texts go through whole; columns beyond those of documents stay up to packing, whatever
their names; an empty table gives an empty one, and without labels no document is told from another (all scores are 0.5, so none stays)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoptrail.llm.decontam import decontaminate_stage
from shoptrail.llm.packing import pack_stage
from shoptrail.llm.quality import quality_stage
from shoptrail.llm.secrets import redact_stage
from shoptrail.llm.shared import stage
from shoptrail.llm.simhash import dedup_stage

#: (name, function); each function takes (spark, docs, sf_dir) and all but the last return the columns of docs.
STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", redact_stage),
    ("packing", pack_stage),
]

#: No SQL expresses a trained classifier, tokenizers or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
