"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontam, negatives, packing, passages, quality, secrets, simhash, sketch, tokenfiles, urllists, warc
from .shared import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_decontam": decontam.op1,
    "op2_chat_format": chat.op2,
    "op3_warc": warc.op3,
    "op4_packing": packing.op4,
    "op5_simhash": simhash.op5,
    "op6_token_files": tokenfiles.op6,
    "op7_secrets": secrets.op7,
    "op8_quality": quality.op8,
    "op9_sketch": sketch.op9,
    "op10_url_lists": urllists.op10,
    "op11_passages": passages.op11,
    "op12_collocations": collocations.op12,
    "op13_negatives": negatives.op13,
}.items()}

ORACLE = {
    "op2_chat_format": chat.OP2_SQL,
    "op10_url_lists": urllists.OP10_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_negatives": negatives.OP13_SQL,
}
