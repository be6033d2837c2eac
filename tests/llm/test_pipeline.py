import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from shoptrail.llm import decontam, quality, secrets, simhash
from shoptrail.llm.shared import stage

NAMES = ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality":
            scores = quality.score(before["text"], quality.model(before, spark.read.parquet(f"{SF}/labels.parquet")))
            assert docs.count() == before.filter(scores >= 0.7).count()
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
            sets = [simhash.shingle_set(r.text, 5) for r in docs.select("text").collect()]
            assert all(simhash.jaccard(a, b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
        if name == "decontamination":
            assert decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "secrets":
            assert docs.select(secrets.scan(F.col("text"), secrets.lexicon(before)).alias("s")).filter("s.spans <> ''").count() == 0
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    total = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert total[1] <= 1.02 * -(-total[0] // 1024) + 1
    run = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


@pytest.mark.parametrize("rows", ([], [(1, None, None, None, None, "q", 1), (2, "", "en", "s", 0, "q", 2), (2, "", "en", "s", 0, "q", 2), (None, "one two", None, None, 7, None, 3)]))
def test_nulls_empty_tables_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, rank int")
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "rank"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= (docs.count() > 0)
