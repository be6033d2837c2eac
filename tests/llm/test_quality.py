import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoptrail.llm import quality

SF, SF_SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark, rows):
    got = {r.doc_id: r for r in quality.op8(spark, SF).collect()}
    import duckdb
    labels = duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    n = duckdb.connect().execute(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(got[d].score, q) for d, q in labels if got[d].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s >= 0.7 for s in bad]) < 0.5


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in quality.start(rng).items()}
    docs = [quality.chunks(bytes(rng.integers(0, 256, n).tolist())) for n in (10, 700, 300)]
    labels, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss(w):
        out = []
        for d in docs:
            p = quality.peaks(w, d)
            out.append(quality.probability(w, np.concatenate((p.mean(axis=0), p.max(axis=0), p.min(axis=0)))))
        out = np.concatenate(out)
        return -(weight * np.log(np.where(labels == 1, out, 1 - out))).mean()
    grad = quality.gradient(w, docs, labels, weight)
    for k in w:
        flat = np.argsort(-np.abs(grad[k]).ravel())[:5]
        for at in flat:
            at = np.unravel_index(at, w[k].shape)
            keep, step = w[k][at], 1e-5
            w[k][at] = keep + step
            up = loss(w)
            w[k][at] = keep - step
            down = loss(w)
            w[k][at] = keep
            assert grad[k][at] == pytest.approx((up - down) / 2 / step, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("n", (0, 1, 5, 6, 127, 128, 133, 134, 1000, 128 * 600))
def test_chunks_hold_every_window(n, monkeypatch):
    data = np.random.default_rng(n).integers(1, 256, n).astype(np.uint8).tobytes()
    rows = quality.chunks(data)
    seen = {bytes(r[i:i + quality.WIDTH]) for r in rows for i in range(quality.CHUNK)}
    assert {data[i:i + quality.WIDTH] for i in range(n - quality.WIDTH + 1)} <= seen
    w = quality.start(np.random.default_rng(0))
    whole = quality.pooled(w, data.decode("latin-1"))
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert np.allclose(quality.pooled(w, data.decode("latin-1")), whole, atol=1e-5)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "!!" * 200_000, 3), (4, "fine", 4), (4, "fine", 4), (None, "x", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (4, 0, None), (4, 0, 1), (99, 1, 1), (3, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    texts, y = quality.sample(docs, labels)
    fold = [d for d in (1, 4) if zlib.crc32(str(d).encode()) % 4 != 2]
    assert len(texts) == len(y) == len(fold)
    w = quality.model(docs, labels)
    got = docs.withColumn("p", quality.score(F.col("text"), w)).collect()
    assert len(got) == 6 and all(0 <= r.p <= 1 for r in got) and got[0].p == got[1].p and got[3].p == got[4].p
    for none in (labels.limit(0), labels.filter("doc_id = 99")):
        assert {round(r.p, 6) for r in docs.withColumn("p", quality.score(F.col("text"), quality.model(docs, none))).collect()} == {0.5}
    assert docs.limit(0).withColumn("p", quality.score(F.col("text"), w)).count() == 0
    one = quality.train(["a", "b"], np.array([1, 1]))
    assert quality.probability(one, np.zeros((1, 3 * quality.FILTERS)))[0] > 0.999


def test_training_sees_whole_texts(spark):
    """What tells good from bad stands in the middle of long texts."""
    rng = np.random.default_rng(2)
    filler = lambda: "".join(rng.choice(list("abcdef "), 9000))
    texts = [filler() + (" good mark " if i % 2 else " bad sign ") + filler() for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, _ = quality.sample(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    assert got == [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    w = quality.train(texts, np.arange(120) % 2)
    p = quality.probability(w, np.array([quality.pooled(w, t) for t in texts]))
    assert p[1::2].mean() > 0.8 and p[::2].mean() < 0.2


def test_scores_equal_a_plain_forward_pass(spark):
    """Every score of the query again from the weights, window by window in plain loops over bytes."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    w = quality.model(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.op8(spark, SF_SMALL).collect()}
    some = sorted(docs.collect(), key=lambda r: len(r.text or ""))
    table = w["table"].astype(np.float64)
    for r in some[:20] + some[90:100] + some[-2:]:
        data = (r.text or "").encode()
        best = []
        for start in range(0, max(len(data) - quality.WIDTH + 1, 1), quality.CHUNK):
            part = data[start:start + quality.CHUNK + quality.WIDTH - 1].ljust(quality.CHUNK + quality.WIDTH - 1, b"\0")
            each = [sum(table[k][part[i + k]] for k in range(quality.WIDTH)) + w["bias"] for i in range(quality.CHUNK)]
            best.append([max(0.0, *(e[f] for e in each)) for f in range(quality.FILTERS)])
        x = np.concatenate((np.mean(best, axis=0), np.max(best, axis=0), np.min(best, axis=0)))
        z = np.tanh(x @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"][0]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
