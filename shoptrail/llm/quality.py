"""Quality classifier: a convolutional network over bytes, in numpy.

Learned filters of WIDTH bytes run over the whole document, cut into chunks that overlap so that no window is missed; each
filter's largest answer in a chunk is kept, and the mean, largest and smallest of these over all chunks go through one small
layer to a probability. Long documents are read in blocks of chunks, so memory does not grow with the text.

It is trained on the driver, from at most SAMPLE labelled documents (those of the smallest xxhash64 of their doc_id) of at
most PART bytes each, taken from the whole document's chunks; scores always use whole documents. Rows of the fold HELD_OUT
are never used for training.

Defined cases: a null text is an empty one and scores like one chunk of padding; repeated rows score alike; labels without a
quality, and labels of unknown documents, are ignored; without both labels in the sample the score is the share of label 1
(0.5 without any).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .shared import ship

WIDTH, FILTERS, HIDDEN, CHUNK = 6, 16, 16, 128
SAMPLE, STEPS, BATCH, RATE, SEED = 4000, 400, 64, 0.01, 7
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BLOCK = 512  # chunks that are answered at once

Weights = dict[str, np.ndarray]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def chunks(data: bytes) -> np.ndarray:
    """Bytes in rows of CHUNK + WIDTH - 1 that overlap by WIDTH - 1; the end is filled up with 0."""
    step = CHUNK
    n = max(1, -(-max(len(data) - WIDTH + 1, 1) // step))
    padded = np.zeros(n * step + WIDTH - 1, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)[:len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, step + WIDTH - 1)[::step]


def start(rng: np.random.Generator) -> Weights:
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {"table": normal(0.3, WIDTH, 256, FILTERS), "bias": np.zeros(FILTERS, np.float32),
            "w1": normal(0.2, 3 * FILTERS, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(0.3, HIDDEN), "b2": np.zeros(1, np.float32)}


def answers(w: Weights, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest answer, place of it) of each filter in each chunk."""
    most, where = np.empty((len(rows), FILTERS), w["table"].dtype), np.empty((len(rows), FILTERS), np.int64)
    for at in range(0, len(rows), BLOCK):
        some = rows[at:at + BLOCK]
        total = w["table"][0][some[:, :CHUNK]]
        for k in range(1, WIDTH):
            total += w["table"][k][some[:, k:k + CHUNK]]
        place = total.argmax(axis=1)
        most[at:at + BLOCK], where[at:at + BLOCK] = np.take_along_axis(total, place[:, None, :], 1)[:, 0] + w["bias"], place
    return most, where


def peaks(w: Weights, rows: np.ndarray) -> np.ndarray:
    """Largest answers only; the bias is added after the maximum."""
    total = w["table"][0][rows[:, :CHUNK]]
    for k in range(1, WIDTH):
        total += w["table"][k][rows[:, k:k + CHUNK]]
    return np.maximum(total.max(axis=1) + w["bias"], 0)


def pooled(w: Weights, text: str | None) -> np.ndarray:
    """Mean, largest and smallest over all chunks of a whole text."""
    rows = chunks((text or "").encode())
    total, most, least = np.zeros(FILTERS), np.full(FILTERS, -np.inf), np.full(FILTERS, np.inf)
    for at in range(0, len(rows), BLOCK):
        p = peaks(w, rows[at:at + BLOCK])
        total, most, least = total + p.sum(axis=0), np.maximum(most, p.max(axis=0)), np.minimum(least, p.min(axis=0))
    return np.concatenate((total / len(rows), most, least))


def probability(w: Weights, features: np.ndarray) -> np.ndarray:
    h = np.tanh(features @ w["w1"] + w["b1"])
    return 1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -30, 30)))


def train(texts: list[str | None], labels: np.ndarray, seed: int = SEED) -> Weights:
    """Weights fitted to the labels; both classes weigh the same, and b2 is then set back to the sample's shares."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    w = start(rng)
    if share in (0.0, 1.0) or not len(labels):
        w["w2"][:] = 0
        w["b2"][:] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return w
    docs = [chunks((t or "").encode()) for t in texts]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    order = np.empty(0, np.int64)
    for step in range(STEPS):
        if len(order) < min(BATCH, len(docs)):  # another round over all documents
            order = np.concatenate((order, rng.permutation(len(docs))))
        mine, order = order[:BATCH], order[BATCH:]
        grad = gradient(w, [docs[i] for i in mine], labels[mine], weight[mine])
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k, g in grad.items():  # Adam
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[k] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)).astype(np.float32)
    w["b2"] += np.float32(np.log(share / (1 - share)))
    return w


def gradient(w: Weights, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> Weights:
    """Of the weighted cross entropy, averaged over the documents."""
    sizes = np.array([len(d) for d in docs])
    rows, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
    raw, where = answers(w, rows)
    p = np.maximum(raw, 0)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mean = np.add.reduceat(p, begin) / sizes[:, None]
    most, least = np.maximum.reduceat(p, begin), np.minimum.reduceat(p, begin)
    x = np.concatenate((mean, most, least), axis=1)
    h = np.tanh(x @ w["w1"] + w["b1"])
    out = 1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -30, 30)))
    d_out = ((out - labels) * weight / len(docs)).astype(np.float32)
    d_h = d_out[:, None] * w["w2"] * (1 - h * h)
    d_x = d_h @ w["w1"].T
    d_mean, d_most, d_least = d_x[:, :FILTERS], d_x[:, FILTERS:2 * FILTERS], d_x[:, 2 * FILTERS:]
    # the first chunk that reaches the document's largest or smallest value takes that value's gradient
    d_p = (d_mean / sizes[:, None])[doc] + np.where(p == most[doc], d_most[doc], 0) + np.where(p == least[doc], d_least[doc], 0)
    d_raw = d_p * (raw > 0)
    table = np.zeros_like(w["table"])
    f = np.broadcast_to(np.arange(FILTERS), where.shape)
    for k in range(WIDTH):
        np.add.at(table[k], (np.take_along_axis(rows, where + k, 1), f), d_raw)
    return {"table": table, "bias": d_raw.sum(axis=0), "w1": x.T @ d_h, "b1": d_h.sum(axis=0),
            "w2": h.T @ d_out, "b2": d_out.sum(keepdims=True)}


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most `size` labelled documents outside the held-out fold, in a fixed order."""
    known = (labels.filter(F.col("quality").isin(0, 1)).filter(fold(F.col("doc_id")) != HELD_OUT)
             .groupBy("doc_id").agg(F.max("quality").alias("label")))
    picked = known.join(docs.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
            .collect())
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], np.array([r.label for r in rows], np.int64)


def model(docs: DataFrame, labels: DataFrame) -> Weights:
    return train(*sample(docs, labels))


def score(text: Column, weights: Weights) -> Column:
    """The probability of label 1 for a whole text."""
    @pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            features = np.array([pooled(weights, t) for t in part]).reshape(-1, 3 * FILTERS)
            yield pd.Series(probability(weights, features))
    return of(text)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
                      score(F.col("text"), model(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    ship(spark)
    weights = model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score(docs["text"], weights) >= THRESHOLD)
