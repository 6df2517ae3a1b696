"""Toxicity: a linear classifier over character n-grams with naive Bayes log-count ratios.

Every text gives the set of its hashed character n-grams. Training counts each
feature in toxic and in other texts, takes the log ratio of the smoothed shares of texts
that have it, scales the (binary) features by it, brings each text to unit length and fits
a logistic regression on the result. Scoring is one vectorised pass over the texts.

The classifier is fitted on a bounded sample: ``TRAIN_ROWS`` labelled rows in hash
order of doc_id, of which those are taken whose whole texts fit into ``TRAIN_BYTES``
together. Scoring covers every row and whole texts.

Defined results: a null text is an empty text; a text without features scores the
intercept; rows with a null label or doc_id are not trained on. Without rows of both
classes the score is the share of toxic rows (0 when there are none). Repeated rows
score alike. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import cut, text_or_empty

BITS = 18
ORDERS = (3, 4)
TRAIN_ROWS = 6000
#: UTF-8 bytes of all training texts together.
TRAIN_BYTES = 64_000_000
EPOCHS = 20
RATE = 0.1
FOLDS = 5


def features(text: str, bits: int = BITS, orders: tuple = ORDERS) -> np.ndarray:
    """Sorted distinct hashed character n-grams of the lower-cased text, a space at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for n in orders:
        if len(codes) < n:
            continue
        h = codes[: len(codes) - n + 1].copy()
        for j in range(1, n):
            h *= np.uint64(1099511628211)
            h += codes[j : len(codes) - n + 1 + j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(64 - bits)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def fit(texts: list[str], labels: list[int], bits: int = BITS, orders: tuple = ORDERS, epochs: int = EPOCHS):
    """(weights, ratios, intercept) from texts and 0/1 labels."""
    y = np.array(labels, dtype=np.float64)
    zero = np.zeros(1 << bits)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return zero, zero, float(np.log(share / (1 - share)))
    rows = [features(t, bits, orders) for t in texts]
    toxic, other = np.ones(1 << bits), np.ones(1 << bits)
    for x, label in zip(rows, y):
        (toxic if label else other)[x] += 1
    ratio = np.log(toxic / (y.sum() + 2)) - np.log(other / (len(y) - y.sum() + 2))
    values = [ratio[x] / (np.linalg.norm(ratio[x]) or 1.0) for x in rows]
    weights, square = zero.copy(), np.full(1 << bits, 1e-6)
    bias, bias_square = float(np.log(y.mean() / (1 - y.mean()))), 1e-6
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = 1 / (1 + np.exp(-(bias + weights[x] @ v))) - y[i]
            step = slope * v + 1e-6 * weights[x]
            square[x] += step * step
            weights[x] -= RATE * step / np.sqrt(square[x])
            bias_square += slope * slope
            bias -= RATE * slope / np.sqrt(bias_square)
    return weights, ratio, bias


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES):
    """Fit on at most ``rows`` labelled rows outside the held-out fold, in hash order, with ``most_bytes`` of text."""
    named = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label"))
    chosen = (
        named.filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~_held_out("label_id"))
        .orderBy(F.md5(F.col("label_id").cast("string")), "label_id", "label")
        .limit(rows)
    )
    sample = cut(
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "label", "text", F.md5("text").alias("digest"))
    )
    sizes = sample.select("doc_id", "label", "digest", F.octet_length("text").alias("size")).distinct().collect()
    room, fit_in = most_bytes, set()
    for r in sorted(sizes, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).digest(), r.label, r.digest)):
        if r.size <= room:
            room -= r.size
            fit_in.add((r.doc_id, r.label, r.digest))
    allowed = docs.sparkSession.createDataFrame(sorted(fit_in), "doc_id long, label int, digest string")
    got = sample.join(F.broadcast(allowed), ["doc_id", "label", "digest"], "left_semi").select("doc_id", "label", "text").distinct()
    found = sorted((r.doc_id, r.label, r.text) for r in got.collect())
    return fit([t for _, _, t in found], [y for _, y, _ in found])


def _held_out(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS == 0


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id",
        _held_out("doc_id").alias("held_out"),
        scorer(model)("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scorer(model):
    weights, ratio, bias = model
    bits = int(np.log2(len(weights)))
    table = np.stack([weights * ratio, ratio * ratio], axis=1).astype(np.float32)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            dot, square = table[features(text, bits)].sum(axis=0, dtype=np.float64)
            out[i] = bias + (dot / np.sqrt(square) if square > 0 else 0.0)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return of


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return docs.filter(scorer(train(docs, labels, rows))(text_or_empty()) < 0.5)
