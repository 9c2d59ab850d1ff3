"""Quality scores by naive Bayes support vectors.

Features are indicators of hashed n-grams: words (1 and 2), their shapes (2 and 3) and a word that
repeats at once.  Each is scaled by the log ratio of its smoothed frequencies in the two classes,
counted over all labelled training documents.  A linear hinge-loss model is then fitted on at most
``sample`` of them by dual coordinate descent, and its margins become probabilities by a logistic
curve fitted on documents kept apart.

Nulls: a null or empty text has no features and gets the score of the bias.  Null labels and ids
teach nothing; several labels of a document all count.  Repeated rows are scored alike.  With
labels of one class or none every score is that class's share (0.5 without labels).  Further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import ngrams
from boardsift.llm.common import held_out, table

#: Labels are sent to all tasks up to this many rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the linear model is fitted on."""

    bits: int = 16
    sample: int = 6000
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    cut: float = 0.3


def indicators(texts: list[str], bits: int) -> list[np.ndarray]:
    """The different buckets of each text."""
    out: list[np.ndarray] = []
    last = np.zeros(1 << bits, np.int64)
    for group in ngrams.groups(texts):
        h, shape, text = ngrams.tokens(*ngrams.code_points(group))
        parts = [ngrams.windows(h, text, 1, 1), ngrams.windows(h, text, 2, 2),
                 ngrams.windows(shape, text, 2, 3), ngrams.windows(shape, text, 3, 4)]
        again = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1])) if len(h) > 1 else np.zeros(0, np.int64)
        parts.append((np.full(len(again), 5, np.uint64), text[again]))
        ends = []
        buckets = []
        for hashed, owner in parts:
            buckets.append((ngrams.mixed(hashed) >> np.uint64(64 - bits)).astype(np.int64))
            ends.append(np.searchsorted(owner, np.arange(len(group) + 1)))
        for k in range(len(group)):
            b = np.concatenate([x[e[k]:e[k + 1]] for x, e in zip(buckets, ends)])
            last[b] = np.arange(len(b))  # the last place of each bucket stays
            out.append(b[last[b] == np.arange(len(b))])
    return out


def class_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """(2, buckets + 1): texts of each class with each bucket, and of each class in all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, (1 << bits) + 1), np.int64)
        for batch in batches:
            for y, at in zip(batch["label"], indicators(list(batch["text"]), bits)):
                total[y, at] += 1
                total[y, -1] += 1
        y, at = np.nonzero(total)
        yield pd.DataFrame({"label": y, "bucket": at, "n": total[y, at]})

    found = rows.select("label", "text").mapInPandas(count, "label int, bucket long, n long").groupBy(
        "label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, (1 << bits) + 1))
    out[found["label"], found["bucket"]] = found["n"]
    return out


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cfg: Settings) -> np.ndarray:
    """Weights over scaled indicators (bias last) of the L2-regularised hinge loss."""
    w = np.zeros(len(r) + 1)
    alpha = np.zeros(len(rows))
    data = []
    for at in rows:
        x = r[at]
        norm = np.sqrt(x @ x) or 1.0
        data.append((np.append(at, len(r)), np.append(x / norm, 1.0)))
    # the rarer class weighs as much as the other
    bound = np.where(y > 0, cfg.cost, cfg.cost * max(1.0, (y > 0).sum() / max((y < 0).sum(), 1)))
    rng = np.random.default_rng(11)
    for _ in range(cfg.epochs):
        for k in rng.permutation(len(data)):
            at, x = data[k]
            g = y[k] * (w[at] @ x) - 1
            new = min(max(alpha[k] - g / (x @ x), 0.0), bound[k])
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * y[k] * x
                alpha[k] = new
    return w


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    bits: int

    def margins(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(found), self.weights[-1])
        for k, at in enumerate(found):
            if len(at):
                x = self.ratio[at]
                out[k] += (x @ self.weights[at]) / (np.sqrt(x @ x) or 1.0)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.slope * self.margins(indicators(texts, self.bits)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of labelled documents that are not held out."""
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(
        F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    rows = labelled(docs, labels)
    counts = class_counts(rows, cfg.bits)
    neg, pos = counts[:, -1]
    size = 1 << cfg.bits
    if not neg or not pos:
        share = 0.5 if not neg + pos else pos / (neg + pos)
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return Model(np.zeros(size), np.zeros(size + 1), 1.0, float(odds), cfg.bits)
    p, q = counts[1, :-1] + cfg.smoothing, counts[0, :-1] + cfg.smoothing
    ratio = np.log(p / (pos + 2 * cfg.smoothing)) - np.log(q / (neg + 2 * cfg.smoothing))
    chosen = rows.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(
        cfg.sample).select("doc_id").distinct()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": indicators(
                list(batch["text"]), cfg.bits)})

    # the chosen ids are bounded by the sample's size
    data = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInPandas(
        features, "doc_id long, label int, at array<int>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    found = [np.asarray(a, np.int64) for a in data["at"]]
    y = np.where(data["label"].to_numpy() > 0, 1, -1)
    apart = np.arange(len(y)) % 4 == 0
    if len(set(y[~apart])) < 2:
        apart[:] = False
    weights = dual_descent([f for f, a in zip(found, apart) if not a], y[~apart], ratio, cfg)
    model = Model(ratio, weights, 1.0, 0.0, cfg.bits)
    if apart.any():
        margins = model.margins([f for f, a in zip(found, apart) if a])
        slope, offset = logistic_curve(margins, (y[apart] > 0).astype(float))
        model = Model(ratio, weights, slope, offset, cfg.bits)
    return model


def score(docs: DataFrame, model: Model, cfg: Settings = Settings()) -> DataFrame:
    """(doc_id, score, predicted) of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("score double, predicted int")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            s = shared.value.scores(list(batch))
            yield pd.DataFrame({"score": s, "predicted": (s >= cfg.cut).astype(np.int32)})

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("_r")).select("doc_id", "_r.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                      "score", "predicted")
