"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams, weighted by relative frequency times inverse document
frequency.  Document frequencies cover all training documents.  The weights are learned on at most
``per_language`` documents of each language with follow-the-regularised-leader (L1 and L2
penalties, so most weights are exactly zero); a temperature fitted on documents kept apart makes
the scores probabilities.  Prediction is a gather and a sum over all windows of the whole text.

Nulls: a null text, and one without a letter, is ``und`` with score 0; a null lang or doc_id
teaches nothing and is held out of learning.  Repeated rows are predicted alike.  With no training
document every text is ``und``.  Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardsift.llm import ngrams
from boardsift.llm.common import held_out, table

ORDERS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the sample that the weights are fitted on."""

    bits: int = 15
    per_language: int = 500
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    scale: float = 20.0


def _counts(text: str, bits: int) -> np.ndarray:
    points, _ = ngrams.code_points([text.lower()])
    return np.bincount(np.concatenate([ngrams.char_grams(points, n, bits) for n in ORDERS]), minlength=1 << bits)


def document_frequencies(texts: DataFrame, bits: int) -> np.ndarray:
    """In how many texts each bucket occurs, with the number of texts last; one array of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << bits) + 1, np.int64)
        mark = np.zeros(1 << bits, bool)
        for batch in batches:
            for text in batch["text"]:
                points, _ = ngrams.code_points([text.lower()])
                mark[:] = False
                for n in ORDERS:
                    mark[ngrams.char_grams(points, n, bits)] = True
                total[:-1] += mark
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1)
    out[rows["bucket"]] = rows["n"]
    return out


def sample(train: DataFrame, cfg: Settings) -> pd.DataFrame:
    """(lang, idx, cnt) of at most ``per_language`` documents a language, chosen by hash."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = train.select("lang", "doc_id").withColumn("k", F.row_number().over(order)).filter(
        F.col("k") <= cfg.per_language).select("doc_id").distinct()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [_counts(t, cfg.bits) for t in batch["text"]]
            at = [np.flatnonzero(c) for c in counts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "idx": at,
                                "cnt": [c[i] for c, i in zip(counts, at)]})

    # the chosen ids are bounded by the sample's size
    return train.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text").mapInPandas(
        features, "doc_id long, lang string, idx array<int>, cnt array<int>").toPandas().sort_values(
        ["doc_id", "lang"], kind="stable")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, cfg: Settings) -> np.ndarray:
    """Weights (features + bias, classes) by per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * cfg.l1) / ((cfg.beta + np.sqrt(n[at])) / cfg.alpha + cfg.l2)
        return np.where(np.abs(z[at]) <= cfg.l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(cfg.epochs):
        for k in rng.permutation(len(rows)):
            at, x, label = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / cfg.alpha * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # idf and temperature included; the last row is the bias
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each language for each text."""
        out = []
        for group in ngrams.groups(t.lower() for t in texts):
            points, starts = ngrams.code_points(group)
            sums, total = np.zeros((len(group), len(self.languages))), np.zeros(len(group))
            for order in ORDERS:
                for a in range(0, len(points), ngrams.GROUP):
                    part = points[a:a + ngrams.GROUP + order - 1]
                    found = ngrams.char_grams(part, order, self.bits)
                    # where each text's windows begin and end among these
                    lo = np.clip(starts[:-1] - a, 0, len(found))
                    hi = np.clip(starts[1:] - order + 1 - a, 0, len(found))
                    some = np.flatnonzero(hi > lo)
                    if len(some):
                        edges = np.ravel(np.column_stack([lo[some], hi[some]]))
                        values = np.vstack([self.table[found], np.zeros((1, self.table.shape[1]), np.float32)])
                        sums[some] += np.add.reduceat(values, edges, axis=0)[::2]
                        total[some] += hi[some] - lo[some]
            out.append(sums / np.maximum(total, 1)[:, None] + self.table[-1])
        return softmax(np.vstack(out)) if out else np.zeros((0, len(self.languages)))


def fit(docs: DataFrame, cfg: Settings = Settings()) -> Model | None:
    """A model from (doc_id, lang, text) of the documents that are not held out."""
    train = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & ~held_out(F.col("doc_id")))
    rows = sample(train, cfg)
    if not len(rows):
        return None
    df = document_frequencies(train, cfg.bits)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    languages = sorted(set(rows["lang"]))
    data = []
    for lang, at, count in zip(rows["lang"], rows["idx"], rows["cnt"]):
        at, count = np.asarray(at, np.int64), np.asarray(count, float)
        if len(at):
            data.append((at, cfg.scale * count / count.sum() * idf[at], languages.index(lang)))
    size = 1 << cfg.bits
    apart = data[::4]
    weights = ftrl([d for k, d in enumerate(data) if k % 4] or data, size, len(languages), cfg)
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in apart])
    t = temperature(logits, np.array([label for *_, label in apart])) if apart else 1.0
    weights = weights / t
    weights[:-1] *= cfg.scale * idf[:, None]
    return Model(languages, weights.astype(np.float32), cfg.bits)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text)."""
    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in texts:
            some = batch.notna().to_numpy()
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            if some.any():
                p = m.scores(list(batch[some]))
                lang[some] = np.array(m.languages, object)[p.argmax(axis=1)]
                score[some] = p.max(axis=1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select("doc_id", run(text).alias("_r")).select("doc_id", "_r.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
