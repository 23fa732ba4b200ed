"""Language of every document by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; their 1- to 3-grams of characters are hashed to ``2**bits`` features, weighted by
``log(1 + count) * idf`` and scaled to length one.  Document frequencies are counted over all training
documents.  The weights are fitted with follow-the-regularised-leader on a bounded sample (``per_language``
rows of each language, ``max_rows`` in all, those with the smallest hashed ids) under an L1 and an L2
penalty; a fifth of the sample is kept out of that and calibrates one temperature.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
could be learned; rows without a ``doc_id`` are left out; repeated rows are predicted each; equal
probabilities go to the language that comes first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.features import code_points, gram_counts
from tablescout.llm.frequencies import document_frequencies, inverse
from tablescout.llm.words import fold, only

FOLDS, HELD_OUT = 3, 1
ORDERS = (1, 2, 3)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of one document, of length one."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, classes: int, alpha: float = 0.5,
                      beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: per coordinate, the weights that minimise all linearised losses so far plus both penalties."""
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], width), np.append(rows[i][1], 1.0)
            w = solve(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = solve(z, n)
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not fitted."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def fit(docs: DataFrame, per_language: int = 500, max_rows: int = 2000, bits: int = 14) -> LanguageModel | None:
    """The model from text and language of the training folds; None if no row can be learned from."""
    train = (only(docs, "doc_id", "text", "lang")
             .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold("doc_id", FOLDS) != HELD_OUT)))
    count = lambda t: gram_counts(code_points(t.lower()), ORDERS, bits)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    # About three times the rows that are wanted of each language go into the ranking, whatever the size of the corpus.
    share = 3 * per_language / F.col("n")
    few = (train.select("doc_id", "lang", F.xxhash64("doc_id").alias("key")).join(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang")
           .where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30)))
    chosen = (few.withColumn("rank", rank)
              .where(F.col("rank") <= per_language).orderBy("rank", "key", "doc_id", "lang").limit(max_rows).select("doc_id", "lang").distinct())

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count(t) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tolist() for a in at], pa.list_(pa.int32())),
                 pa.array([r[a].tolist() for r, a in zip(rows, at)], pa.list_(pa.int32()))], ["doc_id", "lang", "at", "n"])

    # At most max_rows rows of an id and a language, so the broadcast is bounded.
    sample = (train.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
              .mapInArrow(vectorise, "doc_id long, lang string, at array<int>, n array<int>")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "at", "n").limit(max_rows).toLocalIterator())
    raw = [(r["lang"], np.array(r["at"], np.int32), np.array(r["n"], np.float64)) for r in sample]
    if not raw:
        return None
    idf = inverse(*document_frequencies(train, "text", count, 1 << bits)).astype(np.float32)
    rows = []
    for _, at, n in raw:
        x = np.log1p(n) * idf[at]
        rows.append((at, x / np.linalg.norm(x)))
    languages = sorted({r[0] for r in raw})
    y = np.array([languages.index(r[0]) for r in raw])
    kept = np.arange(len(rows)) % 5 == 4
    used = np.flatnonzero(~kept)
    w, b = follow_the_leader([rows[i] for i in used], y[used], 1 << bits, len(languages))
    logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(kept)])
    return LanguageModel(languages, idf, w, b, temperature(logits, y[kept]), bits)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, from its text alone; score is the calibrated probability."""
    texts = only(docs, "doc_id", "text")
    if model is None:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    # As plain arrays: broadcasts are not pickled by value, and executors have no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))

    def one(m: LanguageModel, text: str | None) -> tuple[str, float]:
        if not letters(text):
            return "und", 0.0
        at, x = vector(gram_counts(code_points(text.lower()), ORDERS, m.bits), m.idf)
        p = softmax((x @ m.weights[at] + m.bias) / m.temperature)
        best = int(p.argmax())
        return m.languages[best], float(p[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for batch in batches:
            out = [one(m, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_fold(predictions: DataFrame) -> DataFrame:
    return predictions.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
