"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

A text becomes the TF-IDF weights of the 1- to 3-grams of its *shape* (letters by case, digits and blanks by
class, every other character itself) plus one feature for words that repeat the one before; shapes are the
same in all languages and carry what separates prose from tables, shouting, symbol noise and loops.  The
document frequencies are counted over all documents.  A bounded sample of labelled rows spans the latent
space (truncated SVD by subspace iteration) and gives the labelled vectors that are broadcast: at most
``max_labelled`` rows of ``rank`` floats, whatever the size of the corpus.  Every document is compared with
all of them by exact blocked cosine products and the ``neighbours`` nearest vote with their similarity.

Edge cases: a null or empty text resembles nothing and scores 0; labels that contradict each other for one
document are averaged; without any label every score is 0; rows without a ``doc_id`` are left out; repeated
rows are scored each; equal similarities are taken in the order of the labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.features import Shapes
from tablescout.llm.frequencies import document_frequencies, inverse
from tablescout.llm.words import fold, only, small_batches

FOLDS, HELD_OUT = 3, 1
BLOCK = 128


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    bits: int
    neighbours: int


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of the shares, times the idf, per row."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return (np.sqrt(counts / total) * idf).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def leading_directions(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    start = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 12, x.shape[1])))
    q = np.linalg.qr(start)[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, :rank]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, rank: int = 32, neighbours: int = 15,
        bits: int = 11) -> QualityModel | None:
    """The model from the labelled documents of the training folds; None if there are none.

    ``max_labelled`` bounds the labelled sample (the rows whose hashed id is smallest).
    """
    shapes = Shapes(bits)
    marked = (only(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
              .groupBy("doc_id").agg(F.avg("quality").alias("vote"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shapes.counts(t) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tolist() for a in at], pa.list_(pa.int64())),
                 pa.array([r[a].tolist() for r, a in zip(rows, at)], pa.list_(pa.int64()))], ["doc_id", "vote", "at", "n"])

    # At most max_labelled rows of two numbers, so the broadcast is bounded.
    texts = only(docs, "doc_id", "text").where(F.length("text") > 0)
    sample = (texts.join(F.broadcast(marked), "doc_id").select("doc_id", "vote", "text")
              .mapInArrow(vectorise, "doc_id long, vote double, at array<long>, n array<long>")
              .orderBy("doc_id", "at", "n").limit(max_labelled).collect())
    if not sample:
        return None
    idf = inverse(*document_frequencies(only(docs, "doc_id", "text"), "text", shapes.counts, shapes.width))
    counts = np.zeros((len(sample), shapes.width), np.float32)
    for i, r in enumerate(sample):
        counts[i, r["at"]] = r["n"]
    x = unit(weights(counts, idf))
    basis = leading_directions(x, rank)
    return QualityModel(idf.astype(np.float32), basis, unit(x @ basis), np.array([r["vote"] for r in sample], np.float32), bits, neighbours)


def nearest(like: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest values of each row in rising order; of equal values at the border the first ones."""
    least = -np.partition(-like, k - 1, axis=1)[:, k - 1:k]
    more, equal = like > least, like == least
    room = k - more.sum(axis=1, keepdims=True)
    chosen = more | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room)
    return np.nonzero(chosen)[1].reshape(len(like), k)


def vote(model: QualityModel, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of documents."""
    like = unit(weights(counts, model.idf) @ model.basis) @ model.vectors.T
    near = nearest(like, min(model.neighbours, like.shape[1]))
    w = np.maximum(np.take_along_axis(like, near, 1), 0)
    total = w.sum(axis=1)
    return np.divide((w * model.votes[near]).sum(axis=1), total, out=np.zeros(len(w), np.float32), where=total > 0).astype(np.float64)


def shared_model(docs: DataFrame, model: QualityModel) -> Broadcast:
    """The model as plain arrays: broadcasts are not pickled by value, and executors have no copy of this package."""
    return docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id, score`` of every document, from its text alone."""
    texts = only(docs, "doc_id", "text")
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))
    shared = shared_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*shared.value)
        shapes = Shapes(m.bits)
        for batch in batches:
            texts = batch.column(1)
            out = [vote(m, np.array([shapes.counts(t or "") for t in texts[i:i + BLOCK].to_pylist()], np.float32))
                   for i in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(np.concatenate(out), 0, 1) if out else np.empty(0))], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: QualityModel | None, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``; one pass without a shuffle.

    Without a model nothing can be judged, and every row with a ``doc_id`` stays.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared = shared_model(docs, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*shared.value)
        shapes = Shapes(m.bits)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                good = vote(m, np.array([shapes.counts(t or "") for t in part.column(at).to_pylist()], np.float32)) >= least
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def with_fold(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
