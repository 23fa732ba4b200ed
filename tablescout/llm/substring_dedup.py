"""Removal of repeated passages by seed and extend over winnowed anchors.

*Seed.* Of the ``n - k + 1`` grams of ``k`` words in every window of ``n`` words the smallest hash is the
window's anchor (the last one of equals), so equal windows have equal anchors at equal offsets, and windows that
follow each other mostly share theirs: about one anchor in seven words.  Anchors that occur once need no more
work and leave at the first join.

*Extend.* Each occurrence of a shared anchor is extended both ways over all windows it anchors.  Occurrences
with the same extension form a class; all but the first of a class repeat that whole stretch.  Only the first
occurrences of anchors with several classes are compared window by window, by 128-bit keys.  A window that also
starts earlier is a repeat, and overlapping repeats of a document are merged into maximal ones.

Nothing is compared in pairs: a passage with any number of copies costs a row per copy, its groups are reduced
in the map tasks first, and joins on hot anchors are splittable by adaptive execution because both sides are
stored tables.

Edge cases: null and empty texts have no words; texts shorter than ``n`` words lose nothing; rows without a
``doc_id`` are left out; rows that repeat a ``doc_id`` are one document (the smallest text counts); further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.words import GOLDEN, MIX_A, WordHashes, gram_hashes, long, mix, one_row_per_id, only, raw, small_batches
from tablescout.session import discard, durable

MIN_WORDS, SEED_WORDS = 20, 8
PIECES = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


class RangeHashes:
    """Hash of any run of words of one text in constant time, from prefix sums."""

    def __init__(self, h: np.ndarray, factor: int, salt: int) -> None:
        factor |= 1
        up, down = np.full(len(h) + 1, factor, np.uint64), np.full(len(h) + 1, pow(factor, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)) * up[:-1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(h: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, position of the anchor, first and last window start of every run of windows with one anchor."""
    grams, w = gram_hashes(h, k), n - k + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    at = np.arange(w - 1, len(grams)) - np.argmin(views, axis=1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return grams[at[first]], at[first], first, last


def seeds(docs: DataFrame, n: int, k: int) -> DataFrame:
    """``anchor, ctx, doc_id, lo, hi``: anchors with the hash of the stretch that their windows lo..hi cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                h = hashes.of(text.split())
                if len(h) >= n:
                    a, at, lo, hi = anchors(h, n, k)
                    ctx = mix(RangeHashes(h, GOLDEN, 1)(lo, hi + n) + (at - lo).astype(np.uint64) * np.uint64(GOLDEN) + (hi - lo).astype(np.uint64))
                    out.append((a, ctx, np.full(len(a), doc), lo, hi))
            if out:
                a, ctx, doc, lo, hi = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(long(a)), pa.array(long(ctx)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                    ["anchor", "ctx", "doc_id", "lo", "hi"])

    return docs.mapInArrow(run, "anchor long, ctx long, doc_id long, lo int, hi int")


def window_keys(docs: DataFrame, n: int) -> DataFrame:
    """``k1, k2, doc_id, lo`` of every window whose start lies in one of the ranges of column ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc, text, ranges in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist()):
                h = hashes.of(text.split())
                lo = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges]))
                k1, k2 = RangeHashes(h, GOLDEN, 1)(lo, lo + n), RangeHashes(h, MIX_A, 2)(lo, lo + n)
                yield pa.RecordBatch.from_arrays([pa.array(long(k1)), pa.array(long(k2)), pa.array(np.full(len(lo), doc)),
                                                  pa.array(lo.astype(np.int32))], ["k1", "k2", "doc_id", "lo"])

    return docs.mapInArrow(run, "k1 long, k2 long, doc_id long, lo int")


def repeats(docs: DataFrame, n: int = MIN_WORDS, k: int = SEED_WORDS) -> DataFrame:
    """``doc_id, spans``: per document with repeats the word ranges [lo, end) whose windows also start earlier."""
    docs = one_row_per_id(only(docs, "doc_id", "text"))
    found = seeds(docs, n, k)
    shared = durable(found.groupBy("anchor").count().where("count > 1").select("anchor"))
    hits = durable(found.join(shared, "anchor"))
    discard(shared)
    classes = durable(hits.groupBy("anchor", "ctx").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("first")))
    copies = (hits.join(classes, ["anchor", "ctx"])
              .where("doc_id > first.doc_id or (doc_id = first.doc_id and lo > first.lo)")
              .select("doc_id", "lo", (F.col("hi") + n).alias("end")))
    several = durable(classes.groupBy("anchor").count().where("count > 1").select("anchor"))
    open_ = (classes.join(several, "anchor").select("first.*").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("open")))
    windows = durable(window_keys(docs.join(open_, "doc_id").select("doc_id", "text", "open"), n))
    firsts = durable(windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count(F.lit(1)).alias("c"))
                     .where("c > 1").drop("c"))
    dups = (windows.join(firsts, ["k1", "k2"]).where("doc_id > first.doc_id or (doc_id = first.doc_id and lo > first.lo)")
            .select("doc_id", "lo", (F.col("lo") + n).alias("end")))
    return copies.unionByName(dups).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))


def kept_words(count: int, spans: list[dict] | None) -> np.ndarray:
    """Which words stay."""
    edges = np.zeros(count + 1, np.int64)
    for s in spans or ():
        edges[s["lo"]] += 1
        edges[s["end"]] -= 1
    return np.cumsum(edges[:-1]) == 0


def digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sha = [], [], []
            for text, cut in zip(raw(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                kept = kept_words(len(words), cut)
                total.append(len(words))
                removed.append(len(words) - int(kept.sum()))
                sha.append(hashlib.sha256(b" ".join(compress(words, kept.tolist()) if cut else words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = one_row_per_id(only(docs, "doc_id", "text"))
    return docs.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: bytes, spans: list[dict] | None) -> bytes:
    """The text without the words of the spans; what stands between the other words stays."""
    if not spans:
        return text
    pieces = PIECES.findall(text)
    return b"".join(compress(pieces, kept_words(len(pieces), spans).tolist()))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The same rows and columns with the spans cut out of ``text`` (and ``n_chars``, if there, set to its length)."""
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            cuts = batch.column(len(columns)).to_pylist()
            texts = [t and without(t, s) for t, s in zip(columns[text].cast(pa.large_binary()).to_pylist(), cuts)]
            if chars is not None:
                count = columns[chars].to_pylist()
                columns[chars] = pa.array([len(t.decode()) if t is not None and s else n for t, s, n in zip(texts, cuts, count)], columns[chars].type)
            columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    free = "spans_of" + max(names, key=len)  # no column of the table is called so
    d, s = docs.alias("d"), spans.alias("s")
    joined = d.join(s, F.col("d.doc_id") == F.col("s.doc_id"), "left").select(*[F.col(f"d.`{c}`") for c in names], F.col("s.spans").alias(free))
    return joined.mapInArrow(run, schema)
