"""Katz backoff bigram model with Good-Turing discounts, trained on and evaluated over whole corpora.

Tokens are lower-cased words and one end token per text; a text's first word follows a start mark.  Counts of
up to ``CUT`` occurrences are discounted by Good-Turing with Katz's renormalisation; what an order frees goes to
the order below, times the weight that makes the probabilities after every word sum to exactly one.  The unigram
order keeps its freed mass for all unknown words together.  A token is evaluated recursively: the discounted
bigram if it was seen, else the backoff weight of its history times the unigram.

The tables are partitioned by history.  Tasks send every bucket its bigrams as one compressed block (a local
dictionary of word hashes, sorted positions in it, and the document of every occurrence), which costs a few
bytes a token.  A bucket then holds whole histories, so it counts bigrams exactly, asks the unigram table for
the words it holds, and evaluates each occurrence.  Histories that are frequent in the whole corpus (at most
``MAX_FREQUENT`` of them can be) are spread over several buckets by the following word, and their sums over all
successors are added up between two passes over the same shuffle.  Bigrams that are as frequent themselves are counted
before, and their occurrences go to further buckets by document, so no bucket grows with one bigram.  A bucket sends the sums of its documents
as one block per group of documents.

If the count-of-counts do not give proper Good-Turing discounts (small or odd corpora) half an occurrence is
taken off instead, and an order that would free nothing frees 1 / (count + 1).

Edge cases: a null text is empty, that is the end token alone; rows without a ``doc_id`` are left out; rows that
repeat a ``doc_id`` are one document (the smallest text counts); without any training document every
probability is that of the unknown word, and the score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.words import TextHashes, long, mix, one_row_per_id, only
from tablescout.session import durable

CUT = 5
FLUSH = 2_000_000
BUCKET = 1_500_000
#: Sums of logarithms travel as whole multiples of 2 ** -SCALE, so they do not depend on the order of addition.
SCALE = 36
MAX_FREQUENT = 4_000
#: Hashes of the two marks (fixed values).
END, START = 0x656E64, 0x7374617274


def discounts(n: dict[int, int]) -> np.ndarray:
    """Factor of a count of r at place r, 1 from ``CUT + 1`` on; n: how many types occur r times."""
    out = np.ones(CUT + 2)
    n1, last = n.get(1, 0), (CUT + 1) * n.get(CUT + 1, 0)
    for r in range(1, CUT + 1):
        d = -1.0
        if n1 and n.get(r, 0) and last < n1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - last / n1) / (1 - last / n1)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """What is known of the whole corpus: tokens, types, discounts and the mass of unknown words."""

    total: int
    types: int
    documents: int
    factors: np.ndarray
    shrink: float
    unknown: float

    def probability(self, c: np.ndarray) -> np.ndarray:
        seen = self.factors[np.minimum(c, CUT + 1).astype(np.int64)] * c / max(self.total, 1) * self.shrink
        return np.where(c > 0, seen, self.unknown)


def unigram_model(counts: dict[int, int], total: int, types: int, documents: int) -> Unigrams:
    factors = discounts(counts)
    freed = sum(n * (1 - factors[r]) * r for r, n in counts.items() if r <= CUT) / max(total, 1)
    shrink = 1.0 if freed > 1e-12 else total / (total + 1)
    return Unigrams(total, types, documents, factors, shrink, freed if freed > 1e-12 else 1 / (total + 1))


def token_hashes(texts: pa.Array, hashes: TextHashes) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts one after another, and how many each text has."""
    words, lengths = hashes.of(texts)
    lengths = lengths + 1
    out = np.full(len(words) + len(lengths), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = words
    return out, lengths


def before(values: np.ndarray, lengths: np.ndarray, mark) -> np.ndarray:
    """What stands before each token of a text; ``mark`` before its first."""
    out = np.roll(values, 1)
    out[np.cumsum(lengths) - lengths] = mark
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; of 64-bit values a sort finds them sooner than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def plain(column: pa.Array, kind) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def unigram_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: how often each token occurs in the training documents; tasks send each word once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, size = TextHashes(), [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(long(h)), pa.array(c)], ["h", "c"])

        for batch in batches:
            parts.append(token_hashes(batch.column(1), hashes)[0])
            size += len(parts[-1])
            if size >= FLUSH:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def pack_block(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, train: np.ndarray) -> bytes:
    """Occurrences sorted by history and next word, over a local dictionary."""
    words, at = np.unique(np.concatenate([w1, w2]), return_inverse=True)
    first, second = at[:len(w1)], at[len(w1):]
    docs, local = np.unique(doc, return_inverse=True)
    known = np.zeros(len(docs), np.uint8)
    known[local] = train
    order = np.lexsort((local, first * len(words) + second))
    columns = [(np.diff(first[order], prepend=0)), second[order], local[order]]
    body = b"".join(c.astype(np.uint32).tobytes() if m > 65535 else c.astype(np.uint16).tobytes()
                    for c, m in zip(columns, (len(words), len(words), len(docs))))
    head = np.array([len(words), len(docs), len(w1)], np.int64).tobytes()
    # The ids byte by byte: they are sorted, and their upper bytes hardly vary.
    planes = docs.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return head + words.tobytes() + zlib.compress(known.tobytes() + planes + body, 1)


def unpack_block(block: bytes) -> tuple[np.ndarray, ...]:
    """The block's words, its occurrences as places of both words among them, its documents with whether each is for
    training, and the place of each occurrence's document."""
    words, docs, n = (int(x) for x in np.frombuffer(block, np.int64, 3))
    h = np.frombuffer(block, np.uint64, words, 24)
    body = zlib.decompress(block[24 + 8 * words:])
    known, at, out = np.frombuffer(body, np.uint8, docs), 9 * docs, []
    ids = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * docs, docs).reshape(8, docs).T).view(np.int64).ravel()
    for m in (words, words, docs):
        kind = np.uint32 if m > 65535 else np.uint16
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return h, np.cumsum(out[0], dtype=np.int64), out[1], ids, known, out[2]


@dataclass
class Hot:
    """Bigrams too frequent for one bucket, sorted by key, with their training counts."""

    keys: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, w1: np.ndarray, w2: np.ndarray, c: np.ndarray) -> Hot:
        keys = mix(mix(w1) + w2)
        order = np.argsort(keys)
        return cls(keys[order], w1[order], w2[order], c[order])

    def place(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Place of each bigram, -1 where it is not one of these."""
        if not len(self.keys):
            return np.full(len(w1), -1)
        at = np.minimum(np.searchsorted(self.keys, mix(mix(w1) + w2)), len(self.keys) - 1)
        return np.where((self.w1[at] == w1) & (self.w2[at] == w2), at, -1)


def frequent_pairs(docs: DataFrame, names: np.ndarray) -> DataFrame:
    """``a, b, n, c``: all and training occurrences of the bigrams of two frequent words; tasks send each once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, size = TextHashes(), [], 0
        mark = int(np.searchsorted(names, np.uint64(START)))

        def flush() -> pa.RecordBatch:
            words, lengths, train = (np.concatenate(x) for x in zip(*rows))
            second = np.minimum(np.searchsorted(names, words), len(names) - 1)
            second = np.where(names[second] == words, second, -1)
            first = before(second, lengths, mark)
            both = (first >= 0) & (second >= 0)
            code, which = np.unique(first[both] * len(names) + second[both], return_inverse=True)
            n, c = np.bincount(which, minlength=len(code)), np.bincount(which, np.repeat(train, lengths)[both], len(code)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(long(names[code // len(names)])), pa.array(long(names[code % len(names)])), pa.array(n), pa.array(c)],
                                              ["a", "b", "n", "c"])

        for batch in batches:
            rows.append((*token_hashes(batch.column(0), hashes), plain(batch.column(1), bool)))
            size += len(rows[-1][0])
            if size >= FLUSH:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return docs.select("text", "train").mapInArrow(run, "a long, b long, n long, c long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def bigram_blocks(docs: DataFrame, buckets: int, frequent: dict[int, int], hot: Hot, more: int) -> DataFrame:
    """``bucket, block`` with every bigram occurrence of all documents, those of hot bigrams in ``more`` buckets behind the
    others; column ``train`` says which to learn from."""
    names = np.array(sorted(frequent), np.uint64)
    parts = np.array([frequent[int(w)] for w in names], np.uint64)

    def bucket_of(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        key = mix(w1)
        if len(names):
            at = np.minimum(np.searchsorted(names, w1), len(names) - 1)
            key = np.where(names[at] == w1, mix(key + mix(w2) % parts[at]), key)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        if more:
            bucket = np.where(hot.place(w1, w2) >= 0, buckets + (mix(doc.astype(np.uint64)) % np.uint64(more)).astype(np.int64), bucket)
        return bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, size = TextHashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            w2, lengths, doc, train = (np.concatenate(x) for x in zip(*rows))
            w1, doc, train = before(w2, lengths, START), np.repeat(doc, lengths), np.repeat(train, lengths)
            bucket = bucket_of(w1, w2, doc)
            # Small numbers are sorted digit by digit.
            order = np.argsort(bucket.astype(np.uint16) if buckets + more <= 65536 else bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets + more))
            for a, b in zip(edges, edges[1:]):
                o = order[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[o[0]])], pa.int32()), pa.array([pack_block(w1[o], w2[o], doc[o], train[o])], pa.binary())], ["bucket", "block"])

        for batch in batches:
            rows.append((*token_hashes(batch.column(1), hashes), plain(batch.column(0), np.int64), plain(batch.column(2), bool)))
            size += len(rows[-1][0])
            if size >= FLUSH:
                yield from flush()
                rows, size = [], 0
        if rows:
            yield from flush()

    return docs.select("doc_id", "text", "train").mapInArrow(run, "bucket int, block binary")


@dataclass
class Bucket:
    """The distinct words and bigrams of a bucket, with the bigrams' training counts in the whole corpus and whether they are
    hot, and every occurrence's bigram and document.  Words are sorted by hash; a bigram is the place of its first word,
    times the number of words, plus the place of its second."""

    words: np.ndarray
    keys: np.ndarray
    c: np.ndarray
    hot: np.ndarray
    docs: np.ndarray
    doc: list[np.ndarray]
    every: list[np.ndarray]

    @classmethod
    def of(cls, blocks: pa.Table, hot: Hot) -> Bucket:
        parts = [unpack_block(b) for b in blocks.column("block").to_pylist()]
        words, docs = (distinct(np.concatenate([p[i] for p in parts])) for i in (0, 3))
        every, doc, marked = [], [], []
        for h, first, second, ids, known, local in parts:
            at = np.searchsorted(words, h)
            every.append(at[first] * len(words) + at[second])
            doc.append(np.searchsorted(docs, ids)[local])
            marked.append(every[-1] * 2 + known[local])
        marked = np.sort(np.concatenate(marked))
        new = np.flatnonzero(np.diff(marked >> 1, prepend=-1))
        keys, c = marked[new] >> 1, np.add.reduceat(marked & 1, new).astype(float)
        place = np.full(len(keys), -1)
        if len(hot.keys):
            first, second = np.divmod(keys, len(words))
            place = hot.place(words[first], words[second])
            c = np.where(place >= 0, hot.c[place], c)
        return cls(words, keys, c, place >= 0, docs, doc, every)


SIDE = "bucket int, kind int, h long, a double"


def requests(blocks: DataFrame, hot: Hot) -> DataFrame:
    """Kind 0: the words that a bucket has to know; kind 1: how many bigrams occur h times, up to ``CUT + 1``."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        own = Bucket.of(table, hot)
        words = own.words
        r, n = np.unique(own.c[(own.c > 0) & (own.c <= CUT + 1)].astype(np.int64), return_counts=True)
        size = len(words) + len(r)
        return pa.table({"bucket": pa.array(np.full(size, bucket, np.int32)), "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(words), len(r)])),
                         "h": pa.array(np.concatenate([long(words), r])), "a": pa.array(np.concatenate([np.zeros(len(words)), n.astype(float)]))})

    return blocks.groupBy("bucket").applyInArrow(run, SIDE)


def solve(blocks: pa.Table, side: pa.Table, unigrams: Unigrams, hot: Hot):
    """Per distinct bigram its discounted probability (0 if unseen) and the unigram count of its second word; per
    history its place in ``names`` and its two sums over seen successors, without the hot ones."""
    own = Bucket.of(blocks, hot)
    kind, h, a = (side.column(c).to_numpy() for c in ("kind", "h", "a"))
    known = kind == 0
    counts = np.zeros(len(own.words))
    counts[np.searchsorted(own.words, h[known].view(np.uint64))] = a[known]
    factors = discounts({int(r): int(n) for r, n in zip(h[kind == 1], a[kind == 1])})
    first, second = np.divmod(own.keys, len(own.words))
    c1, c2 = counts[first], counts[second]
    p = factors[np.minimum(own.c, CUT + 1).astype(np.int64)] * own.c / np.maximum(c1, 1)
    low = unigrams.probability(counts)[second]
    new = np.diff(first, prepend=-1) > 0
    history = np.cumsum(new) - 1
    seen = (own.c > 0) & ~own.hot
    high_sum, low_sum = np.bincount(history, p * seen, new.sum()), np.bincount(history, low * seen, new.sum())
    names = own.words[first[new]]
    if "low" in side.column_names:  # sums of spread histories over all their buckets
        high, whole = (side.column(c).to_numpy() for c in ("high", "low"))
        at = np.flatnonzero(~np.isnan(high))
        at = at[np.argsort(h[at])]
        if len(at):
            place = at[np.minimum(np.searchsorted(h[at], long(names)), len(at) - 1)]
            hit = h[place] == long(names)
            high_sum, low_sum = np.where(hit, high[place], high_sum), np.where(hit, whole[place], low_sum)
    return own, p, c1, c2, low, history, names, high_sum, low_sum


def planes(columns: list[np.ndarray]) -> bytes:
    """Whole numbers byte by byte, as their upper bytes hardly vary."""
    return zlib.compress(b"".join(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), 1)


def document_sums(own: Bucket, p, c1, c2, low, history, high_sum, low_sum, unigrams: Unigrams, groups: int) -> pa.Table:
    """``part, block``: per group of documents their tokens, known tokens, and summed base and model log10 probabilities."""
    c = c1[np.concatenate([[True], history[1:] != history[:-1]])]
    none = (c > 0) & (1 - high_sum <= 1e-12)  # nothing was freed
    shrink = np.where(none, c / (c + 1), 1.0)
    weight = np.where(c > 0, (1 - high_sum * shrink) / np.maximum(1 - low_sum, 1e-300), 1.0)
    model = np.where(own.c > 0, p * shrink[history], weight[history] * low)
    base = (c2 + 1) / (unigrams.total + unigrams.types + 1)
    docs, local, at = own.docs, np.concatenate(own.doc), np.concatenate([np.searchsorted(own.keys, e) for e in own.every])
    total = lambda x: np.bincount(local, x[at], len(docs))
    exact = lambda x: np.rint(total(np.log10(x)) * 2.0 ** SCALE)
    columns = [docs, np.bincount(local, minlength=len(docs)), total((c2 > 0).astype(float)), exact(base), exact(model)]
    part = (mix(docs.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=groups))
    blocks = [planes([c[order[a:b]] for c in columns]) for a, b in zip(edges, edges[1:])]
    return pa.table({"part": pa.array(part[order[edges[:-1]]]), "block": pa.array(blocks, pa.binary())})


SUMS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def added_up(table: pa.Table) -> pa.Table:
    """The sums of each document over all buckets."""
    blocks = [np.frombuffer(zlib.decompress(b), np.uint8) for b in table.column("block").to_pylist()]
    rows = np.concatenate([np.ascontiguousarray(b.reshape(5, 8, -1).transpose(0, 2, 1)).view(np.int64).reshape(5, -1) for b in blocks], axis=1)
    order = np.argsort(rows[0], kind="stable")
    rows = rows[:, order]
    first = np.flatnonzero(np.diff(rows[0], prepend=rows[0][0] - 1))
    docs, values = rows[0][first], np.add.reduceat(rows[1:], first, axis=1)
    return pa.table({"doc_id": pa.array(docs), "n_tokens": pa.array(values[0]), "n_known": pa.array(values[1]),
                     "base_score": pa.array(values[2] / 2.0 ** SCALE), "score": pa.array(values[3] / 2.0 ** SCALE)})


def score(docs: DataFrame, train) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``; ``train`` is a condition on doc_id."""
    spark = docs.sparkSession
    docs = one_row_per_id(only(docs, "doc_id", "text")).withColumn("train", train)
    table = durable(unigram_counts(docs.where("train")))
    total, types, documents = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)),
                                        F.coalesce(F.max(F.when(F.col("h") == END, F.col("c"))), F.lit(0))).first()
    if not total:
        tokens = F.when(F.col("text").isNull(), 1).otherwise(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")) + 1).cast("long")
        return docs.select("doc_id", "train", tokens.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"),
                           F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    counts = {r["c"]: r["count"] for r in table.where(F.col("c") <= CUT + 1).groupBy("c").count().collect()}
    unigrams = unigram_model(counts, total, types, documents)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-total // BUCKET))
    # Words above this share; there are fewer than MAX_FREQUENT of them in any corpus.
    least = max(BUCKET // 16, total // MAX_FREQUENT + 1)
    often = {r["h"] & (1 << 64) - 1: r["c"] for r in table.where(F.col("c") > least).collect()}
    often.setdefault(START, documents)
    frequent = {h: -(-8 * c // BUCKET) + 1 for h, c in often.items()}
    names = np.array(sorted(frequent), np.uint64)
    # Bigrams above that share too, which both of their words then are; their counts need no discount.
    pairs = frequent_pairs(docs, names).where((F.col("n") > least) & (F.col("c") > CUT + 1)).collect() if len(names) > 1 else []
    column = lambda c: np.array([r[c] for r in pairs], np.int64)
    hot = Hot.of(column("a").view(np.uint64), column("b").view(np.uint64), column("c").astype(float))
    more = -(-sum(r["n"] for r in pairs) // BUCKET)
    c1, c2 = (np.array([often[int(h)] for h in w], float) for w in (hot.w1, hot.w2))
    known = [(int(h), float(p), float(low)) for h, p, low in zip(long(hot.w1), hot.c / c1, unigrams.probability(c2))]

    blocks = bigram_blocks(docs, buckets, frequent, hot, more).repartition(partitions, "bucket")
    asked = requests(blocks, hot)
    counted = table.unionByName(spark.createDataFrame([(START, documents)], "h long, c long"))
    words = asked.where("kind = 0").join(counted, "h").select("bucket", "kind", "h", F.col("c").cast("double").alias("a"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(buckets + more - 1)))
    ranks = asked.where("kind = 1").groupBy("kind", "h").agg(F.sum("a").alias("a")).select(spread.alias("bucket"), "kind", "h", "a")
    side = words.unionByName(ranks).repartition(partitions, "bucket")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("h", pa.int64()), ("a", pa.float64()), ("b", pa.float64()))})
        *_, own, high, low = solve(left, right, unigrams, hot)
        wide = np.isin(own, names)
        return pa.table({"h": pa.array(long(own[wide])), "a": pa.array(high[wide]), "b": pa.array(low[wide])})

    # One row per spread history, at most MAX_FREQUENT + 1 of them, so the broadcast is bounded and nothing is dealt anew.
    parts = blocks.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(sums, "h long, a double, b double")
    if known:  # each hot bigram once
        parts = parts.unionByName(spark.createDataFrame(known, "h long, a double, b double"))
    wide = (parts.groupBy("h").agg(F.sum("a").alias("high"), F.sum("b").alias("low")).withColumn("kind", F.lit(0)))

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.binary())})
        own, p, c1, c2, low, history, _, high, lows = solve(left, right, unigrams, hot)
        return document_sums(own, p, c1, c2, low, history, high, lows, unigrams, partitions)

    nan = F.lit(float("nan"))
    whole = side.join(F.broadcast(wide), ["kind", "h"], "left").select("bucket", "kind", "h", "a", F.coalesce("high", nan).alias("high"), F.coalesce("low", nan).alias("low"))
    parts = blocks.groupBy("bucket").cogroup(whole.groupBy("bucket")).applyInArrow(evaluate, "part int, block binary")
    sums_ = parts.repartition(partitions, "part").groupBy("part").applyInArrow(added_up, SUMS)
    return sums_.select("doc_id", train.alias("train"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
