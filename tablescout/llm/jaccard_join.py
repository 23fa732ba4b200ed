"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Two sets of sizes a <= b with Jaccard similarity of at least t differ in at most H = a (1 - t) / t ... (see
``max_difference``) elements.  Sizes fall into bands; every band cuts the hash range of the shingles into
segments whose *allocations* sum to at least H + 1.  A segment of allocation 1 is indexed by a hash of the
subset of shingles that fall into it, one of allocation 2 (twice as wide) also by that of every
one-deletion neighbour.  If all segments differed by at least their allocation the sets would differ by more
than H, so similar sets share a signature.  Empty segments would match everybody; they count as allocation 0
and the plan holds spare segments for them.  Sets that even so do not reach H + 1 find each other by a second
family of signatures which includes empty segments.  The plan of each band is the cheapest by a cost model over
the size statistics of the whole corpus.

Signatures travel packed: tasks sort theirs, keep one leader for equal ones (so a hot signature costs a
task one entry) and send a block per bucket.  Receivers pair every member with the leader of its signature, in
constant memory.  Candidate pairs whose shingle counts per part of the hash range already differ too much are dropped
(the sum of those differences never exceeds the symmetric difference); the others are verified exactly on the whole
shingle sets, in three rounds that never form all pairs of a group of copies: each set with the leader it shares most with; then the remaining leaders
outside its component; at last the pairs of a signature's members that are still in different components.
Equal sets are one class throughout.

That last round leaves out what spare segments make needless: if the signatures of a set that more than ``HEAVY``
sets share (those of a passage that many documents quote) take up no more allocation than the set has to
spare, every similar set also shares one of its other signatures, and the frequent ones prove nothing new.

Edge cases: null, empty and blank texts have the empty set, which links with nothing; rows without a
``doc_id`` are left out; rows that repeat a ``doc_id`` are one document (the smallest text counts); further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.components import components
from tablescout.llm.words import GOLDEN, MIX_A, MIX_B, WordHashes, long, mix, one_row_per_id, only, raw, shingle_set
from tablescout.session import discard, durable

RATIO = 1.45
SPREAD = 128
FLUSH = 500_000
BUCKET = 1_000_000
#: Words and sets that a task remembers; two workers share an executor with its heap.
WORDS, SEEN = 150_000, 150_000
HEAVY = 8


def max_difference(size: int, percent: int) -> int:
    """Largest symmetric difference of a set of this size and a similar one that is not smaller."""
    return (size + 100 * size // percent) * (100 - percent) // (100 + percent)


def largest_difference(size: int, edges: np.ndarray, band: int, percent: int) -> int:
    """Largest difference between a set of this size and a similar one that looks for it in ``band``.

    In a lower band those are the sets of the band.  In its own band they also are larger ones, up to the largest similar
    size, which are indexed there as well and which a set at the top of its band meets nowhere else.
    """
    partner = 100 * size // percent
    if int(edges[band + 1]) - 1 < size:
        partner = int(edges[band + 1]) - 1
    return (size + partner) * (100 - percent) // (100 + percent)


def bands(top: int) -> np.ndarray:
    """First sizes of the bands, up to one beyond ``top``."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * RATIO))))
    return np.array(edges)


@dataclass(frozen=True)
class Plan:
    """Segments of a band: ``ones`` of allocation 1, ``twos`` of allocation 2; ``need`` is H + 1."""

    ones: int
    twos: int
    need: int


def allocate(low: int, high: int, sets: int, percent: int) -> Plan:
    """The cheapest plan for sizes low..high of which there are ``sets`` sets."""
    need = max_difference(high, percent) + 1
    best = None
    for twos in sorted({0, 1, 2, (need + 1) // 4, (need + 1) // 2}):
        ones = max(need - 2 * twos, 0)
        while True:
            units = ones + 2 * twos
            empty1, empty2 = (1 - 1 / units) ** low if units > 1 else 0.0, (1 - 2 / units) ** low if units > 2 else 0.0
            lost = ones * empty1 + 2 * twos * empty2
            short = need - units + lost  # above 0: a typical small set is not covered
            if short + 2 * np.sqrt(lost) <= 0 or ones > 4 * need + 8 or units >= 2 * low and short <= 0:
                break
            ones += 1 + ones // 50
        mid = (low + high) / 2
        signatures = ones + twos * (1 + 2 * mid / units)
        pairs = sets * (empty1 ** 2 * ones + empty2 ** 2 * twos) if short > 0 else 0.0
        cost = signatures + 0.1 * pairs
        if units >= need and (best is None or cost < best[0]):
            best = (cost, Plan(ones, twos, need))
    return best[1]


def signatures(s: np.ndarray, plan: Plan, band: int) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set in a band, and the allocation it reaches."""
    units = plan.ones + 2 * plan.twos
    slot = ((s >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)
    seg = np.where(slot < plan.ones, slot, plan.ones + (slot - plan.ones) // 2)
    values = mix(s + np.uint64(MIX_B))
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    ids, counts = seg[start], np.diff(np.append(start, len(seg)))
    sums = np.add.reduceat(values, start)
    own = np.uint64((band + 1) * MIX_A & (1 << 64) - 1)
    salt = mix((ids + 1).astype(np.uint64) * np.uint64(GOLDEN) + own)
    full = sums + salt
    out = [full]
    wide = np.repeat((ids >= plan.ones) & (counts > 1), counts)
    deletions = (np.repeat(full, counts) - values)[wide]
    out.append(deletions)
    reached = int(np.where(ids < plan.ones, 1, np.minimum(counts, 2)).sum())
    if reached < plan.need:  # the second family, with empty segments, for sets that are not covered
        alone = np.uint64(MIX_B)
        every = np.arange(plan.ones + plan.twos)
        base = mix((every + 1).astype(np.uint64) * np.uint64(GOLDEN) + own)
        base[ids] += sums
        out += [mix(base ^ alone), mix(deletions ^ alone)]
        single = (ids >= plan.ones) & (counts == 1)
        out.append(mix((full - sums)[single] ^ alone))
    return mix(np.unique(np.concatenate(out))), reached


def described(sets: list[np.ndarray]) -> tuple:
    """``n, s1, s2, v``: size, 128-bit hash and counts over the hash range of sets."""
    keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    # Counts beyond 255 read as 255, which only makes differences smaller.
    spread = [np.minimum(np.bincount((mix(s) >> np.uint64(57)).astype(np.int64), minlength=SPREAD), 255).astype(np.uint8).tobytes() for s in sets]
    halves = (np.array([k >> 64 for k in keys], np.uint64), np.array([k & (1 << 64) - 1 for k in keys], np.uint64))
    return keys, [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(long(h)) for h in halves], pa.array(spread, pa.binary())]


def leaders(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One entry per signature, that of its leader, and (signature, member, leader) for the others."""
    order = np.lexsort((mix(doc.astype(np.uint64)), sig))
    sig, doc = sig[order], doc[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
    lead = doc[first][np.cumsum(first) - 1] if len(sig) else doc
    rest = ~first & (doc != lead)
    return sig[first], doc[first], (sig[rest], doc[rest], lead[rest])


def pack_block(columns: list[np.ndarray]) -> bytes:
    """Signatures as they are, ids byte by byte, as their upper bytes hardly vary."""
    return columns[0].tobytes() + zlib.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns[1:]), 1)


def unpack_block(block: bytes, n: int, ids: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(block[8 * n:]), np.uint8).reshape(ids, 8, n)
    return [np.frombuffer(block, np.uint64, n), *[np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]]


SET = ("doc_id", "n", "s1", "s2", "v")
BLOCK = ("bucket", "entries", "block")


def entries(docs: DataFrame, plans: dict[int, Plan], edges: np.ndarray, buckets: int, words: int, percent: int) -> DataFrame:
    """One pass over the texts: a row per document that describes its set, and blocks of signatures per bucket.

    Signatures that already found a leader travel as members in buckets of their own.
    """

    def flush(sig: list, doc: list, spare: dict[int, int]) -> Iterator[pa.RecordBatch]:
        sig, doc, member = leaders(np.concatenate(sig), np.concatenate(doc))
        owner = np.fromiter(spare.keys(), np.int64, len(spare))
        spared = (mix(owner.astype(np.uint64)), owner, np.fromiter(spare.values(), np.int64, len(spare)))
        for kind, columns in ((0, (sig, doc)), (1, member), (2, spared)):
            key = columns[0] if kind == 0 else mix(columns[1].astype(np.uint64))  # members are dealt by themselves
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], [c[order] for c in columns]
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, int)
            end = np.append(start[1:], len(bucket))
            for i in range(0, len(start), 512):
                parts = list(zip(start[i:i + 512], end[i:i + 512]))
                none = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*none, pa.array(bucket[start[i:i + 512]] * 3 + kind), pa.array([b - a for a, b in parts], pa.int32()), pa.array([pack_block([c[a:b] for c in columns]) for a, b in parts], pa.binary())],
                    [*SET, *BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(WORDS), set()
        sig, doc, size, spare = [], [], 0, {}
        for batch in batches:
            sets = [shingle_set(text.lower().split(), hashes, words) for text in raw(batch.column(1))]
            keys, columns = described(sets)
            none = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *none], [*SET, *BLOCK])
            for d, s, key in zip(batch.column(0).to_pylist(), sets, keys):
                if not len(s):
                    continue
                if key in seen:  # an equal set of this task stands for it
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                band = int(np.searchsorted(edges, len(s), "right")) - 1
                while band >= 0 and 100 * (edges[band + 1] - 1) >= percent * len(s):
                    if band in plans:
                        found, reached = signatures(s, plans[band], band)
                        sig.append(found)
                        # Largest difference to a similar set that meets this one here, and what is left of the allocation.
                        most = largest_difference(len(s), edges, band, percent)
                        left = (reached - most - 1) // (2 if plans[band].twos else 1) if reached >= plans[band].need else -1
                        spare[d] = min(left, spare.get(d, left))
                        doc.append(np.full(len(sig[-1]), d, np.int64))
                        size += len(sig[-1])
                    band -= 1
                if size >= FLUSH:
                    yield from flush(sig, doc, spare)
                    sig, doc, size, spare = [], [], 0, {}
        if size:
            yield from flush(sig, doc, spare)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, v binary, bucket int, entries int, block binary")


def shared_signatures(blocks: DataFrame, partitions: int) -> DataFrame:
    """``sig, doc, leader`` for all but the leader of every signature that several documents have; and one row per document
    that stands for its set with ``spare``, how many of its signatures may be left out, and no leader."""

    def emit(parts: list, kind: int = 1) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if len(p[0])]
        if parts:
            sig, doc, lead = (np.concatenate(x) for x in zip(*parts))
            none = pa.nulls(len(sig), pa.int64())
            columns = [pa.array(long(sig)), pa.array(doc), pa.array(lead), none] if kind < 2 else [none, pa.array(doc), none, pa.array(lead)]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "doc", "leader", "spare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sigs, docs, size, kept = None, [], [], 0, 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal sigs, docs, size, kept
            if sigs:
                a, b, member = leaders(np.concatenate(sigs), np.concatenate(docs))
                yield from emit([member])
                sigs, docs, size, kept = [a], [b], len(a), len(a)

        for batch in batches:
            for bucket, n, block in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    yield from settle()
                    now, sigs, docs, size, kept = bucket, [], [], 0, 0
                if bucket % 3:
                    yield from emit([unpack_block(block, n, 2)], bucket % 3)
                    continue
                sig, doc = unpack_block(block, n, 1)
                sigs.append(sig)
                docs.append(doc)
                size += len(sig)
                if size - kept > BUCKET:
                    yield from settle()
        yield from settle()

    dealt = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "sig long, doc long, leader long, spare long")


def plausible(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v, ...`` whose counts over the hash range leave room for the similarity."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SPREAD).astype(np.int64) for c in batch.columns[-2:])
            apart = np.abs(a - b).sum(axis=1)
            size = sum(batch.column(names.index(c)).to_numpy() for c in ("nu", "nv"))
            rows = batch.select(range(len(names)))
            yield rows.filter(pa.array((100 + percent) * apart <= (100 - percent) * size))

    left = vectors.select(F.col("class_id").alias("u"), F.col("v").alias("counts_u"))
    right = vectors.select(F.col("class_id").alias("v"), F.col("v").alias("counts_v"))
    return (pairs.join(left, "u").join(right, "v").select(*names, "counts_u", "counts_v")
            .mapInArrow(run, pairs.schema))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` that are similar, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(WORDS), {}

        def items(doc: int, text: bytes) -> np.ndarray:
            if doc not in recent:
                if len(recent) >= 16:
                    recent.clear()
                recent[doc] = shingle_set(text.lower().split(), hashes, words)
            return recent[doc]

        for batch in batches:
            similar = []
            for u, v, tu, tv in zip(*(c.to_pylist() for c in batch.columns[:2]), *(raw(c) for c in batch.columns[2:])):
                a, b = items(u, tu), items(v, tv)
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                similar.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(similar, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("zu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("zv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "zu", "zv").mapInArrow(run, "u long, v long")


def likely_sizes(docs: DataFrame, words: int) -> tuple[int, dict[int, int]]:
    """A bound for the size of any set, and about how many sets there are by size, from the lengths of the texts.

    The counts only price the plans; which band a set belongs to follows from its own size.
    """
    length = F.octet_length("text")
    # Words of natural text take about six bytes; a text has at most every other byte as a word.
    guess = F.greatest(F.floor(length / 6) - (words - 1), F.lit(1))
    rows = docs.where(length > 0).groupBy(F.floor(F.log2(guess) * 4).alias("step")).agg(F.count(F.lit(1)).alias("k"), F.max(length).alias("longest")).collect()
    return max((r.longest // 2 + 1 for r in rows), default=1), {int(2 ** (r.step / 4)): r.k for r in rows}


def off_hub(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``hub, u, n, nh, linked, d, own, lost, n_own``: whether a set is similar to its hub, and how the two differ.

    ``d`` elements are in one of them only: the ``n_own`` elements ``own`` that the hub does not have, and elements that the set
    lacks, of which ``lost`` holds as many as a prefix can reach (see ``prefixes``).
    """

    def lists(found: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(long(np.concatenate([*found, np.empty(0, np.uint64)]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(WORDS), {}
        for batch in batches:
            own, lost, sizes = [], [], []
            for hub, u, h in zip(batch.column(0).to_pylist(), raw(batch.column(3)), raw(batch.column(4))):
                if hub not in recent:
                    if len(recent) >= 16:
                        recent.clear()
                    recent[hub] = shingle_set(h.lower().split(), hashes, words)
                s, t = shingle_set(u.lower().split(), hashes, words), recent[hub]
                own.append(s[t[np.minimum(np.searchsorted(t, s), len(t) - 1)] != s])
                missing = t[s[np.minimum(np.searchsorted(s, t), len(s) - 1)] != t]
                lost.append(missing[:max(0, len(s) * (100 - percent) // percent + 1 - len(own[-1]))])
                sizes.append((len(s), len(t), len(own[-1]) + len(missing), len(own[-1])))
            n, nh, d, n_own = np.array(sizes, np.int64).reshape(-1, 4).T
            linked = (100 + percent) * d <= (100 - percent) * (n + nh)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(nh), pa.array(linked), pa.array(d), lists(own), lists(lost), pa.array(n_own)],
                ["hub", "u", "n", "nh", "linked", "d", "own", "lost", "n_own"])

    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("zu"))
    right = texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("zh"))
    joined = members.join(left, "u").join(right, "hub").select("hub", "u", "n", "zu", "zh")
    return joined.mapInArrow(run, "hub long, u long, n long, nh long, linked boolean, d long, own array<long>, lost array<long>, n_own long")


def prefixes(offs: DataFrame, percent: int) -> DataFrame:
    """``hub, u, ..., p1, p2``: elements of the differences that a similar set must share one of.

    Let ``x`` not be similar to the hub ``h``: d(x) > f (n(x) + n(h)) with f = (100 - t) / (100 + t).  If ``v`` is similar to ``x``, at
    most f (n(x) + n(v)) elements differ, so d(x) and d(v) have more than (d(v) + f (n(h) - n(v))) / 2 in common, and also at least
    d(v) less the largest difference that any set similar to ``v`` can have.  With a common part of ``o`` elements, two sets share
    one of the first d - o + 1 elements in any common order.  The order has own elements first, rare ones before frequent ones, then
    those of the hub.  ``p1`` is that prefix for partners that are not linked to the hub, ``p2`` for any partner; both list elements
    with their places in the order.  Own elements that no other member has match nobody; they only take up places.
    """
    rows = offs.select("hub", "u", F.explode("own").alias("e"))
    often = rows.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = rows.join(often, ["hub", "e"]).groupBy("hub", "u").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("often"))
    any_ = F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * (100 - percent) / percent))
    half = F.floor((F.col("d") * (100 + percent) + (F.col("nh") - F.col("n")) * (100 - percent)) / (2 * (100 + percent))) + 1
    often_ = F.coalesce("often", F.array().cast("array<struct<k:bigint,e:bigint>>"))
    alone = F.col("n_own") - F.size(often_)
    placed = F.concat(F.transform(often_, lambda s, i: F.struct(s["e"].alias("e"), (alone + i + 1).alias("place"))),
                      F.transform("lost", lambda e, i: F.struct(e.alias("e"), (F.col("n_own") + i + 1).alias("place"))))

    def first(common: Column) -> Column:
        return F.filter("placed", lambda s: s["place"] <= F.col("d") - common + 1)

    kept = [c for c in offs.columns if c not in ("own", "lost")]
    both = offs.drop("own").join(shared, ["hub", "u"], "left").select(*kept, placed.alias("placed"))
    return both.select(*kept, first(F.greatest(any_, half)).alias("p1"), first(any_).alias("p2"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    spark = docs.sparkSession
    docs = one_row_per_id(only(docs, "doc_id", "text"))
    top, likely = likely_sizes(docs, words)
    edges = bands(top)
    counts = np.bincount(np.searchsorted(edges, list(likely), "right") - 1, weights=list(likely.values()), minlength=len(edges)) if likely else np.zeros(len(edges))
    plans = {b: allocate(int(edges[b]), int(edges[b + 1]) - 1, int(counts[b]), percent) for b in range(len(edges) - 1)}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, sum(size * k for size, k in likely.items()) // (2 * BUCKET))
    stored = durable(entries(docs, plans, edges, buckets, words, percent))
    known = durable(stored.where("doc_id is not null").select(*SET))
    classes = durable(known.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"), F.min("n").alias("n"), F.min("v").alias("v")))
    shared = durable(shared_signatures(stored.where("bucket is not null").select(*BLOCK), partitions))
    discard(stored)

    # From documents to classes of equal sets; n travels along for the size test.
    member = durable(known.where("n > 0").join(classes.select("s1", "s2", "class_id"), ["s1", "s2"]).select("doc_id", "class_id", "n"))
    m1 = member.select(F.col("doc_id").alias("doc"), F.col("class_id").alias("u"), F.col("n").alias("nu"))
    m2 = member.select(F.col("doc_id").alias("leader"), F.col("class_id").alias("v"), F.col("n").alias("nv"))
    hits = durable(shared.where("leader is not null").join(m1, "doc").join(m2, "leader").where("u != v").select("sig", "u", "v", "nu", "nv"))
    vectors = classes.select("class_id", "v")
    fits = f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"
    pairs = durable(plausible(hits.where(fits).select("u", "v", "nu", "nv").distinct(), vectors, percent))
    # Texts of the classes that share a signature with others; every comparison reads them from here.
    nodes = hits.select("u").union(hits.select("v")).distinct().withColumnRenamed("u", "doc_id")
    texts = durable(docs.join(nodes, "doc_id"))

    links = durable(verified(pairs.select("u", "v"), texts, words, percent))
    labels = durable(components(links))

    # Members of one signature that are still apart, beyond the leader that each has met.
    around = hits.select("sig", "u", F.col("nu").alias("n")).union(hits.select("sig", "v", "nv")).distinct()
    spare = (shared.where("spare is not null").join(m1.select("doc", "u"), "doc").groupBy("u").agg(F.max("spare").alias("spare")))
    component = labels.select(F.col("node").alias("u"), "component")
    around = durable(around.join(component, "u", "left").withColumn("c", F.coalesce("component", "u")).drop("component"))
    # The component with the most members of a signature needs no pairs inside; only the others look for partners.
    groups = (around.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k"))
              .groupBy("sig").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"), F.max_by("c", F.struct("k", "c")).alias("main")))
    around = around.join(groups.where(f"parts > 1 or size > {HEAVY}"), "sig")
    # As many frequent signatures as a set has to spare prove nothing new: the most frequent ones are left out.
    often = F.row_number().over(Window.partitionBy("u").orderBy((F.col("size") > HEAVY).desc(), F.desc("size"), "sig"))
    around = around.withColumn("often", often).join(spare, "u", "left")
    around = durable(around.where(f"parts > 1 and (size <= {HEAVY} or often > coalesce(spare, 0))").select("sig", "u", "n", "c", "main", "size"))
    few = around.where(f"size <= {HEAVY}")
    a = few.where("c != main").select("sig", "u", F.col("n").alias("nu"), F.col("c").alias("cu"))
    b = few.select("sig", F.col("u").alias("v"), F.col("n").alias("nv"), F.col("c").alias("cv"))
    left = a.join(b, "sig").where("cu != cv").where(fits).select("u", "v", "nu", "nv")
    tested = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    def untested(candidates: DataFrame) -> DataFrame:
        """Plausible pairs that were not looked at before, each once."""
        first = F.col("u") < F.col("v")
        once = candidates.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(first, F.col("nu")).otherwise(F.col("nv")).alias("nu"),
                                 F.when(first, F.col("nv")).otherwise(F.col("nu")).alias("nv")).distinct()
        return durable(plausible(once.join(tested, ["u", "v"], "left_anti").select("u", "v", "nu", "nv"), vectors, percent))

    # Members of frequent signatures by their differences from the hub, the member with the most frequent signatures.
    many = around.where(f"size > {HEAVY}")
    weight = many.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    hubs = many.join(weight, "u").groupBy("sig").agg(F.max_by("u", F.struct("k", F.xxhash64("u"))).alias("hub"))
    beside = durable(many.join(hubs, "sig").where("u != hub").select("hub", "u", "n").distinct())
    spent = [shared, hits, pairs, around, texts, classes, beside]
    if not beside.isEmpty():
        offs = durable(off_hub(beside, texts, words, percent))
        links = durable(links.unionByName(offs.where("linked").select("u", F.col("hub").alias("v"))))
        labels = durable(components(links))
        own = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        theirs = labels.select(F.col("node").alias("hub"), F.col("component").alias("ch"))
        placed = offs.join(own, "u", "left").join(theirs, "hub", "left").withColumns({"cu": F.coalesce("cu", "u"), "ch": F.coalesce("ch", "hub")})
        placed = durable(placed.withColumn("apart", ~F.col("linked") & (F.col("cu") != F.col("ch"))))
        rare = durable(prefixes(placed.join(placed.where("apart").select("hub").distinct(), "hub", "left_semi"), percent))
        spent += [offs, placed, rare]

        def side(rows: DataFrame, prefix: str, name: str) -> DataFrame:
            kept = rows.select("hub", F.explode(prefix).alias("p"), F.col("u").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "d", "cu")])
            return kept.select(*[c for c in kept.columns if c != "p"], "p.e", F.col("p.place").alias(f"place_{name}"))

        def together(a: DataFrame, b: DataFrame) -> DataFrame:
            sizes = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
            # If this is the first element that both have, no more than the shorter rest can follow.
            most = 1 + F.least(F.col("d_u") - F.col("place_u"), F.col("d_v") - F.col("place_v"))
            enough = (100 + percent) * (F.col("d_u") + F.col("d_v") - 2 * most) <= (100 - percent) * (F.col("n_u") + F.col("n_v"))
            joined = a.join(b.withColumnsRenamed({"hub": "hub_v", "e": "e_v"}), (F.col("hub") == F.col("hub_v")) & (F.col("e") == F.col("e_v")) & enough & sizes & (F.col("cu_u") != F.col("cu_v")))
            return joined.select("u", "v", F.col("n_u").alias("nu"), F.col("n_v").alias("nv"))

        out = rare.where("apart")
        left = (left.unionByName(together(side(out, "p1", "u"), side(rare.where("NOT linked"), "p1", "v")))
                .unionByName(together(side(out, "p2", "u"), side(rare.where("linked"), "p1", "v"))))
    left = untested(left)
    if not left.isEmpty():
        more = durable(verified(left.select("u", "v"), texts, words, percent))
        labels = durable(components(links.unionByName(more)))
    discard(*spent, left)
    found = member.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", F.coalesce("component", "class_id").alias("component"))
    return known.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
