"""Nearest vectors by beam search over robust-pruned directed graphs, one graph per shard.

Equal vectors are one node.  Nodes are dealt to shards of bounded size by a hash of their components; every
shard builds its graph in one task: greedy searches from the centre propose neighbours for batches of nodes, and
a proposal is dropped if a nearer kept neighbour is closer to it than the node by a factor ``alpha`` (relaxed
pruning, which keeps long edges), first with 1 and then with the full factor; edges are added in both directions.
Largest inner product becomes smallest distance by one more component that gives all indexed vectors the same
length.  The query set travels in blocks to every shard; each block is searched with one beam per query in
lockstep, candidates are scored exactly on the original vectors in double precision, and the best of all shards
are ranked.  Shards of at most ``EXHAUSTIVE`` nodes are scored whole.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite components take no part; vectors
are compared with those of the same length only; rows without a ``vec_id`` are left out; rows that repeat a
``vec_id`` are one (the smallest of its vectors that take part counts); ties go to the smaller ``vec_id``: each node keeps its ``k + 1``
smallest ids, more of them can never be in a result of k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.words import one_row_per_id, only
from tablescout.session import durable

SHARD = 4096
BLOCK = 1024
EXHAUSTIVE = 256


@dataclass(frozen=True)
class Settings:
    degree: int = 24
    build_beam: int = 48
    search_beam: int = 96
    alpha: float = 1.2
    batch: int = 256


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to its own rows of x (rows, many, dim)."""
    diff = x - q[:, None, :]
    return np.einsum("abd,abd->ab", diff, diff)


def beam_search(graph: np.ndarray, x: np.ndarray, q: np.ndarray, entry: int, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first, -1 where there are fewer, and their distances."""
    rows = len(q)
    ids, near = np.full((rows, beam), -1), np.full((rows, beam), np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    visited = np.zeros((rows, len(x)), bool)
    ids[:, 0], done[:, 0], visited[:, entry] = entry, False, True
    near[:, 0] = ((q - x[entry]) ** 2).sum(axis=1)
    while True:
        open_ = np.where(done, np.inf, near)
        active = np.flatnonzero(np.isfinite(open_).any(axis=1))
        if not len(active):
            return ids, near
        order = np.argsort(open_[active], axis=1)[:, :expand]
        usable = np.isfinite(np.take_along_axis(open_[active], order, 1))
        picked = np.where(usable, np.take_along_axis(ids[active], order, 1), -1)
        done[active[:, None], order] = True
        found = np.where((picked >= 0)[:, :, None], graph[picked], -1).reshape(len(active), -1)
        found.sort(axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        fresh &= ~visited[active[:, None], found]
        visited[active[:, None], np.where(fresh, found, entry)] = True
        d = np.where(fresh, distances(q[active], x[found]), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[active], np.where(fresh, found, -1)], axis=1)
        all_near = np.concatenate([near[active], d], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        best = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        ids[active], near[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_near, all_done))
        done[active] |= ~np.isfinite(near[active])


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node among its proposals (-1: none)."""
    vectors = x[proposed]
    near = np.where((proposed < 0) | (proposed == nodes[:, None]), np.inf, distances(x[nodes], vectors))
    order = np.argsort(near, axis=1, kind="stable")
    near, proposed = np.take_along_axis(near, order, 1), np.take_along_axis(proposed, order, 1)
    vectors = x[proposed]
    alive, out = np.isfinite(near), np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for i in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, i] = proposed[rows, first][some]
        gap = distances(vectors[rows, first], vectors)
        alive &= alpha * alpha * gap > near
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, s: Settings, seed: int = 3) -> tuple[np.ndarray, int]:
    """Neighbour lists and the entry node."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = rng.integers(0, n, (n, s.degree))
    for alpha in (1.0, s.alpha):
        order = rng.permutation(n)
        for start in range(0, n, s.batch):
            nodes = order[start:start + s.batch]
            found, _ = beam_search(graph, x, x[nodes], entry, s.build_beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), s.degree, alpha)
            # Edges back: each new neighbour is offered the node.
            source, target = np.repeat(nodes, s.degree), graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.lexsort((((x[source] - x[target]) ** 2).sum(axis=1), target))
            source, target = source[by], target[by]
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
            heads = target[first]
            offered = np.full((len(heads), s.degree), -1)
            fits = place < s.degree  # the nearest offers; pruning would keep no more than degree
            offered[np.searchsorted(heads, target[fits]), place[fits]] = source[fits]
            for a in range(0, len(heads), 512):
                h = heads[a:a + 512]
                graph[h] = robust_prune(x, h, np.concatenate([graph[h], offered[a:a + 512]], axis=1), s.degree, alpha)
    return graph, entry


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that makes all of them ``longest`` long."""
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int, settings: Settings) -> DataFrame:
    """``dim, shard, n, index``: one packed graph per shard, stored; ``vectors`` has vec_id, v (doubles) and dim."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = durable(vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("dim", "v")
                    .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # One row per vector length reaches the driver and goes back with every node.
    sizes = (nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"),
                                      F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")))
    dealt = nodes.join(durable(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), "shards").cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        x = np.array(table.column("v").to_pylist(), np.float64)
        order = np.lexsort(x.T[::-1])  # the same graph whatever the order of arrival
        x, ids = x[order], [ids[i] for i in order]
        graph, entry = build_graph(lifted(x, table.column("longest")[0].as_py() ** 0.5), settings) if len(x) > EXHAUSTIVE else (np.empty((0, settings.degree), int), 0)
        counts = np.array([len(i) for i in ids], np.int64)
        blob = (np.array([len(x), entry, counts.sum()], np.int64).tobytes() + x.tobytes() + counts.tobytes()
                + np.concatenate(ids).astype(np.int64).tobytes() + graph.astype(np.int32).tobytes())
        return pa.table({c: table.column(c)[:1] for c in ("dim", "shard", "shards", "longest")} | {"index": pa.array([blob], pa.binary())})

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(dealt.repartition(parts, "dim", "shard").groupBy("dim", "shard")
                   .applyInArrow(run, "dim int, shard int, shards int, longest double, index binary"))


def unpack_index(blob: bytes, dim: int, degree: int) -> tuple:
    n, entry, many = (int(v) for v in np.frombuffer(blob, np.int64, 3))
    at = 24
    x = np.frombuffer(blob, np.float64, n * dim, at).reshape(n, dim)
    counts = np.frombuffer(blob, np.int64, n, at := at + x.nbytes)
    ids = np.frombuffer(blob, np.int64, many, at := at + counts.nbytes)
    graph = np.frombuffer(blob, np.int32, offset=at + ids.nbytes).reshape(-1, degree)
    return x, np.append(0, np.cumsum(counts)), ids, graph, entry


def best_of(query: int, scores: np.ndarray, nodes: np.ndarray, starts: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of the candidate nodes for a query, without the query itself."""
    counts = starts[nodes + 1] - starts[nodes]
    rows = np.repeat(starts[nodes], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    found, value = ids[rows], np.repeat(scores, counts)
    value, found = value[found != query], found[found != query]
    order = np.lexsort((found, -value))[:k]
    return found[order], value[order]


def search(vectors: DataFrame, queries: DataFrame, index: DataFrame, k: int, settings: Settings) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows found for every query."""
    spark = vectors.sparkSession
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int"), F.lit(1))
    sizes = durable(queries.groupBy("dim").agg(blocks.alias("blocks")))

    def gather(table: pa.Table) -> pa.Table:
        q = np.array(table.column("v").to_pylist(), np.float64)
        blob = table.column("vec_id").to_numpy().astype(np.int64).tobytes() + q.tobytes()
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "queries": pa.array([blob], pa.binary())})

    gathered = (queries.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
                .select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(gather, "dim int, block int, queries binary"))
    shards = index.select("dim", "shards").distinct()
    sent = gathered.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, longest, queries, blob in zip(*(c.to_pylist() for c in batch.columns)):
                x, starts, ids, graph, entry = unpack_index(blob, dim, settings.degree)
                m = len(queries) // (8 * dim + 8)
                q_ids, q = np.frombuffer(queries, np.int64, m), np.frombuffer(queries, np.float64, offset=8 * m).reshape(m, dim)
                base = lifted(x, longest ** 0.5)
                out: list[list] = [[], [], []]
                for a in range(0, m, settings.batch):
                    part = q[a:a + settings.batch]
                    if len(x) <= EXHAUSTIVE:
                        found = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
                    else:
                        # Rank by distance does not change if a query is scaled, so it gets the common length too.
                        scaled = part * (longest ** 0.5 / np.linalg.norm(part, axis=1, keepdims=True))
                        found, _ = beam_search(graph, base, np.concatenate([scaled, np.zeros((len(part), 1))], axis=1).astype(np.float32), entry,
                                               max(settings.search_beam, 2 * k))
                    for query, vector, nodes in zip(q_ids[a:a + settings.batch].tolist(), part, found):
                        nodes = nodes[nodes >= 0]
                        got, value = best_of(query, x[nodes] @ vector, nodes, starts, ids, k)
                        for column, values in zip(out, (np.full(len(got), query), got, value)):
                            column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = (sent.join(index.select("dim", "shard", "longest", "index"), ["dim", "shard"])
            .repartition(parts, "dim", "shard", "block").select("dim", "longest", "queries", "index"))
    found = work.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """The k nearest of the rows whose id is divisible by ``every``, among all rows."""
    rows = only(table, "vec_id", "embedding").where(usable(F.col("embedding")))
    vectors = durable(one_row_per_id(rows, "embedding")
                      .select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")))
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), build_index(vectors, k, settings), k, settings)
