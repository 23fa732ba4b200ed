"""Cosine similarity: one vector against a table, many against a table, and all similar pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import durable

BLOCK_FLOATS = 4_000_000
#: Rows of a block, and tasks that pairs of blocks are dealt to at most.
BLOCK_ROWS = 32_768
MAX_TASKS = 10_000
#: Rows and columns of the products that a task looks through at a time.
STRIP, TILE = 256, 2048
MAX_PIVOTS = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity between 0 and 1; 0 when a vector has no length."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    value = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def cosine_to(vector: Sequence[float], column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    norm = float(np.linalg.norm(np.asarray(vector, dtype="float64")))
    if norm == 0.0:
        return F.lit(0.0)
    unit = F.array(*[F.lit(float(v) / norm) for v in vector])
    value = F.try_divide(_dot(column, unit), F.sqrt(_dot(column, column)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def most_similar(df: DataFrame, vector: Sequence[float] | None, embedding: str, key: str, limit: int = 5,
                 threshold: float = 0.7) -> DataFrame:
    """Rows whose vector is more similar than the threshold, best first, ties by key."""
    if vector is None:
        return df.limit(0).withColumn("similarity", F.lit(None).cast("double"))
    return (df.where(F.col(embedding).isNotNull()).withColumn("similarity", cosine_to(vector, embedding))
            .where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), key).limit(limit))


def similar_datasets(datasets: DataFrame, vector, limit: int = 5, threshold: float = 0.7) -> DataFrame:
    return most_similar(datasets, vector, "description_embedding", "dataset", limit, threshold)


def similar_columns(columns: DataFrame, datasets: DataFrame, vector, exclude_dataset: str | None = None, limit: int = 10,
                    threshold: float = 0.8) -> DataFrame:
    out = columns if exclude_dataset is None else columns.where(F.col("dataset") != exclude_dataset)
    return most_similar(out.join(datasets.drop("description_embedding"), "dataset"), vector, "semantic_embedding", "column",
                        limit, threshold)


def similar_insights(insights: DataFrame, vector, domain: str | None = None, limit: int = 5, threshold: float = 0.7) -> DataFrame:
    out = insights if domain is None else insights.where(F.col("domain") == domain)
    return most_similar(out, vector, "insight_embedding", "insight_id", limit, threshold)


def _unit_rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) != 1:
        raise ValueError("vectors must have the same length")
    m = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), lengths[0])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of row ``i`` of x with row ``j`` of y; equal vectors give equal products, wherever they stand."""
    step = max(1, BLOCK_FLOATS // max(x.shape[1], 1))
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[s:s + step]], y[j[s:s + step]]) for s in range(0, len(i), step)]])


def _margin(width: int) -> float:
    """More than single precision can be off in a product of two unit vectors."""
    return (width + 8) * 2.0 ** -23


def _close(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and products of all rows of x and y at or above the threshold, by strips of x.

    Single precision picks the candidates from products that fit the cache, double precision decides.
    """
    a, b, least = x.astype("float32"), y.astype("float32"), threshold - _margin(x.shape[1])
    for s in range(0, len(x), STRIP):
        rows, places = [], []
        for t in range(0, len(y), TILE):
            near = a[s:s + STRIP] @ b[t:t + TILE].T
            i, j = np.divmod(np.flatnonzero(near >= least), near.shape[1])
            rows.append(s + i)
            places.append(t + j)
        i, j = np.concatenate(rows), np.concatenate(places)
        value = _products(x, i, y, j)
        keep = value >= threshold
        yield i[keep], j[keep], value[keep]


def _best(x: np.ndarray, y: np.ndarray, own: np.ndarray, rank: np.ndarray, k: int,
          threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` rows of y above the threshold that are most similar to each row of x, by strips of x.

    ``own`` and ``rank`` number the keys of both in their order.  Only what can still be among the best of its row
    is kept from one product to the next.
    """
    a, b, margin = x.astype("float32"), y.astype("float32"), _margin(x.shape[1])
    for s in range(0, len(x), STRIP):
        cut = np.full(min(STRIP, len(x) - s), float(threshold))
        i, j, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for t in range(0, len(y), TILE):
            near = a[s:s + STRIP] @ b[t:t + TILE].T
            # Below zero all similarities are zero.
            least = np.where((cut > 0) | (threshold >= 0), cut - margin, -np.inf).astype("float32")
            i2, j2 = np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])
            j2 += t
            value2 = np.clip(_products(x, s + i2, y, j2), 0.0, 1.0)
            keep = (value2 > threshold) & (value2 >= cut[i2]) & (own[s + i2] != rank[j2])
            if not keep.any():
                continue
            i, j, value = np.concatenate([i, i2[keep]]), np.concatenate([j, j2[keep]]), np.concatenate([value, value2[keep]])
            order = np.lexsort((rank[j], -value, i))
            i, j, value = i[order], j[order], value[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, value, place = (c[place < k] for c in (i, j, value, place))
            full = place == k - 1
            cut[i[full]] = value[full]
        yield s + i, j, value


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    return pc.rank(ids.combine_chunks(), tiebreaker="dense").to_numpy()


def _block_rows(width: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_FLOATS // max(width, 1)))


def _blocks(rows: DataFrame, key: str, embedding: str, width: int, name: str) -> tuple[DataFrame, int]:
    """Rows with the number of their block, of at most about ``BLOCK_FLOATS`` numbers, and how many blocks there are."""
    rows = rows.select(F.col(key).alias("id"), F.col(embedding).alias("vec")).where("vec is not null")
    count = max(1, -(-rows.count() // _block_rows(width)))
    return rows.withColumn(name, F.pmod(F.xxhash64("id", "vec"), F.lit(count)).cast("int")), count


def top_matches(queries: DataFrame, corpus: DataFrame, key: str, embedding: str, k: int = 3, threshold: float = 0.75) -> DataFrame:
    """The ``k`` most similar rows of the corpus for each query, itself excluded.

    Queries and corpus are cut into blocks of bounded size and every block of queries meets every block of
    the corpus in a task of its own that keeps the best ``k`` per query, so tasks grow in number, not in size.
    A query and a row of the corpus with the same key are the same thing and do not match.
    """
    width = max(df.agg(F.coalesce(F.max(F.size(embedding)), F.lit(1))).first()[0] for df in (queries, corpus))
    left, q_count = _blocks(queries.where(F.col(key).isNotNull()), key, embedding, width, "q")
    right, c_count = _blocks(corpus, key, embedding, width, "c")
    kind = corpus.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("match_id", kind), T.StructField("similarity", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        ids, rank, x = group.column("id").combine_chunks(), _ranks(group.column("id")), _unit_rows(group.column("vec"))
        is_query = group.column("is_query").to_numpy()
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        for i, j, value in _best(x[q], x[c], rank[q], rank[c], k, threshold):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[i])), ids.take(pa.array(c[j])), pa.array(value)], schema.names)

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    met = left.select("q", every(c_count).alias("c"), F.lit(True).alias("is_query"), F.col("id").cast(kind).alias("id"), "vec").unionByName(
        right.select(every(q_count).alias("q"), "c", F.lit(False).alias("is_query"), "id", "vec"))
    matches = met.repartition(min(q_count * c_count, MAX_TASKS), "q", "c").groupBy("q", "c").applyInArrow(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, key: str, embedding: str, threshold: float, pivots: int | None = None,
                  block_rows: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs with cosine similarity at or above the threshold, exactly, each once.

    Columns named by ``carry`` come along as ``left_...`` and ``right_...``, so the pairs, which may be far more than the
    rows, need not be joined with anything.

    Vectors go to the cell of their nearest pivot, and also to a neighbouring cell with a smaller
    number when the hyperplane between the two pivots is close enough for a match beyond it (the
    published cluster-join bound).  Cells are cut into blocks of bounded size and every pair of blocks is
    compared by matrix product in a partition of its own, so a cell with a third of all vectors becomes many
    tasks and only matches leave a task.  Rows without a key are left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = df.select(F.col(key).alias("id"), F.col(embedding).alias("vec"), *[F.col(c).alias(f"_{c}") for c in carry])
    rows = rows.where("vec is not null and id is not null")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    width = max(width, 1)
    block_rows = block_rows or max(256, min(20_000, BLOCK_FLOATS // width))
    # A vector goes to at most half of the cells, and to the blocks of its cell: few pivots bound both the copies
    # and what a task holds of the pivots; below this threshold hyperplanes cut nothing off, and one cell is best.
    pivots = pivots or (1 if threshold < 0.5 else int(max(1, min(MAX_PIVOTS, (2 * n / block_rows) ** 0.5))))
    centres = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(_unit_rows(centres.column("vec")))
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + 1e-6
    placed_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("is_home", T.BooleanType()), *rows.schema.fields])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * p @ p.T))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit_rows(batch.column("vec"))
            squared = np.maximum(0.0, 2.0 - 2.0 * x @ p.T)
            home = squared.argmin(axis=1)
            nearest = squared[np.arange(len(x)), home]
            apart = gaps[home]
            reach = (squared - nearest[:, None]) <= 2.0 * apart * radius
            reach &= np.arange(len(p))[None, :] < home[:, None]
            row, cell = np.nonzero(reach)
            copies = batch.take(pa.array(np.concatenate([np.arange(len(x)), row])))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([home, cell]).astype("int32")),
                pa.array(np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)])), *copies.columns], placed_schema.names)

    placed = durable(rows.mapInArrow(to_cells, placed_schema))
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if("is_home") / block_rows).alias("homes"), F.ceil(F.count_if(~F.col("is_home")) / block_rows).alias("outers"))
    groups = sizes.agg(F.sum(F.expr("homes * (homes + 1) / 2 + homes * outers"))).first()[0]
    # One row per cell, so the broadcast is bounded and vectors are not dealt by cell.
    sized = placed.join(F.broadcast(sizes), "cell").where("homes > 0")
    count = F.when(F.col("is_home"), F.col("homes")).otherwise(F.col("outers"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(count, F.lit(1))))
    mine = F.col("block")

    def task(kind_name: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind_name).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    with_homes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1),
                             lambda j: task("home", F.least(j, mine), F.greatest(j, mine)))
    with_outers = F.when(F.col("outers") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("outers") - 1), lambda j: task("outer", mine, j)))
    from_outer = F.transform(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1), lambda j: task("outer", j, mine))
    empty = F.filter(with_homes, lambda t: F.lit(False))
    tasks = F.when(F.col("is_home"), F.concat(with_homes, F.coalesce(with_outers, empty))).otherwise(from_outer)
    kept = [c for c in rows.columns if c != "vec"]
    spread = sized.select("cell", "is_home", "block", *rows.columns, F.explode(tasks).alias("task")).select(
        "cell", "task.kind", "task.a", "task.b", "is_home", "block", *rows.columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        kind, a, b = (group.column(c)[0].as_py() for c in ("kind", "a", "b"))
        is_home, blocks = group.column("is_home").to_numpy(), group.column("block").to_numpy()
        left, right = (np.flatnonzero(m) for m in ((is_home, ~is_home) if kind == "outer" else (blocks == a, blocks == b)))
        same = kind == "home" and a == b
        x, rank = _unit_rows(group.column("vec")), _ranks(group.column("id"))
        columns = [group.column(c).combine_chunks() for c in kept]
        for i, j, value in _close(x[left], x[right], threshold):
            i, j = left[i], right[j]
            keep = rank[i] < rank[j] if same else rank[i] != rank[j]
            i, j, value = i[keep], j[keep], np.minimum(1.0, value[keep])
            swap = rank[i] > rank[j]
            first, second = pa.array(np.where(swap, j, i)), pa.array(np.where(swap, i, j))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(first) for c in columns], *[c.take(second) for c in columns], pa.array(value)], out_schema.names)

    out_schema = T.StructType([
        *[T.StructField(f"{side}_{name}", rows.schema[c].dataType) for side in ("left", "right") for name, c in zip(("id", *carry), kept)],
        T.StructField("similarity", T.DoubleType())])
    out = spread.repartition(int(max(1, min(groups or 1, MAX_TASKS))), "cell", "kind", "a", "b").groupBy("cell", "kind", "a", "b")
    # In the order of before: both keys, the similarity, then what came along.
    return out.applyInArrow(compare, out_schema).select(
        "left_id", "right_id", "similarity", *[f"{side}_{c}" for side in ("left", "right") for c in carry])
