"""Stored index of column values, so that new tables meet stored ones without reading them.

Per dataset one bucketed table holds a row per distinct value: a 128-bit digest of its canonical text and the set of
columns that have it, as bits.  All datasets share one number of buckets, so a new table's values join each stored
dataset bucket to bucket, without a shuffle of what is stored.  An append adds rows for digests or columns not seen
before and rewrites nothing: every pair of digest and column stands in exactly one row, which is all that counting
common values needs.  A replaced dataset gets a new table beside the old one; a commit names the valid one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.operators import commits
from tablescout.operators.relate import PAIR, canonical_text

BUCKETS = 64
_BITS = 62
_COLUMNS = T.StructType([T.StructField(n, t) for n, t in (
    ("dataset", T.StringType()), ("column", T.StringType()), ("place", T.IntegerType()), ("values", T.LongType()),
    ("path", T.StringType()), ("words", T.IntegerType()), ("buckets", T.IntegerType()))])


def _place(i: int, words: int, sign: str = "bits") -> list[Column]:
    return [F.lit(1 << (i % _BITS) if w == i // _BITS else 0).cast("long").alias(f"{sign}{w}") for w in range(words)]


def digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of some columns as digests ``a, b`` with the columns that hold them (``bits0``..).

    One shuffle; a value that fills a third of a column reaches it once per task.
    """
    words = (len(columns) + _BITS - 1) // _BITS
    cells = []
    for i, c in enumerate(columns):
        text = canonical_text(F.col(f"`{c}`"), df.schema[c].dataType)
        cells.append(F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), *_place(i, words))))
    rows = df.select(F.explode(F.filter(F.array(*cells), lambda v: v.isNotNull())).alias("v")).select("v.*")
    return rows.groupBy("a", "b").agg(*[F.bit_or(f"bits{w}").alias(f"bits{w}") for w in range(words)])


class ValueIndex:
    """Values of all stored datasets below one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/values"
        known = self.columns().agg(F.max("buckets")).first()[0]
        self.buckets = known or buckets

    def columns(self) -> DataFrame:
        """Indexed columns: their bit, how many distinct values they have, and where their dataset's values are."""
        return commits.latest(commits.read(self.spark, f"{self.root}/columns", _COLUMNS), ["dataset"])

    def _table(self, path: str, words: int, buckets: int) -> DataFrame:
        """The bucketed table at a path; the session learns of it if it did not write it itself."""
        name = "values_" + hashlib.md5(path.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            # Registered by its path, so any session can read it.
            fields = ", ".join(["a BIGINT", "b BIGINT", *[f"bits{w} BIGINT" for w in range(words)]])
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {buckets} BUCKETS LOCATION '{path}'")
        else:
            self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _write(self, rows: DataFrame, path: str, words: int, mode: str) -> None:
        name = "values_" + hashlib.md5(path.encode()).hexdigest()
        if mode == "append":
            self._table(path, words, self.buckets)
        # One task per bucket, so a bucket gains one file with each write.
        (rows.repartition(self.buckets, "a", "b").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
         .option("path", path).mode(mode).format("parquet").saveAsTable(name))

    def values(self, dataset: str) -> DataFrame | None:
        """Digests and column bits of a stored dataset."""
        row = self.columns().where(F.col("dataset") == dataset).select("path", "words", "buckets").first()
        return None if row is None else self._table(row.path, row.words, row.buckets)

    def _counts(self, table: DataFrame, columns: int) -> list[int]:
        sums = [F.coalesce(F.sum(F.getbit(f"bits{i // _BITS}", F.lit(i % _BITS))), F.lit(0)).alias(f"c{i}") for i in range(columns)]
        return list(table.agg(*sums).first())

    def _commit(self, dataset: str, columns: Sequence[str], path: str, words: int) -> None:
        counts = self._counts(self._table(path, words, self.buckets), len(columns))
        rows = [(dataset, c, i, n, path, words, self.buckets) for i, (c, n) in enumerate(zip(columns, counts))]
        commits.write(self.spark.createDataFrame(rows, _COLUMNS), f"{self.root}/columns")

    def put(self, dataset: str, df: DataFrame, columns: Sequence[str]) -> None:
        """Index a new dataset, or a new version that takes the place of the stored one."""
        columns = list(columns)
        if not columns:
            return
        words = (len(columns) + _BITS - 1) // _BITS
        path = f"{self.root}/data/{commits.fresh(dataset)}"
        self._write(digests(df, columns), path, words, "error")
        self._commit(dataset, columns, path, words)

    def append(self, dataset: str, more: DataFrame) -> None:
        """Add the values of further rows of a stored dataset; only what is new is written."""
        stored = self.columns().where(F.col("dataset") == dataset).orderBy("place").collect()
        if not stored:
            raise ValueError(f"{dataset} is not indexed")
        names, path, words = [r.column for r in stored], stored[0].path, stored[0].words
        filled = more.select(*[F.col(f"`{c}`") if c in more.columns else F.lit(None).cast("string").alias(c) for c in names])
        # Appends of several versions may have given a digest several rows.
        old = self._table(path, words, self.buckets).groupBy("a", "b").agg(*[F.bit_or(f"bits{w}").alias(f"old{w}") for w in range(words)])
        both = digests(filled, names).join(old, ["a", "b"], "left")
        fresh = both.select("a", "b", *[F.col(f"bits{w}").bitwiseAND(F.bitwise_not(F.coalesce(f"old{w}", F.lit(0).cast("long")))).alias(f"bits{w}") for w in range(words)])
        fresh = fresh.where(reduce(lambda x, y: x | y, [F.col(f"bits{w}") != 0 for w in range(words)]))
        self._write(fresh, path, words, "append")
        self._commit(dataset, names, path, words)

    def overlap_counts(self, pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
        """Distinct values per side and in common of column pairs, from the index alone.

        Each two datasets with pairs are joined once; matches shrink to counts of bit patterns before they are shuffled.
        """
        about = {(r.dataset, r.column): r for r in self.columns().collect()}  # a row per indexed column
        by_tables: dict[tuple[str, str], list[tuple[str, str, str, str]]] = {}
        for p in pairs:
            by_tables.setdefault((p[0], p[2]), []).append(tuple(p))
        frames = []
        for (left, right), wanted in by_tables.items():
            a, b = (next(r for (d, _), r in about.items() if d == side) for side in (left, right))
            x = self._table(a.path, a.words, a.buckets).withColumnsRenamed({f"bits{w}": f"x{w}" for w in range(a.words)})
            y = self._table(b.path, b.words, b.buckets).withColumnsRenamed({f"bits{w}": f"y{w}" for w in range(b.words)})
            masks = [f"x{w}" for w in range(a.words)] + [f"y{w}" for w in range(b.words)]
            patterns = x.join(y, ["a", "b"]).groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))

            def common(p: tuple[str, str, str, str]) -> Column:
                i, j = about[p[0], p[1]].place, about[p[2], p[3]].place
                both = F.getbit(f"x{i // _BITS}", F.lit(i % _BITS)) * F.getbit(f"y{j // _BITS}", F.lit(j % _BITS))
                return F.struct(*[F.lit(v).alias(n) for n, v in zip(PAIR, p)], F.lit(about[p[0], p[1]]["values"]).cast("long").alias("from_values"),
                                F.lit(about[p[2], p[3]]["values"]).cast("long").alias("to_values"), F.coalesce(F.sum(both * F.col("n")), F.lit(0)).cast("long").alias("common_values"))

            frames.append(patterns.agg(F.array(*[common(p) for p in wanted]).alias("rows")).select(F.inline("rows")))
        return reduce(DataFrame.unionByName, frames)


def indexable(catalog: DataFrame) -> dict[str, list[str]]:
    """Columns of each dataset that may take part in an edge: no measures, not almost empty."""
    out: dict[str, list[str]] = {}
    for r in catalog.where("semantic_type <> 'measure' AND null_pct <= 90").orderBy("dataset", "position").select("dataset", "column").collect():
        out.setdefault(r.dataset, []).append(r.column)
    return out


def put_all(index: ValueIndex, tables: Mapping[str, DataFrame], catalog: DataFrame) -> None:
    for name, columns in indexable(catalog.where(F.col("dataset").isin(*tables))).items():
        index.put(name, tables[name], columns)
