"""Joins along discovered relationships.

No join is hinted: Spark broadcasts a side whose size it knows to be small, and adaptive execution
splits skewed partitions of the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner",
          suffix: str = "_right") -> DataFrame:
    """Equi-join that keeps the key of both sides; clashing names on the right get the suffix.

    A shared key name appears once.
    """
    renamed = {c: f"{c}{suffix}" for c in right.columns if c in left.columns}
    r = right.withColumnsRenamed(renamed)
    key = renamed.get(right_on, right_on)
    joined = left.join(r, F.col(left_on) == F.col(key), how)
    return joined.drop(key) if left_on == right_on else joined


@dataclass
class StarJoin:
    """A joined table, the tables in it, and the table each column came from."""

    df: DataFrame
    base: str
    tables: list[str]
    lineage: dict[str, str]


def base_table(edges: Sequence[Mapping], sizes: Mapping[str, int]) -> str:
    """The table with the most edges, then the most rows."""
    degree = Counter(e[k] for e in edges for k in ("from_dataset", "to_dataset"))
    return max(sizes, key=lambda t: (degree[t], sizes[t], t))


def _next_edge(edges: Sequence[Mapping], joined: Sequence[str], known: Mapping, fan_out: bool) -> tuple[Mapping, bool] | None:
    """An edge from a joined table to a new one, from child to parent before parent to child."""
    for downward in (False, True) if fan_out else (False,):
        here, there = ("to_dataset", "from_dataset") if downward else ("from_dataset", "to_dataset")
        for edge in edges:
            if edge[here] in joined and edge[there] not in joined and edge[there] in known:
                return edge, downward
    return None


def star_join(tables: Mapping[str, DataFrame], edges: Sequence[Mapping], base: str, fan_out: bool = False) -> StarJoin:
    """Join every table reachable from ``base``, each once.

    Columns of a joined table get its name as prefix, except its key.  Edges from child to parent
    come first and never multiply rows, since parents are unique.  ``fan_out`` also follows the
    remaining edges from parent to child, which repeats a row once per child.
    """
    out, joined = tables[base], [base]
    lineage = {c: base for c in out.columns}
    known_as = {(base, c): c for c in out.columns}
    while (step := _next_edge(edges, joined, tables, fan_out)) is not None:
        edge, downward = step
        here, there = ("to", "from") if downward else ("from", "to")
        right, right_key = edge[f"{there}_dataset"], edge[f"{there}_column"]
        left_key = known_as[edge[f"{here}_dataset"], edge[f"{here}_column"]]
        names = {c: c if c == right_key and c not in lineage else f"{right}_{c}" for c in tables[right].columns}
        side = tables[right].withColumnsRenamed(names)
        out = out.join(side, F.col(left_key) == F.col(names[right_key]), edge["join_strategy"])
        joined.append(right)
        lineage.update({new: right for new in names.values()})
        known_as.update({(right, old): new for old, new in names.items()})
    return StarJoin(out, base, joined, lineage)


def catalog_with_datasets(columns: DataFrame, datasets: DataFrame) -> DataFrame:
    return columns.join(datasets, "dataset")


def schema_view(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per table: its columns in order and its relationships, as text lists."""
    listed = columns.groupBy("dataset").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("column_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column", "type"))),
                                 lambda s: F.concat_ws(":", s["column"], s["type"])), ", ").alias("columns"))
    arrow = F.concat(F.col("from_column"), F.lit(" -> "), F.col("to_dataset"), F.lit("."), F.col("to_column"))
    related = edges.groupBy(F.col("from_dataset").alias("dataset")).agg(
        F.array_join(F.array_sort(F.collect_list(arrow)), ", ").alias("relationships"))
    return listed.join(related, "dataset", "left").fillna("", ["relationships"])


def matching_rows(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def new_rows(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")
