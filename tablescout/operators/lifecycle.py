"""New data against stored data: same schema, how much is known already, append, replace.

What an upload is compared by (days, ids or whole rows) can be kept in the value index, one digest per distinct value.
An upload is then classified from the index alone, bucket to bucket, and no stored row is read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import day_of, parse_date, row_digest, string_columns, temporal_columns
from tablescout.operators.clean import FLAG
from tablescout.operators.value_index import ValueIndex, digests
from tablescout.operators.windows import keep_first

# Columns that do not belong to the data.
INTERNAL = frozenset({FLAG, "index"})
# Share of known values from which an upload is a duplicate, and the confidences.
DUPLICATE_SHARE = 0.9
CONFIDENCES = {"DUPLICATE": 0.95, "APPEND": 0.85, "APPEND_CLEAN": 0.90}
#: Names of identifiers: "id" as a word of its own, so that "paid" or "width" is none.
ID_NAME = r"(?i:(^|[_\W])id([_\W]|$))|[a-z](Id|ID)([A-Z_]|$)"


def own_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INTERNAL]


def schemas_match(a: DataFrame, b: DataFrame) -> bool:
    return set(own_columns(a)) == set(own_columns(b))


def _date_column(df: DataFrame) -> str | None:
    typed = temporal_columns(df)
    named = [c for c in string_columns(df) if "date" in c.lower() or "time" in c.lower()]
    return (typed + named + [None])[0]


def _id_column(new: DataFrame, old: DataFrame) -> str | None:
    return next((c for c in new.columns if re.search(ID_NAME, c) and c in old.columns), None)


def _as_day(df: DataFrame, column: str) -> Column:
    return day_of(parse_date(column)) if column in string_columns(df) else day_of(column)


def _share_known(new: DataFrame, old: DataFrame, method: str, column: str) -> DataFrame:
    """Distinct new values and how many of them the stored table has: one column ``v`` each."""
    values = new.where("v is not null").distinct()
    known = old.where("v is not null").distinct().withColumn("_known", F.lit(1))
    out = values.join(known, "v", "left").agg(
        F.count(F.lit(1)).alias("new_values"), F.count("_known").alias("known_values"))
    return out.select(F.lit(method).alias("method"), F.lit(column).alias("compared"), "new_values", "known_values",
                      F.coalesce(F.try_divide("known_values", "new_values"), F.lit(0.0)).alias("overlap"))


def date_overlap(new: DataFrame, old: DataFrame, column: str) -> DataFrame:
    return _share_known(new.select(_as_day(new, column).alias("v")), old.select(_as_day(old, column).alias("v")), "date", column)


def id_overlap(new: DataFrame, old: DataFrame, column: str) -> DataFrame:
    text = F.col(column).cast("string").alias("v")
    return _share_known(new.select(text), old.select(text), "id", column)


def row_overlap(new: DataFrame, old: DataFrame) -> DataFrame:
    columns = sorted(c for c in own_columns(new) if c in old.columns)
    return _share_known(new.select(row_digest(columns).alias("v")), old.select(row_digest(columns).alias("v")), "row", "*")


def compared_by(new: DataFrame, old: DataFrame) -> tuple[str, str]:
    """Dates, without dates ids, without ids whole rows; and the column."""
    date = _date_column(new)
    if date is not None and date in old.columns:
        return "date", date
    key = _id_column(new, old)
    return ("id", key) if key is not None else ("row", "*")


def _compared(df: DataFrame, method: str, column: str, columns: Sequence[str]) -> DataFrame:
    """What a table is compared by, as one column ``v``."""
    if method == "row":
        return df.select(F.hex(row_digest(columns)).alias("v"))
    value = _as_day(df, column) if method == "date" else F.col(f"`{column}`")
    return df.select(value.cast("string").alias("v"))


def overlap(new: DataFrame, old: DataFrame, index: ValueIndex | None = None, dataset: str = "") -> DataFrame:
    """Share of new dates the stored table has; without dates the ids, without ids whole rows.

    With an index that knows the dataset by the same method, the stored table is not read.
    """
    method, column = compared_by(new, old)
    if index is not None:
        names = sorted(c for c in own_columns(new) if c in old.columns)
        known = index.values(f"{dataset}#{method}:{column}:{','.join(names) if method == 'row' else ''}")
        if known is not None:
            values = digests(_compared(new, method, column, names), ["v"])
            found = values.join(known.select("a", "b", F.lit(1).alias("_known")), ["a", "b"], "left").agg(
                F.count(F.lit(1)).alias("new_values"), F.count("_known").alias("known_values"))
            return found.select(F.lit(method).alias("method"), F.lit(column).alias("compared"), "new_values", "known_values",
                                F.coalesce(F.try_divide("known_values", "new_values"), F.lit(0.0)).alias("overlap"))
    if method == "date":
        return date_overlap(new, old, column)
    return id_overlap(new, old, column) if method == "id" else row_overlap(new, old)


def remember(index: ValueIndex, dataset: str, table: DataFrame, added: DataFrame | None = None) -> None:
    """Keep in the index what uploads to a dataset are compared by; ``added`` rows extend what is there."""
    method, column = compared_by(table, table)
    names = sorted(own_columns(table))
    label = f"{dataset}#{method}:{column}:{','.join(names) if method == 'row' else ''}"
    if added is not None and index.values(label) is not None:
        index.append(label, _compared(added, method, column, names))
    else:
        index.put(label, _compared(table, method, column, names), ["v"])


def decide(share: Column) -> dict[str, Column]:
    duplicate, partial = share > DUPLICATE_SHARE, share > 0
    return {
        "decision": F.when(duplicate, "DUPLICATE").otherwise("APPEND"),
        "confidence": F.when(duplicate, CONFIDENCES["DUPLICATE"]).when(partial, CONFIDENCES["APPEND"])
                       .otherwise(CONFIDENCES["APPEND_CLEAN"]),
        "deduplicate": ~duplicate & partial,
    }


def classify_upload(new: DataFrame, stored: Mapping[str, DataFrame], index: ValueIndex | None = None) -> DataFrame:
    """NEW, APPEND or DUPLICATE against the first stored table of the same schema."""
    for name, old in stored.items():
        if schemas_match(new, old):
            out = overlap(new, old, index, name).withColumns(decide(F.col("overlap")))
            return out.select(F.lit(name).alias("dataset"), "decision", "overlap", "confidence", "deduplicate",
                              "method", "compared", "new_values", "known_values")
    spark = new.sparkSession
    return spark.createDataFrame(
        [(None, "NEW", 0.0, 1.0, False, "schema", "", 0, 0)],
        "dataset string, decision string, overlap double, confidence double, deduplicate boolean, "
        "method string, compared string, new_values long, known_values long")


def quick_duplicate_check(new: DataFrame, stored: Mapping[str, DataFrame], rows: int = 100) -> DataFrame:
    """The classification of the first ``rows`` rows, kept only when they are a duplicate."""
    return classify_upload(new.limit(rows), stored).where("decision = 'DUPLICATE'")


def identity_columns(df: DataFrame, by_date_only: bool = False) -> list[str]:
    """What makes a row the same row in an append.

    Identifier columns; without them the whole row.  ``by_date_only`` keeps one row per timestamp.
    """
    times = temporal_columns(df)
    if by_date_only and times:
        return times
    ids = [c for c in own_columns(df) if re.search(ID_NAME, c)]
    return ids or own_columns(df)


def append_dedup(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None, by_date_only: bool = False) -> DataFrame:
    """Stored rows plus new rows, one row per identity, where new rows replace stored ones."""
    both = old.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    keys = list(keys or identity_columns(both.drop("_source"), by_date_only))
    ties = [F.desc(f.name) for f in both.schema.fields
            if f.name not in keys and f.name != "_source" and not isinstance(f.dataType, T.MapType)]
    return keep_first(both, keys, [F.desc("_source"), *ties]).drop("_source")


def append_distinct(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def suggested_extras(suggested: Sequence[DataFrame], selected: DataFrame, key: str) -> DataFrame:
    """Ids found by any suggestion that are not selected yet."""
    out = suggested[0].select(key)
    for frame in suggested[1:]:
        out = out.union(frame.select(key))
    return out.distinct().join(selected.select(key), key, "left_anti")
