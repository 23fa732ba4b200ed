"""Writing tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tablescout.sources.readers import list_files, read_csv


def table_name(owner: str, prefix: str, table: str) -> str:
    """``{owner}_{prefix}_{table}`` in lower case with underscores; the one rule for all writers."""
    return "_".join(re.sub(r"[^0-9a-z]+", "_", str(p).lower()).strip("_") for p in (owner, prefix, table) if str(p))


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> str:
    path = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def read_stored(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    path = f"{root.rstrip('/')}/{name}"
    if fmt == "csv":
        return read_csv(spark, path)
    return spark.read.format(fmt).load(path)


def _versions(spark: SparkSession, root: str, name: str) -> list[int]:
    try:
        found = list_files(spark, f"{root.rstrip('/')}/{name}")
    except Exception:  # no version yet
        return []
    return sorted(int(n[1:]) for n in found if re.fullmatch(r"v\d+", n))


def replace_table(df: DataFrame, root: str, name: str) -> str:
    """Write the next version beside the present one.

    Readers keep the old files until the new version is complete, so a table can be replaced by a
    result computed from itself.
    """
    known = _versions(df.sparkSession, root, name)
    path = f"{root.rstrip('/')}/{name}/v{(known[-1] + 1) if known else 1}"
    df.write.mode("error").parquet(path)
    return path


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/v{_versions(spark, root, name)[-1]}")
