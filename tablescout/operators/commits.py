"""Small tables as a sequence of commits: written whole, published by one rename, read as the latest rows.

A commit is a folder ``commit=<n>``.  Its rows take the place of earlier rows with the same key; a row that only names a
scope in ``_replaced`` says that everything earlier of that scope is gone.  Two writers that meet never mix: the rename
of the later one fails and it tries the next number.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLACED, COMMIT = "_replaced", "commit"
ATTEMPTS = 20


def fresh(label: str) -> str:
    """A name that no other write uses."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", label) + "-" + uuid.uuid4().hex


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(COMMIT + r"=(\d+)", n)))


def write(rows: DataFrame, folder: str, replaces: Sequence[str] = ()) -> int:
    """Publish rows as the next commit, together with the scopes that they replace; returns its number."""
    spark = rows.sparkSession
    out = rows.withColumn(REPLACED, F.lit(None).cast("string"))
    if replaces:
        gone = spark.createDataFrame([(s,) for s in replaces], f"{REPLACED} string")
        out = out.unionByName(gone, allowMissingColumns=True)
    staged = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    out.coalesce(1).write.parquet(staged)  # a few rows per column of a table
    jvm = spark._jvm
    paths, conf = jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths(staged).toUri(), conf)
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(ATTEMPTS):
        number = (_numbers(spark, folder) or [0])[-1] + 1
        try:
            files.rename(paths(staged), paths(f"{folder.rstrip('/')}/{COMMIT}={number}"), never)
            return number
        except Exception as problem:
            if "exist" not in str(problem):
                raise
    raise RuntimeError(f"too many writers of {folder}")


def read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of all commits with ``commit`` and ``_replaced``; no rows if nothing was committed."""
    full = T.StructType([*schema.fields, T.StructField(REPLACED, T.StringType()), T.StructField(COMMIT, T.LongType())])
    if not _numbers(spark, folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(folder)


def latest(rows: DataFrame, scope: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Valid rows: nothing later replaced the scope that a column of ``scope`` names, and no later row has the ``key``.

    Without a key, a commit replaces all earlier rows of the scopes that it has rows of.
    """
    gone = rows.where(F.col(REPLACED).isNotNull()).select(F.col(REPLACED).alias("_scope"), F.col(COMMIT).alias("_since"))
    if not key:
        gone = gone.unionByName(rows.where(F.col(REPLACED).isNull()).select(F.col(scope[0]).alias("_scope"), F.col(COMMIT).alias("_since")))
    gone = gone.groupBy("_scope").agg(F.max("_since").alias("_since"))
    out = rows.where(F.col(REPLACED).isNull())
    for column in scope:
        out = out.join(gone, F.col(column) == F.col("_scope"), "left").where(F.coalesce(F.col(COMMIT) >= F.col("_since"), F.lit(True))).drop("_scope", "_since")
    if key:
        newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(COMMIT)))
        out = out.withColumn("_n", newest).where("_n = 1").drop("_n")
    return out.drop(REPLACED, COMMIT)
