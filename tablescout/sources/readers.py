"""Reading files and stored tables."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablescout.functions import nan_to_null, normalise_name
from tablescout.session import durable


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8", **options) -> DataFrame:
    """CSV with a header.  Without a schema the types are inferred, which reads the file once more."""
    reader = spark.read.options(header=True, encoding=encoding, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


CORRUPT = "_corrupt_record"


def _document_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of a path whose lines are values, and those that hold one value over many lines.

    Each file is judged by all its lines: it has one value per line if at least half of those that are not blank are whole
    values.  No line travels, only two counts per file.
    """
    line = F.col("value")
    value = F.try_parse_json(line).isNotNull() & line.rlike(r"^\s*[\[{]")
    counts = (spark.read.text(path).where(line.rlike(r"\S")).groupBy(F.input_file_name().alias("file"))
              .agg(F.count_if(value).alias("whole"), F.count(F.lit(1)).alias("n")).collect())
    names = [(r["file"], 2 * r["whole"] >= r["n"]) for r in counts]
    return [f for f, lines in names if lines], [f for f, lines in names if not lines]


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """One value per line, or one document per file; decided for each file by itself.

    Records that cannot be read stand in the column ``_corrupt_record``, which is only there if some cannot;
    ``without_corrupt`` takes them apart.
    """
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    if schema is not None:
        reader = reader.schema(schema)
    lines, documents = _document_files(spark, path)
    if not lines or not documents:
        return reader.option("multiLine", bool(documents)).json(path)
    return reader.json(lines).unionByName(reader.option("multiLine", True).json(documents), allowMissingColumns=True)


def without_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The readable rows, and the text of the records that are not (None if all are readable)."""
    if CORRUPT not in df.columns:
        return df, None
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# File endings and the reader for each.
READERS = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by its ending, tidy the column names and treat NaN as missing.

    An unknown ending or a table without rows is an error.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file format: {suffix or path}")
    df = READERS[suffix](spark, path, **options)
    df = nan_to_null(df.toDF(*[normalise_name(c) for c in df.columns]))
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


@dataclass
class DirectoryLoad:
    """Tables by file, why other files were rejected, and how many records of a loaded file could not be read."""

    tables: dict[str, DataFrame]
    rejected: dict[str, str]
    unreadable: dict[str, int] = field(default_factory=dict)

    def overview(self, spark: SparkSession) -> DataFrame:
        """One row per file: loaded with its row count and what could not be read, or rejected with the reason."""
        out = spark.createDataFrame(
            [(n, "rejected", None, why) for n, why in self.rejected.items()],
            "file string, state string, rows long, reason string")
        for name, df in self.tables.items():
            bad = self.unreadable.get(name)
            note = F.lit(f"{bad} unreadable records" if bad else None).cast("string")
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("file"), F.lit("loaded").alias("state"), "rows", note.alias("reason")))
        return out


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder, files and table folders alike."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = (s.getPath().getName() for s in found)
    return sorted(n for n in names if not n.startswith(("_", ".")))


# How Spark names the failures that are the fault of a file.
BAD_FILE = ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "MALFORMED", "INVALID_", "UNSUPPORTED_FEATURE.QUERY_ONLY_CORRUPT")


def _is_bad_file(problem: Exception) -> bool:
    """Whether a file's format or emptiness is to blame; a lost executor or a missing permission is not."""
    if isinstance(problem, ValueError):
        return True
    text = f"{problem.getCondition() or ''} {problem}" if isinstance(problem, PySparkException) else str(problem)
    return any(name in text for name in BAD_FILE) and "ermission" not in text


def load_directory(spark: SparkSession, folder: str, **options) -> DirectoryLoad:
    """Load every supported file of a folder as its own table; keep the reason for the others.

    Only failures that lie in a file reject it; any other stops the load, which would else be incomplete unnoticed.
    """
    out = DirectoryLoad({}, {})
    for name in list_files(spark, folder):
        path = f"{folder.rstrip('/')}/{name}"
        try:
            df, bad = without_corrupt(load(spark, path, **options))
            if bad is not None:
                df, bad = (without_corrupt(durable(load(spark, path, **options))))
                out.unreadable[name] = bad.count()
            out.tables[name] = df
        except (ValueError, PySparkException) as problem:
            if not _is_bad_file(problem):
                raise
            out.rejected[name] = str(problem).strip().splitlines()[0].replace(path, name)
    return out


def load_owner_tables(spark: SparkSession, catalog: DataFrame, owner: str, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables of an owner from a catalog with ``owner``, ``dataset`` and ``path``."""
    rows = catalog.where((F.col("owner") == owner) & ~F.col("dataset").isin(list(exclude))).select("dataset", "path").collect()
    return {r["dataset"]: read_parquet(spark, r["path"]) for r in sorted(rows)}


def head(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def sample_rows(df: DataFrame, cap: int = 100_000, seed: int = 42) -> DataFrame:
    """About ``cap`` random rows of a larger table; smaller tables stay whole."""
    rows = df.count()
    return df if rows <= cap else df.sample(fraction=cap / rows, seed=seed)


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100, after: Sequence | None = None) -> DataFrame:
    """A stable page in key order, with the total number of rows and whether more follow.

    ``after`` continues behind the last key of the previous page, which reads no skipped rows;
    ``offset`` counts from the start of what is left.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    total = df.count()
    rest = df
    if after is not None:
        key = F.struct(*[F.col(c) for c in order])
        rest = df.where(key > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)]))
    left = total if after is None else rest.count()
    return (rest.orderBy(*order).offset(offset).limit(limit)
            .withColumns({"total_rows": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < left)}))
