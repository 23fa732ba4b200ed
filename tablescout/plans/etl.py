"""From files to stored, cleaned and described tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout import sources
from tablescout.operators import catalog as metadata
from tablescout.operators import clean, kpi, lifecycle, relate, semantics
from tablescout.operators.value_index import ValueIndex, indexable, put_all
from tablescout.session import durable


@dataclass
class EtlResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejected: dict[str, str] = field(default_factory=dict)
    reports: dict[str, clean.CleaningReport] = field(default_factory=dict)
    edges: list[dict] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)


def catalog_folder(root: str) -> str:
    return f"{root.rstrip('/')}/_catalog"


def run_etl(spark: SparkSession, folder: str, root: str, owner: str, domain: str | None = None,
            existing: Mapping[str, DataFrame] | None = None, existing_catalog: DataFrame | None = None) -> EtlResult:
    """Ingest a folder, describe the columns, find the edges, clean, add figures, store.

    Tables are written below ``root``; the metadata tables and the index of column values go to ``root/_catalog``.  Edges to
    tables of earlier runs come from that index and the stored catalog, so those tables are not read again.  ``existing``
    names stored tables that no earlier run has indexed, with their catalog rows.
    """
    loaded = sources.load_directory(spark, folder)
    raw = {name.rsplit(".", 1)[0]: df for name, df in loaded.tables.items()}
    out = EtlResult(rejected=dict(loaded.rejected))
    if not raw:
        return out
    store = catalog_folder(root)
    columns = durable(semantics.column_catalog(raw))
    found = new_edges(spark, store, raw, columns, existing, existing_catalog)
    out.edges = [r.asDict() for r in found.orderBy(*relate.PAIR).collect()]
    for name, df in raw.items():
        meanings = clean.semantics_from_catalog(columns, name)
        cleaned, out.reports[name] = clean.clean_table(df, meanings, out.edges, name)
        figures = kpi.applicable_kpis(cleaned.columns, domain)
        rows = [k for k in figures if k.aggregation == "mean"]
        stored = kpi.with_kpi_columns(cleaned, rows) if rows else cleaned
        out.paths[name] = sources.replace_table(stored, root, sources.table_name(owner, "clean", name))
        out.tables[name] = spark.read.parquet(out.paths[name])
        lifecycle.remember(ValueIndex(spark, store), name, out.tables[name])
        if figures:
            metadata.save(kpi.kpi_report(out.tables[name], figures).withColumn("dataset", F.lit(name)), store, "kpis")
    metadata.save(columns, store, "columns")
    metadata.save(found, store, "relationships", replaces=list(raw))
    shapes = [(n, owner, out.paths[n], domain, "ready", df.count(), len(df.columns)) for n, df in out.tables.items()]
    metadata.save(spark.createDataFrame(shapes, metadata.SCHEMAS["datasets"]), store, "datasets")
    return out


def new_edges(spark: SparkSession, store: str, raw: Mapping[str, DataFrame], columns: DataFrame,
              existing: Mapping[str, DataFrame] | None = None, existing_catalog: DataFrame | None = None) -> DataFrame:
    """Edges that touch the tables ``raw``, whose values are indexed first; stored tables take part by their index."""
    index = ValueIndex(spark, store)
    known = metadata.read(spark, store, "columns")
    if existing_catalog is not None:
        rows = metadata.conform(existing_catalog, "columns")
        known = known.join(rows.select("dataset").distinct(), "dataset", "left_anti").unionByName(rows)
    known = known.where(~F.col("dataset").isin(*raw))
    indexed = {r.dataset for r in index.columns().select("dataset").distinct().collect()}
    if missing := {n: df for n, df in (existing or {}).items() if n not in indexed and n not in raw}:
        put_all(index, missing, known)
    put_all(index, raw, columns)
    everything = known.join(index.columns().select("dataset", "column"), ["dataset", "column"], "left_semi")
    mine = columns.join(index.columns().select("dataset", "column"), ["dataset", "column"], "left_semi")
    catalog = metadata.conform(everything, "columns").unionByName(metadata.conform(mine, "columns"))
    return durable(relate.detect_relationships(raw, catalog, counted_by=index.overlap_counts))


def process_upload(new: DataFrame, stored: Mapping[str, DataFrame], root: str, name: str, action: str | None = None) -> tuple[str, DataFrame]:
    """Decide between NEW, APPEND and DUPLICATE (or take ``action``) and write accordingly.

    Returns the decision and the table as it is stored now.  A dataset that the catalog below ``root`` knows keeps its
    folder, and its path, counts, columns, values and edges there follow.
    """
    spark = new.sparkSession
    known = {r["dataset"]: r for r in metadata.read(spark, catalog_folder(root), "datasets").collect()}  # a row per dataset
    row = lifecycle.classify_upload(new, stored, ValueIndex(spark, catalog_folder(root)) if known else None).first()
    decision, target = action or row["decision"], row["dataset"] or name
    if decision == "DUPLICATE":
        return decision, stored[target]
    target = name if decision == "NEW" else target
    about = known.get(target)
    place = about.path.rstrip("/").rsplit("/", 2)[1] if about is not None else target
    plain = decision == "APPEND" and not row["deduplicate"]
    if decision == "APPEND":
        old = stored[target]
        joined = old.unionByName(new, allowMissingColumns=True) if plain else lifecycle.append_dedup(old, new)
        path = sources.replace_table(joined, root, place)
    else:
        path = sources.replace_table(new, root, place)
    table = spark.read.parquet(path)
    if about is not None:
        _follow(spark, catalog_folder(root), about.asDict(), path, table, new if plain else None)
    return decision, table


def _follow(spark: SparkSession, store: str, about: dict, path: str, table: DataFrame, added: DataFrame | None) -> None:
    """Bring the catalog of a dataset to its new version; ``added`` are rows that were appended to what was there."""
    name, index = about["dataset"], ValueIndex(spark, store)
    before = metadata.read(spark, store, "columns").where(F.col("dataset") == name)
    mergeable = added is not None and before.where("sketch IS NULL").isEmpty() and index.values(name) is not None
    if mergeable:
        index.append(name, added)
        more = metadata.conform(semantics.column_catalog({name: added}), "columns")
        columns = durable(semantics.merge_catalogs(before, more, index.columns()))
    else:
        columns = durable(metadata.conform(semantics.column_catalog({name: table}), "columns"))
        index.put(name, table, indexable(columns).get(name, []))
    lifecycle.remember(index, name, table, added)
    rows = columns.agg(F.max("rows")).first()[0]
    others = metadata.read(spark, store, "columns").where(F.col("dataset") != name)
    catalog = others.unionByName(metadata.conform(columns, "columns")).join(index.columns().select("dataset", "column"), ["dataset", "column"], "left_semi")
    found = durable(relate.detect_relationships({name: table}, catalog, counted_by=index.overlap_counts))
    metadata.save(columns, store, "columns")
    metadata.save(found, store, "relationships", replaces=[name])
    shape = [(name, about["owner"], path, about["domain"], about["status"], rows, len(table.columns))]
    metadata.save(spark.createDataFrame(shape, metadata.SCHEMAS["datasets"]), store, "datasets")
