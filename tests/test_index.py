"""Stored value index, commits of the catalog, mergeable column catalogs, and the runs that use them."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout.operators import catalog, commits, relate, semantics, value_index
from tablescout.plans.etl import catalog_folder, process_upload, run_etl
from tablescout.plans.queries.relations import _PAIRS, star_tables


@pytest.fixture
def index(spark, tmp_path):
    return value_index.ValueIndex(spark, str(tmp_path / "lake"), buckets=3)


def pairs_of(index, dataset):
    """Every digest with each of its columns, and how often that pair stands in the index."""
    rows = index.values(dataset).collect()
    return sorted((r.a, r.b, w, bit) for r in rows for w in range(len(r) - 2) for bit in range(62) if r[f"bits{w}"] >> bit & 1)


def test_index_counts_what_the_tables_hold(spark, sf_dir, index):
    tables = star_tables(spark, sf_dir)
    value_index.put_all(index, tables, semantics.column_catalog(tables))
    pairs = [(*a, *b) for a, b in _PAIRS]
    got = index.overlap_counts(pairs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, relate.overlap_counts(tables, pairs).select(*got.columns).collect()))
    # Another session object learns of the tables from the stored columns alone.
    for t in spark.catalog.listTables():
        if t.name.startswith("values_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = value_index.ValueIndex(spark, index.root.rsplit("/", 1)[0])
    assert again.buckets == 3 and sorted(map(tuple, again.overlap_counts(pairs).collect())) == sorted(map(tuple, got.collect()))


def test_stored_values_are_joined_bucket_to_bucket(spark, index):
    index.put("a", spark.range(500).select(F.col("id").alias("a_id")), ["a_id"])
    index.put("b", spark.range(250, 900).select(F.col("id").alias("b_id"), (F.col("id") % 7).alias("kind")), ["b_id", "kind"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = index.overlap_counts([("a", "a_id", "b", "b_id"), ("a", "a_id", "b", "kind")])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r)[4:] for r in out.collect()} == {(500, 650, 250), (500, 7, 7)}
        assert "hashpartitioning(a" not in plan and "SortMergeJoin [a" in plan and plan.count("Bucketed: true") == 2
        assert all("/values/data/" in f for f in out.inputFiles())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_appends_add_only_what_is_new(spark, index, tmp_path):
    schema = "id long, `odd name.x` string, w double"
    parts = [[(i, f"v{i % 5}", float(i)) for i in range(20)], [(i, f"v{i % 9}", i / 2) for i in range(10, 40)], [(1, None, None)], [(7, "7", 7.0)]]
    frames = [spark.createDataFrame(p, schema) for p in parts]
    columns = ["id", "odd name.x", "w"]
    index.put("t", frames[0], columns)
    for frame in frames[1:]:
        index.append("t", frame)
    whole = value_index.ValueIndex(spark, str(tmp_path / "other"), buckets=3)
    whole.put("t", frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3]), columns)
    assert pairs_of(index, "t") == pairs_of(whole, "t")
    counts = lambda i: {r.column: r["values"] for r in i.columns().collect()}
    assert counts(index) == counts(whole)
    index.put("t", frames[2], columns[:1])
    assert counts(index) == {"id": 1}
    index.append("t", spark.createDataFrame([("x",)], "other string"))
    assert counts(index) == {"id": 1}


def test_more_indexed_columns_than_bits(spark, index):
    wide = spark.range(30).select(*[(F.col("id") + i).alias(f"k{i}") for i in range(70)])
    index.put("wide", wide, wide.columns)
    index.put("one", spark.range(30).withColumnRenamed("id", "k"), ["k"])
    out = {r.from_column: tuple(r)[4:] for r in index.overlap_counts([("wide", f"k{i}", "one", "k") for i in range(70)]).collect()}
    assert out == {f"k{i}": (30, 30, max(0, 30 - i)) for i in range(70)}


def test_commits_keep_edges_that_later_runs_do_not_touch(spark, tmp_path):
    root = str(tmp_path)
    edge = "from_dataset string, from_column string, to_dataset string, to_column string, confidence double"
    save = lambda rows, **k: catalog.save(spark.createDataFrame(rows, edge), root, "relationships", **k)
    read = lambda: {tuple(r)[:4]: r.confidence for r in catalog.read(spark, root, "relationships").collect()}
    assert read() == {}
    save([("orders", "customer_id", "customers", "id", 0.9)])
    save([("orders", "store_id", "stores", "id", 0.8)], replaces=["stores"])
    assert len(read()) == 2
    save([("orders", "store_id", "stores", "id", 0.7)])
    assert read()[("orders", "store_id", "stores", "id")] == 0.7
    save([("orders", "customer_id", "customers", "key", 0.6)], replaces=["customers"])
    assert set(read()) == {("orders", "store_id", "stores", "id"), ("orders", "customer_id", "customers", "key")}
    save([], replaces=["orders"])
    assert read() == {}


def test_a_commit_replaces_the_rows_of_its_datasets(spark, tmp_path):
    root, schema = str(tmp_path), "dataset string, column string, rows long"
    catalog.save(spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1)], schema), root, "columns")
    catalog.save(spark.createDataFrame([("a", "x", 2)], schema), root, "columns")
    assert {(r.dataset, r.column, r.rows) for r in catalog.read(spark, root, "columns").collect()} == {("a", "x", 2), ("b", "x", 1)}


def test_writers_at_the_same_time_do_not_mix(spark, tmp_path):
    folder, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1)], "k string, v int")
    made, threads = [], []
    for _ in range(5):
        threads.append(threading.Thread(target=lambda: made.append(commits.write(rows, folder))))
        threads[-1].start()
    for t in threads:
        t.join()
    assert sorted(made) == [1, 2, 3, 4, 5]
    assert commits.read(spark, folder, rows.schema).count() == 5 and commits.latest(commits.read(spark, folder, rows.schema), ["k"]).count() == 1


def test_sketched_catalog_is_exact_where_it_matters(spark, sf_dir):
    tables = star_tables(spark, sf_dir)
    exact = {(r.dataset, r.column): r for r in semantics.column_catalog(tables, exact=True).collect()}
    for r in semantics.column_catalog(tables).collect():
        e = exact[r.dataset, r.column]
        assert [r[c] for c in e.asDict() if not c.startswith("distinct")] == [e[c] for c in e.asDict() if not c.startswith("distinct")]
        assert r.distinct == e.distinct if e.is_unique or e.distinct < 300 else abs(r.distinct - e.distinct) <= 0.1 * e.distinct


def test_sketched_catalog_makes_no_row_per_cell(spark, monkeypatch):
    df = spark.range(5000).select("id", (F.col("id") % 900).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.rand(1).alias("x"),
                                  F.when(F.col("id") > 0, F.col("id")).alias("gap"))
    counted = []
    exact = semantics.exact_distinct
    monkeypatch.setattr(semantics, "exact_distinct", lambda d, columns: counted.append(columns) or exact(d, columns))
    rows = {r.column: r for r in semantics.column_catalog({"t": df}).collect()}
    assert counted == [["id", "text", "x"]]
    assert rows["id"].is_primary_key and rows["text"].is_unique and not rows["k"].is_unique and not rows["gap"].is_unique


def test_catalogs_of_parts_merge_to_that_of_the_whole(spark):
    df = spark.range(4000).select("id", (F.col("id") % 50).alias("group_id"), (F.col("id") % 3000).alias("v"), F.when(F.col("id") % 3 == 0, "a").alias("note"))
    parts = [semantics.column_catalog({"t": df.where(w)}) for w in ("id < 1500", "id >= 1500")]
    merged = {r.column: r for r in semantics.merge_catalogs(*parts).collect()}
    whole = {r.column: r for r in semantics.column_catalog({"t": df}).collect()}
    for c, r in whole.items():
        assert [merged[c][f] for f in r.asDict() if f not in ("distinct", "distinct_pct", "sketch")] == [r[f] for f in r.asDict() if f not in ("distinct", "distinct_pct", "sketch")]
        assert abs(merged[c].distinct - r.distinct) <= 0.05 * r.distinct


CUSTOMERS = pd.DataFrame({"customer_id": range(1, 41), "city": [f"c{i % 4}" for i in range(40)]})
ORDERS = pd.DataFrame({"order_id": range(100, 400), "customer_id": [1 + i % 40 for i in range(300)], "store_id": [500 + i % 9 for i in range(300)],
                       "total": [i * 1.5 for i in range(300)]})
STORES = pd.DataFrame({"store_id": range(500, 509), "manager": [f"m{i}" for i in range(9)]})
EDGES = {("orders", "customer_id", "customers", "customer_id"), ("orders", "store_id", "stores", "store_id")}


def inbox(tmp_path, label, **tables):
    folder = tmp_path / label
    folder.mkdir()
    for name, pdf in tables.items():
        pdf.to_csv(folder / f"{name}.csv", index=False)
    return str(folder)


def stored_edges(spark, root):
    return {tuple(r[c] for c in relate.PAIR) for r in catalog.read(spark, catalog_folder(root), "relationships").collect()}


def test_incremental_runs_give_the_edges_of_one_run(spark, tmp_path, monkeypatch):
    once, later = str(tmp_path / "once"), str(tmp_path / "later")
    run_etl(spark, inbox(tmp_path, "all", customers=CUSTOMERS, orders=ORDERS, stores=STORES), once, "acme")
    run_etl(spark, inbox(tmp_path, "first", customers=CUSTOMERS, orders=ORDERS), later, "acme")
    read = []
    parquet = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **k: read.extend(paths) or parquet(self, *paths, **k))
    out = run_etl(spark, inbox(tmp_path, "second", stores=STORES), later, "acme")
    assert {(e["from_dataset"], e["to_dataset"]) for e in out.edges} == {("orders", "stores")}
    assert not [p for p in read if "clean_orders" in p or "clean_customers" in p]  # no stored table was opened
    monkeypatch.undo()
    assert stored_edges(spark, once) == stored_edges(spark, later) == EDGES
    rows = lambda root: {(r.dataset, r.column): (r.rows, r.distinct, r.is_primary_key) for r in catalog.read(spark, catalog_folder(root), "columns").collect()}
    assert rows(once) == rows(later)


def test_the_catalog_follows_append_and_replace(spark, tmp_path):
    root = str(tmp_path / "lake")
    out = run_etl(spark, inbox(tmp_path, "in", customers=CUSTOMERS, orders=ORDERS, stores=STORES), root, "acme")
    sizes = lambda: {r.dataset: (r.row_count, r.path) for r in catalog.read(spark, catalog_folder(root), "datasets").collect()}
    stores = out.tables["stores"]
    more = stores.select(*[(F.col("store_id").cast("long") + 100).cast(stores.schema["store_id"].dataType).alias("store_id") if c == "store_id" else F.col(f"`{c}`") for c in stores.columns])
    decision, table = process_upload(more, out.tables, root, "upload")
    assert decision == "APPEND" and table.count() == 18
    count, path = sizes()["stores"]
    assert count == 18 and path.endswith("acme_clean_stores/v2") and spark.read.parquet(path).count() == 18
    columns = {r.column: r for r in catalog.read(spark, catalog_folder(root), "columns").where("dataset = 'stores'").collect()}
    assert columns["store_id"].rows == 18 and columns["store_id"].distinct == 18 and columns["store_id"].is_primary_key
    assert columns["manager"].distinct == 9 and not columns["manager"].is_unique
    assert stored_edges(spark, root) == EDGES
    decision, table = process_upload(stores.where("store_id = 500").withColumn("store_id", (F.col("store_id").cast("long") + 9000).cast(stores.schema["store_id"].dataType)),
                                     out.tables, root, "stores", action="REPLACE")
    assert table.count() == 1 and sizes()["stores"][0] == 1
    assert stored_edges(spark, root) == {e for e in EDGES if "stores" not in e}


@pytest.mark.parametrize("kept", [["day", "user_id", "v"], ["user_id", "v"], ["v", "paid"]])
def test_uploads_are_classified_without_reading_stored_rows(spark, index, tmp_path, kept):
    from tablescout.operators import lifecycle

    whole = spark.range(400).select(F.expr("date'2024-01-01' + CAST(id % 50 AS INT)").alias("day"), (F.col("id") % 97).alias("user_id"), (F.col("id") * 1.5).alias("v"),
                                    (F.col("id") % 3).alias("paid"))
    path = str(tmp_path / "stored")
    whole.where("v < 300").select(*kept).write.parquet(path)
    stored = {"t": spark.read.parquet(path)}
    lifecycle.remember(index, "t", stored["t"])
    for upload in (whole.where("v < 300"), whole.where("v >= 250"), whole.where("v >= 400").selectExpr("day + 100 AS day", "user_id + 1000 AS user_id", "v", "paid")):
        new = upload.select(*kept)
        by_index = lifecycle.classify_upload(new, stored, index)
        assert by_index.collect() == lifecycle.classify_upload(new, stored).collect()
        assert not [f for f in by_index.inputFiles() if "/stored/" in f]
    lifecycle.remember(index, "t", whole.select(*kept), added=whole.where("v >= 300").select(*kept))
    assert lifecycle.classify_upload(whole.select(*kept), stored, index).first().decision == "DUPLICATE"


def test_names_that_only_hold_the_letters_of_id(spark):
    from tablescout.operators import lifecycle

    assert lifecycle.identity_columns(spark.createDataFrame([(1, 2, 3, 4, 5)], "paid int, width int, user_id int, orderId int, identity int")) == ["user_id", "orderId"]
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "paid int, note string")
    assert lifecycle.append_dedup(rows.limit(0), rows).count() == 2
