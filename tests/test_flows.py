"""Files to stored tables, streams, and physical plans."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout import sources
from tablescout.operators import catalog
from tablescout.plans.discovery import analyse_star, analyse_tables, discover, report
from tablescout.plans.etl import process_upload, run_etl
from tablescout.plans.queries import QUERIES
from tablescout.sources.sinks import read_current
from tablescout.streaming import append_stream, flag_stream, write_stream


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    customers = [(1, "Tech"), (2, "Retail"), (3, "Tech"), (4, "Health"), (5, "Retail")]
    orders = [(100 + i, 1 + i % 5, f"2024-01-{i % 28 + 1:02d}", 500 + 10 * i, "completed" if i % 4 else "pending") for i in range(20)]
    pd.DataFrame(customers, columns=["customer id", "industry"]).to_csv(folder / "customers.csv", index=False)
    pd.DataFrame(orders, columns=["order-id", "customer_id", "order_date", "total_revenue", "status"]).to_csv(folder / "orders.csv", index=False)
    (folder / "lines.json").write_text('{"line_id": 1, "order_id": 100}\n{"line_id": 2, "order_id": 101}\n')
    (folder / "document.json").write_text('[\n {"a_value": 1},\n {"a_value": 2}\n]\n')
    (folder / "empty.csv").write_text("a,b\n")
    (folder / "readme.txt").write_text("nothing to load")
    return str(folder)


def test_directory_and_json_layouts(spark, inbox):
    loaded = sources.load_directory(spark, inbox)
    assert set(loaded.tables) == {"customers.csv", "orders.csv", "lines.json", "document.json"}
    assert set(loaded.rejected) == {"empty.csv", "readme.txt"}
    assert loaded.tables["customers.csv"].columns == ["customer_id", "industry"]
    assert loaded.tables["document.json"].count() == 2 and loaded.tables["lines.json"].count() == 2
    with pytest.raises(ValueError):
        sources.load(spark, inbox + "/readme.txt")


def test_files_to_stored_tables(spark, inbox, tmp_path):
    root = str(tmp_path / "lake")
    out = run_etl(spark, inbox, root, "acme", "Finance")
    assert {(e["from_dataset"], e["to_dataset"]) for e in out.edges} >= {("orders", "customers")}
    assert out.tables["orders"].count() == 20 and "_data_quality_flag" in out.tables["orders"].columns
    kpis = {r.name: r.value for r in catalog.read(spark, root + "/_catalog", "kpis").where("dataset = 'orders'").collect()}
    assert kpis["Total Revenue"] == sum(500 + 10 * i for i in range(20))
    assert catalog.read(spark, root + "/_catalog", "datasets").count() == 4
    stored = out.tables["orders"].drop("_data_quality_flag")
    decision, _ = process_upload(stored, {"orders": stored}, root, "orders")
    assert decision == "DUPLICATE"
    later = stored.withColumns({"order_id": F.concat(F.lit("9"), "order_id"), "order_date": F.col("order_date") + F.expr("interval 60 days")})
    decision, table = process_upload(later, {"orders": stored}, root, "orders_upload")
    assert decision == "APPEND" and table.count() == 40


def test_replace_reads_its_own_table(spark, tmp_path):
    root = str(tmp_path)
    sources.replace_table(spark.range(10), root, "t")
    sources.replace_table(read_current(spark, root, "t").where("id < 4"), root, "t")
    assert read_current(spark, root, "t").count() == 4


def test_pages_are_stable(spark):
    df = spark.range(1000).repartition(7)
    first = sources.page(df, ["id"], 0, 10).collect()
    second = sources.page(df, ["id"], limit=10, after=[first[-1].id]).collect()
    assert [r.id for r in first + second] == list(range(20)) and first[0].total_rows == 1000 and first[0].has_more
    assert not sources.page(df, ["id"], 990, 10).first().has_more


def test_discovery_flow(spark, sf_dir):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    found = discover(tables, keys_only=True)
    assert {(e["from_column"], e["to_column"]) for e in found.edges} == {
        ("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey"), ("o_custkey", "c_custkey"),
        ("c_nationkey", "n_nationkey"), ("s_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey")}
    assert found.star.base == "lineitem" and found.star.df.count() == tables["lineitem"].count()
    assert set(analyse_star(found.star)) >= {"correlation", "trend"}


def test_table_analyses_roll_up(spark):
    days = pd.date_range("2024-01-01", periods=60)
    pdf = pd.DataFrame({"day": days, "a": range(60), "b": [i % 7 * 2.0 for i in range(60)], "kind": ["x", "y"] * 30})
    out = analyse_tables({"t": spark.createDataFrame(pdf)}, max_lag=2)
    kinds = {r.analysis for r in report(out).select("analysis").distinct().collect()}
    assert kinds >= {"anomaly", "forecast", "driver"}


def test_streams(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(source)
    events.limit(50).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    out = str(tmp_path / "out")
    bounds = events.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).first().asDict()
    query = write_stream(flag_stream(append_stream(stream, ["event_id"], "ts", "60 days"), "value", bounds), out, str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == events.count()
    assert got.where("severity is not null").count() == events.where((F.col("value") - bounds["mean"]) / bounds["std"] > 3).count()


@pytest.mark.parametrize("name", ["a20_grouped_aggregates", "j2_merge_inner", "m1_zscore_anomalies", "p9_dedup_keep_first", "r5_value_overlap",
                                  "u6_append_dedup", "w1_cumulative_sum", "k20_kpi_by_period"])
def test_plans_have_no_products(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_invalid_data_yield_no_result_but_a_reason(spark):
    n = 80
    pdf = pd.DataFrame({"day": pd.date_range("2024-01-01", periods=n), "a": [float(i % 7) for i in range(n)], "flat": [3.0] * n,
                        "b": [float((i * 7919) % 31) for i in range(n)], "rare": [1.5 * i if i < 12 else None for i in range(n)]})
    long = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "day timestamp, a double, flat double, b double, rare double")
    tables = {"long": long, "short": long.limit(25).drop("rare"), "plain": long.select("a", "b")}
    out = analyse_tables(tables, max_lag=3)
    found = {(r.dataset, r.column) for r in out["anomaly"].collect()}
    assert found == {("long", "a"), ("long", "b"), ("plain", "a"), ("plain", "b")}
    assert {r.is_valid for r in out["anomaly"].collect()} == {True} and out["anomaly"].where("confidence_level IS NULL").count() == 0
    assert {(r.dataset, r.metric) for r in out["forecast"].collect()} == {("long", m) for m in ("a", "b", "flat")}
    skipped = {(r.skipped_analysis, r.dataset, r.subject): r.reason for r in out["skipped"].collect()}
    assert skipped["anomaly_detection", "long", "flat"] == "no variance" and skipped["anomaly_detection", "long", "rare"] == "sample too small"
    assert skipped["anomaly_detection", "short", "a"] == "sample too small" and skipped["time_series_forecast", "short", "a"] == "sample too small"
    assert skipped["causal_analysis", "plain", "*"] == "no date column" and ("causal_analysis", "long", "a -> b") not in skipped
    assert {r.analysis for r in report(out).select("analysis").distinct().collect()} >= {"anomaly", "forecast", "skipped"}
    few = analyse_tables(tables, max_lag=3, most=1)
    assert "forecast" not in few and {r.dataset for r in few["anomaly"].collect()} <= {"long", "plain"}
    assert few["skipped"].where("reason = 'not among the selected analyses'").count() > 0


def test_pairs_are_checked_like_single_pairs(spark):
    from tablescout.operators import validation
    from tablescout.operators.aggregate import daily_panel, daily_series

    pdf = pd.DataFrame({"day": pd.date_range("2024-01-01", periods=70), "x": [float(i) for i in range(70)], "y": [float((i * 7919) % 31) for i in range(70)],
                        "z": [float(i % 5) for i in range(70)]})
    df = spark.createDataFrame(pdf)
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    many = validation.validate_causal_pairs(daily_panel(df, "day", ["x", "y", "z"], "t"), spark.createDataFrame([("t", a, b) for a, b in pairs], "dataset string, cause string, effect string"))
    got = {(r.cause, r.effect): r for r in many.collect()}
    for a, b in pairs:
        one = validation.validate_causal(daily_series(df, "day", [a, b]), a, b, "day").first()
        for field in ("is_valid", "confidence_level", "sample_size", "warnings", "critical_issues", "has_correlation"):
            assert got[a, b][field] == one[field], (a, b, field)
