"""Operators on small hand-made tables, against brute force, published values and known structure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout.operators import (
    aggregate, anomaly, causal, clean, correlate, drivers, forecast, impact, insight, joins, kpi, lifecycle, relate, semantics,
    similarity, validation, windows,
)
from tablescout.operators.profile import numeric_summary


@pytest.fixture(scope="module")
def demo(spark):
    """Three tables of the same customers under unrelated key names."""
    ids = list(range(101, 111))
    clients = spark.createDataFrame([(i, f"Client {i}", 50 + i) for i in ids], "client_id int, client_name string, company_size int")
    moves = spark.createDataFrame([(f"T{k:03d}", ids[k % 10], 100.0 + k) for k in range(15)], "transaction_id string, user_id int, amount double")
    profiles = spark.createDataFrame([(i, f"c{i}@example.org") for i in ids], "customer_code int, email string")
    return {"customers": clients, "customer_profiles": profiles, "transactions": moves}


def test_relationship_demo(demo):
    catalog = semantics.column_catalog(demo)
    edges = {(r.from_dataset, r.to_dataset): r for r in relate.detect_relationships(demo, catalog, threshold=0.7, all_pairs=True).collect()
             if r.match_pct == 100}
    child = edges["transactions", "customers"]
    assert (child.from_column, child.to_column, child.relationship_type) == ("user_id", "client_id", "many-to-one")
    assert child.parent_coverage_pct == 100 and child.confidence == 1.0 and child.join_strategy == "inner"
    twins = edges.get(("customers", "customer_profiles")) or edges["customer_profiles", "customers"]
    assert twins.relationship_type == "one-to-one" and twins.accepted
    assert child.accepted or edges["transactions", "customer_profiles"].accepted


@pytest.mark.parametrize("kept, strategy, accepted", [(100, "inner", True), (92, "left", True), (40, "left", False), (0, "left", False)])
def test_containment_decides(spark, kept, strategy, accepted):
    parents = spark.range(100).withColumnRenamed("id", "product_id").withColumn("label", F.lit("x"))
    children = spark.range(300).select(F.when(F.col("id") % 100 < kept, F.col("id") % 100).otherwise(F.col("id") % 100 + 1000).alias("product_id"))
    tables = {"items": children, "products": parents}
    edge = relate.detect_relationships(tables, semantics.column_catalog(tables), all_pairs=True).collect()[0]
    assert edge.match_pct == pytest.approx(kept)
    assert (edge.from_dataset, edge.join_strategy, edge.accepted) == ("items" if kept else edge.from_dataset, strategy, accepted)


def test_more_columns_than_bits(spark):
    wide = spark.range(40).select(*[(F.col("id") + i).alias(f"k{i}_id") for i in range(70)])
    other = spark.range(40).withColumnRenamed("id", "base_id")
    pairs = [("a", f"k{i}_id", "b", "base_id") for i in range(70)]
    out = {r.from_column: r for r in relate.overlap_counts({"a": wide, "b": other}, pairs).collect()}
    assert all(out[f"k{i}_id"].common_values == max(0, 40 - i) for i in range(70))
    assert all(r.from_values == 40 and r.to_values == 40 for r in out.values())


def test_star_join_keeps_the_rows_of_the_base(demo):
    edges = [dict(from_dataset="transactions", from_column="user_id", to_dataset="customers", to_column="client_id", join_strategy="inner"),
             dict(from_dataset="customers", from_column="client_id", to_dataset="customer_profiles", to_column="customer_code", join_strategy="inner")]
    star = joins.star_join(demo, edges, "transactions")
    assert star.df.count() == 15 and star.tables == ["transactions", "customers", "customer_profiles"]
    assert star.lineage["customer_profiles_email"] == "customer_profiles"
    assert joins.star_join(demo, edges, "customers", fan_out=True).df.count() == 15
    assert joins.star_join(demo, edges, "customers").df.count() == 10


@pytest.fixture(scope="module")
def uneven(spark):
    """One group with most rows, repeated order values, missing values, a group without a name."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 3 < 2, "hot", np.where(np.arange(n) % 7 == 0, None, "cold")),
                        "t": rng.integers(0, 400, n), "id": np.arange(n), "x": rng.integers(0, 50, n).astype(float)})
    pdf.loc[rng.random(n) < 0.3, "x"] = np.nan
    schema = "g string, t long, id long, x double"
    rows = [(r.g, int(r.t), int(r.id), None if np.isnan(r.x) else float(r.x)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("compute", [
    lambda df, cap: windows.cumulative_sum(df, "x", ["g"], ["t", "id"], "y", cap),
    lambda df, cap: windows.forward_fill(df, ["x"], ["g"], ["t", "id"], cap).withColumnRenamed("x", "y"),
    lambda df, cap: windows.rolling_mean(df, "x", ["g"], ["t", "id"], 4, "y", cap),
    lambda df, cap: windows.lagged(df, "x", ["g"], ["t", "id"], 3, "y", cap),
    lambda df, cap: windows.position(df, ["g"], ["t", "id"], "y", cap),
    lambda df, cap: windows.date_gaps(df.withColumn("d", F.date_add(F.lit("2020-01-01"), F.col("t").cast("int"))), "d", ["g"], ["id"], "y", cap),
], ids=["cumulative", "fill", "rolling", "lag", "position", "gaps"])
def test_large_groups_give_the_same_windows(uneven, compute):
    plain = {r.id: r.y for r in compute(uneven, 10_000).collect()}
    cut = {r.id: r.y for r in compute(uneven, 100).collect()}
    assert plain.keys() == cut.keys() and len(plain) == 3000
    assert all(plain[i] == pytest.approx(cut[i]) if plain[i] is not None else cut[i] is None for i in plain)


def test_dedup_limits_ranks_before_the_shuffle(uneven):
    plan = windows.keep_first(uneven, ["g"], ["t", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_similar_pairs_match_brute_force(spark, threshold):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 16))
    vectors = centres[rng.choice(4, 300, p=[0.6, 0.2, 0.1, 0.1])] + rng.normal(size=(300, 16)) * 0.5
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ unit.T
    expected = {(i, j) for i in range(300) for j in range(i + 1, 300) if score[i, j] >= threshold}
    df = spark.createDataFrame([(i, [float(v) for v in vectors[i]]) for i in range(300)], "id long, v array<double>")
    got = similarity.similar_pairs(df, "id", "v", threshold, pivots=6, block_rows=40).collect()
    assert len(got) == len({(r.left_id, r.right_id) for r in got})
    assert {(r.left_id, r.right_id) for r in got} == expected
    assert all(r.similarity == pytest.approx(score[r.left_id, r.right_id]) for r in got)


def test_top_matches_in_blocks(spark, monkeypatch):
    """Queries that are not rows of the corpus but share keys with it; many blocks give what one block gives."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(120, 8)), rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit(y) @ unit(x).T
    for threshold in (0.4, 0.0):
        expected = {(q, r): m for q in range(40) for r, m in enumerate(
            sorted((m for m in range(120) if m != q and score[q, m] > threshold), key=lambda m: -score[q, m])[:3], 1)}
        for floats in (4_000_000, 200):
            monkeypatch.setattr(similarity, "BLOCK_FLOATS", floats)
            assert expected == {(r.query_id, r.rank): r.match_id for r in similarity.top_matches(queries, df, "id", "v", 3, threshold).collect()}


def test_every_pair_of_blocks_has_a_partition(spark):
    """Tasks grow in number with the vectors, whatever the number of shuffle partitions; rows without a key have no pairs."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 8), (900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = similarity.similar_pairs(df, "id", "v", 0.3, block_rows=80)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = {(i, j) for i in range(400) for j in range(i + 1, 400) if (unit @ unit.T)[i, j] >= 0.3}
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert {(r.left_id, r.right_id) for r in got} == expected and len(got) == len(expected)
    assert len({r.p for r in got}) > 4


def test_blocks_of_queries_and_corpus_meet_in_partitions_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20, raising=False)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(100, 8)))], "id long, v array<double>")
    plan = similarity.top_matches(df, df, "id", "v", 3, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert ", 25), REPARTITION_BY_NUM" in plan


def test_equal_vectors_match_the_smallest_key(spark, monkeypatch):
    """Copies have exactly equal similarities, wherever they stand in a product, and zero is above a threshold below it."""
    monkeypatch.setattr(similarity, "STRIP", 3, raising=False)
    monkeypatch.setattr(similarity, "TILE", 7, raising=False)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 33))
    df = spark.createDataFrame([(i, [float(v) for v in base[i % 6]]) for i in range(60)], "id long, v array<double>").repartition(5)
    got = similarity.top_matches(df, df, "id", "v", 3, 0.5).collect()
    assert {(r.query_id, r.rank): r.match_id for r in got} == {
        (i, r): m for i in range(60) for r, m in enumerate([j for j in range(i % 6, 60, 6) if j != i][:3], 1)}
    below = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [-1.0, 0.1])], "id long, v array<double>")
    assert {r.match_id for r in similarity.top_matches(below, below, "id", "v", 2, -0.5).where("query_id = 1").collect()} == {2, 3}


def test_embedding_candidates_join_columns_not_pairs(spark):
    """Repeated columns count as often as they did, and nothing is shuffled behind the comparison."""
    rows = [("a", "x", "key", [1.0, 0.0]), ("a", "x", "measure", [1.0, 0.0]), ("b", "y", "measure", [1.0, 0.1]), ("a", "z", "measure", [1.0, 0.0]),
            (None, "n", "key", [1.0, 0.0]), ("b", "w", "key", None)]
    out = relate.embedding_candidates(spark.createDataFrame(rows, "dataset string, column string, semantic_type string, embedding array<double>"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    value = 1 / np.hypot(1, 0.1)
    got = sorted((r.from_column, r.to_column, round(r.embedding_similarity, 9)) for r in out.collect())
    assert got == sorted([("x", "y", 1.0)] * 2 + [("x", "y", round(value, 9))] * 2 + [("z", "y", round(value, 9))])


@pytest.mark.parametrize("max_rows", [10, 5_000_000])
def test_windows_over_text_order_and_no_group(spark, max_rows):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 120).astype(str), "o": [f"k{v:02d}" for v in rng.integers(0, 9, 120)], "i": np.arange(120),
                          "v": np.where(rng.random(120) < 0.3, np.nan, rng.integers(0, 50, 120))})
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for by in (["g"], []):
        ordered = frame.sort_values(["o", "i"])
        parts = [p for _, p in ordered.groupby("g")] if by else [ordered]
        run = lambda fn, name: {r.i: r[name] for r in fn.collect()}
        total = run(windows.cumulative_sum(df, "v", by, ["o", "i"], max_rows=max_rows), "cumulative")
        filled = run(windows.forward_fill(df, ["v"], by, ["o", "i"], max_rows=max_rows), "v")
        place = run(windows.position(df, by, ["o", "i"], "p", max_rows=max_rows), "p")
        before = run(windows.lagged(df, "v", by, ["o", "i"], 2, max_rows=max_rows), "lagged")
        for p in parts:
            some = p["v"].notna().cumsum() > 0
            nan = lambda s: [None if pd.isna(v) else v for v in s]
            assert [total[i] for i in p["i"]] == nan(p["v"].fillna(0).cumsum().where(some))
            assert [filled[i] for i in p["i"]] == nan(p["v"].ffill())
            assert [place[i] for i in p["i"]] == list(range(len(p)))
            assert [before[i] for i in p["i"]] == nan(p["v"].shift(2))


def test_fill_without_a_group_is_not_one_task(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 7 == 0, F.col("id")))
    plan = windows.forward_fill(df, ["v"], [], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and [r.v for r in windows.forward_fill(df, ["v"], [], ["id"]).orderBy("id").collect()] == [i - i % 7 for i in range(100)]


def test_overlap_of_keys_of_all_types(spark):
    ids = spark.range(1, 11)
    tables = {"a": ids, "b": ids.selectExpr("cast(id as decimal(10,0)) as k"), "c": ids.selectExpr("cast(id as double) as k"),
              "d": ids.selectExpr("cast(id as string) as k"), "e": ids.selectExpr("cast(id as decimal(12,2)) as k"), "f": ids.selectExpr("id + 5 as k")}
    pairs = [("a", "id", t, "k") for t in "bcdef"]
    got = {r.to_dataset: (r.from_values, r.to_values, r.common_values) for r in relate.overlap_counts(tables, pairs).collect()}
    assert got == {**{t: (10, 10, 10) for t in "bcde"}, "f": (10, 10, 5)}


def test_category_drivers_beyond_64_columns(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("net.amount"), *[(F.col("id") % (i % 5 + 2)).cast("string").alias(f"c{i}") for i in range(66)])
    assert drivers.categorical_drivers(df, ["net.amount"], [f"c{i}" for i in range(66)]).count() == 66


@pytest.mark.parametrize("n", [1000, 1100, 51_000, 52_000])
def test_forest_draws_by_one_rule(spark, n):
    df = spark.range(n).select("id", F.rand(3).alias("x"))
    trees = anomaly.isolation_forest(df, "x", ["id"]).groupBy("tree").agg(F.max("sample").alias("s")).collect()
    assert len(trees) == anomaly.TREES and {r.s for r in trees} == {anomaly.TREE_ROWS}


def test_anomalies_find_injected_spikes(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(100, 5, 2000)
    spikes = {17: 180.0, 400: 20.0, 1999: 150.0}
    for i, v in spikes.items():
        values[i] = v
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "x": values}))
    for found in (anomaly.zscore_anomalies(df, "x", ids=["id"]), anomaly.iqr_anomalies(df, "x", ids=["id"]),
                  anomaly.isolation_anomalies(df, "x", ["id"], 0.01)):
        assert set(spikes) <= {r.id for r in found.collect()}
    forest = anomaly.isolation_anomalies(df, "x", ["id"], 0.1).collect()
    assert 150 <= len(forest) <= 200 and max(r.anomaly_score for r in forest) <= 1.0
    again = anomaly.isolation_anomalies(df.repartition(7), "x", ["id"], 0.1).collect()
    assert {r.id for r in forest} == {r.id for r in again}


def test_impact_of_a_known_shift(spark):
    before, after = [10.0, 12.0, 11.0, 13.0, 9.0], [14.0, 15.0, 13.0, 16.0, 17.0]
    df = spark.createDataFrame([(0, v) for v in before] + [(1, v) for v in after], "side int, v double")
    r = impact.estimate_impact(df, "v", F.col("side") == 1).first()
    assert r.estimated_impact == pytest.approx(4.0) and r.t_statistic == pytest.approx(4.0)
    assert r.p_value == pytest.approx(0.003950, abs=1e-6) and r.cohens_d == pytest.approx(4 / np.sqrt(2.5))
    assert (r.ci_low, r.ci_high) == pytest.approx((4 - 2.306004, 4 + 2.306004), abs=1e-5)
    assert r.is_significant and r.effect_size == "large"
    checked = impact.validate_impact(impact.estimate_impact(df, "v", F.col("side") == 1)).first()
    assert "before sample is small" in checked.warnings and checked.confidence_level == "VERY_LOW"


def test_granger_finds_the_lag(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = np.r_[rng.normal(size=3), 0.8 * x[:-3]] + rng.normal(size=400) * 0.3
    days = pd.date_range("2020-01-01", periods=400)
    df = spark.createDataFrame(pd.DataFrame({"day": days, "x": x, "y": y}))
    best = causal.causes_of(df, "day", ["x"], "y", max_lag=6).first()
    assert best.lag == 3 and best.strength == "strong" and best.is_significant
    back = causal.causes_of(df, "day", ["y"], "x", max_lag=3).first()
    assert back.p_value > 0.001
    lags = causal.lag_statistics(x, y, 2)
    past = np.column_stack([np.ones(398), y[1:-1], y[:-2]])
    full = np.column_stack([past, x[1:-1], x[:-2]])
    ssr = [float(((y[2:] - m @ np.linalg.lstsq(m, y[2:], rcond=None)[0]) ** 2).sum()) for m in (past, full)]
    assert lags.f_statistic[1] == pytest.approx((ssr[0] - ssr[1]) / 2 / (ssr[1] / (398 - 5)))


def test_drivers_rank_features(spark):
    rng = np.random.default_rng(4)
    n = 3000
    a, b, c = rng.normal(size=(3, n))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "y": 3 * a - b + rng.normal(size=n) * 0.1}))
    linear = {r.feature: r for r in drivers.linear_drivers(df, ["a", "b", "c"], "y").collect()}
    assert linear["a"].contribution == pytest.approx(0.9, abs=0.02) and linear["c"].contribution < 1e-3
    assert linear["a"].is_positive and not linear["b"].is_positive and linear["a"].r_squared > 0.99
    forest = {r.feature: r for r in drivers.forest_drivers(df, ["a", "b", "c"], "y").collect()}
    assert sum(r.contribution for r in forest.values()) == pytest.approx(1.0)
    assert forest["a"].contribution > forest["b"].contribution > forest["c"].contribution
    assert not forest["b"].is_positive


def test_forest_spreads_large_partitions(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    sizes, fit = [], RandomForestRegressor.fit

    def seen(self, rows):
        sizes.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, rows)

    monkeypatch.setattr(RandomForestRegressor, "fit", seen)
    df = spark.range(2000, numPartitions=1).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 50 * 3).alias("y"))
    whole = drivers.forest_drivers(df, ["a", "b"], "y", trees=5).collect()
    monkeypatch.setattr(drivers, "TASK_BYTES", 300 * (100 + 4 * 7), raising=False)
    spread = drivers.forest_drivers(df, ["a", "b"], "y", trees=5).collect()
    assert sizes[0] == [2000] and max(sizes[1]) <= 300 and sum(sizes[1]) == 2000
    assert [r.feature for r in spread] == [r.feature for r in whole] and spread[0].contribution > 0.9 and whole[0].contribution > 0.9


def test_forecasts_follow_trend_and_season(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2022-01-01", periods=1100)
    t = np.arange(1100)
    y = 200 + 0.3 * t + 25 * np.sin(2 * np.pi * t / 7) + 40 * np.sin(2 * np.pi * t / 365.25) + rng.normal(size=1100) * 4
    panel = spark.createDataFrame(pd.DataFrame({"k": "s", "day": days[:1086].date, "value": y[:1086]}), "k string, day date, value double")
    out = forecast.forecast(panel, ["k"], 14).orderBy("step").toPandas()
    truth = y[1086:]
    assert list(out.day) == list(days[1086:].date) and set(out.model) == {"additive"} and set(out.frequency) == {"D"}
    assert np.mean(np.abs(out.prediction - truth) / truth) < 0.03 and out.mape[0] < 5
    assert ((out.lower < out.prediction) & (out.prediction < out.upper)).all()
    assert ((truth > out.lower) & (truth < out.upper)).mean() > 0.75
    short = panel.where("day < '2022-01-15'")
    few = forecast.forecast(short, ["k"], 3).toPandas()
    assert set(few.model) == {"arima"} and ((few.lower <= few.prediction) & (few.prediction <= few.upper)).all()


def test_arima_recovers_an_ar_process():
    rng = np.random.default_rng(11)
    y = np.zeros(800)
    for i in range(1, 800):
        y[i] = 0.7 * y[i - 1] + rng.normal()
    point, low, high = forecast.arima(y + 50, 5, 0.95)
    assert point[0] == pytest.approx(50 + 0.7 * y[-1], abs=0.5)
    assert np.all(np.diff(high - low) > 0)


def test_correlations_skip_missing_pairs(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.normal(size=500), "same": 1.0})
    pdf["c"] = pdf.a * 2 + rng.normal(size=500)
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in pdf[["a", "b", "c", "same"]].itertuples(index=False)],
                               "a double, b double, c double, same double")
    got = {(r.var1, r.var2): r for r in correlate.correlations(df).collect()}
    assert got["a", "c"].correlation == pytest.approx(pdf.a.corr(pdf.c)) and got["a", "c"].n == pdf.c.count()
    assert got["a", "b"].correlation == pytest.approx(pdf.a.corr(pdf.b)) and got["a", "same"].correlation is None
    assert {r.var2 for r in correlate.strong_pairs(df).collect()} == {"c"}


def test_cleaning_keeps_keys(spark):
    rows = [("1", "10", " $1,200.50 ", "OPEN", None), ("2", None, "5%", "OPEN", None), ("1", "10", " $1,200.50 ", "OPEN", None),
            ("3", "11", "bad", " closed ", None), ("4", "12", None, None, None), ("5", "13", "7", "OPEN", None), ("6", "14", "8", "OPEN", None)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, price string, status string, nothing string")
    meaning = {"order_id": clean.ColumnMeaning("key", True), "customer_id": clean.ColumnMeaning("key", False, True),
               "price": clean.ColumnMeaning("measure", business_meaning="price"), "status": clean.ColumnMeaning("dimension")}
    edges = [dict(from_dataset="orders", from_column="customer_id", to_dataset="customers", to_column="customer_id")]
    out, report = clean.clean_table(df, meaning, edges, "orders")
    got = {r.order_id: r for r in out.collect()}
    assert set(got) == {"1", "3", "4", "5", "6"} and "nothing" not in out.columns
    assert [got[k].price for k in "13456"] == [1200.5, 0.0, 0.0, 7.0, 8.0]
    assert got["3"].status == "CLOSED" and got["4"].status == "UNKNOWN" and got["1"]._data_quality_flag == "clean"
    steps = {(s, m): n for s, m, n, _ in report.steps}
    assert steps["missing_values", "rows_removed"] == 1 and steps["remove_duplicates", "rows_removed"] == 1


def test_kpis_skip_zero_denominators(spark):
    df = spark.createDataFrame([(10.0, 5.0, 2.0), (20.0, 5.0, 0.0)], "total_revenue double, unit_cost double, ad_spend double")
    found = {k.name for k in kpi.applicable_kpis(df.columns, "Finance")}
    assert found == {"Total Revenue", "Profit Margin"}
    values = {r.name: r.value for r in kpi.kpi_report(df, kpi.applicable_kpis(df.columns)).collect()}
    assert values["Total Revenue"] == 30.0 and values["ROAS"] == 5.0 and values["Profit Margin"] == pytest.approx(62.5)
    assert kpi.custom_kpi("x", "{nothing}", df.columns, ["nothing"]) is None


def test_uploads(spark):
    old = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "order_id int, name string")
    copy = lifecycle.classify_upload(old, {"t": old}).first()
    half = lifecycle.classify_upload(spark.createDataFrame([(i, "x") for i in range(5, 15)], old.schema), {"t": old}).first()
    fresh = lifecycle.classify_upload(spark.createDataFrame([(i, "x") for i in range(20, 25)], old.schema), {"t": old}).first()
    other = lifecycle.classify_upload(old.withColumnRenamed("name", "title"), {"t": old}).first()
    assert (copy.decision, half.decision, fresh.decision, other.decision) == ("DUPLICATE", "APPEND", "APPEND", "NEW")
    assert (half.deduplicate, fresh.deduplicate) == (True, False) and half.overlap == 0.5
    merged = lifecycle.append_dedup(old, spark.createDataFrame([(9, "new")], old.schema)).where("order_id = 9").collect()
    assert [r.name for r in merged] == ["new"]


def test_iqr_reference_figures(spark):
    values = [float(v) for v in list(range(100)) + [586.18, 512.45]]
    df = spark.createDataFrame([(v,) for v in values], "price double")
    q = np.quantile(values, [0.25, 0.75])
    expected = sum(v > q[1] + 1.5 * (q[1] - q[0]) for v in values)
    assert anomaly.anomaly_scan({"t": df}).first().num_anomalies == expected == 2
    assert numeric_summary(df).first().q25 == pytest.approx(q[0])


def test_findings_and_listings(spark):
    text = "intro\nFINDING: sales rose\nTop 3 customers\nAcme: $1,250.50\nBeta | 12%\nno number here %\nplain line 7\nMargin is 5%"
    df = spark.createDataFrame([(1, text)], "id int, body string")
    found = [r.finding for r in insight.extract_findings(df, "id", "body").orderBy("line_no").collect()]
    assert found == ["sales rose", "Acme: $1,250.50", "Beta | 12%", "Margin is 5%"]
    listed = [(r.title, r.label, r.value) for r in insight.extract_listings(df, "id", "body").orderBy("line_no").collect()]
    assert listed == [("Top 3 customers", "Acme", 1250.5), ("Top 3 customers", "Beta", 12.0)]


def test_stationarity_and_seasonality(spark):
    rng = np.random.default_rng(13)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    season = np.sin(2 * np.pi * np.arange(300) / 12)
    rows = [(k, i, float(v)) for k, s in (("walk", walk), ("noise", noise), ("season", season)) for i, v in enumerate(s)]
    panel = spark.createDataFrame(rows, "k string, i int, value double")
    out = {r.k: r for r in validation.validate_forecast(panel, ["k"], "i").collect()}
    assert out["noise"].is_stationary and not out["walk"].is_stationary and out["season"].is_seasonal
    assert out["noise"].confidence_level == "VERY_HIGH"


def test_daily_series_has_one_row_per_day(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' as ts, 1.0D as v union all select timestamp_ntz'2024-01-01 23:00:00', 2.0D")
    assert [r.v for r in aggregate.daily_series(df, "ts", ["v"]).collect()] == [3.0]


def test_catalog_moves_digests_instead_of_values(spark):
    from tablescout.operators import semantics

    df = spark.createDataFrame([(1, "a" * 60, 1.5), (2, None, -0.0), (3, "b", 0.0), (3, "b", None)], "id long, note string, v double")
    catalog = semantics.column_catalog({"t": df})
    plan = catalog._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and not [line for line in plan.splitlines() if "hashpartitioning(note" in line]
    assert {r.column: r.distinct for r in catalog.collect()} == {"id": 3, "note": 2, "v": 2}
