from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablescout.functions import name_similarity
from tablescout.operators import joins as J
from tablescout.operators import relate as X
from tablescout.operators import semantics as S
from tablescout.plans.queries.base import STAR, Registry, rounded, table, tables, union_all
from tablescout.session import durable

R = Registry()

# Key columns of the star schema by table, in name order of the tables.
_KEYS = [("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"),
         ("lineitem", "l_suppkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("orders", "o_orderkey"),
         ("orders", "o_custkey"), ("part", "p_partkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"),
         ("supplier", "s_nationkey")]
# Similarity of the names of key columns, worked out by hand from the longest common blocks.
NAME_SCORES = {
    "c_custkey": {"l_orderkey": 6 / 17, "l_partkey": 1 / 2, "l_suppkey": 1 / 2, "n_nationkey": 4 / 9, "n_regionkey": 1 / 3, "o_orderkey": 6 / 17, "o_custkey": 7 / 8,
                  "p_partkey": 1 / 2, "r_regionkey": 1 / 3, "s_suppkey": 1 / 2, "s_nationkey": 5 / 9},
    "c_nationkey": {"l_orderkey": 8 / 19, "l_partkey": 5 / 9, "l_suppkey": 1 / 3, "n_nationkey": 9 / 10, "n_regionkey": 7 / 10, "o_orderkey": 8 / 19, "o_custkey": 5 / 9,
                    "p_partkey": 5 / 9, "r_regionkey": 3 / 5, "s_suppkey": 1 / 3, "s_nationkey": 9 / 10},
    "l_orderkey": {"n_nationkey": 8 / 19, "n_regionkey": 8 / 19, "o_orderkey": 8 / 9, "o_custkey": 8 / 17, "p_partkey": 8 / 17, "r_regionkey": 8 / 19, "s_suppkey": 6 / 17,
                   "s_nationkey": 8 / 19},
    "l_partkey": {"n_nationkey": 5 / 9, "n_regionkey": 4 / 9, "o_orderkey": 8 / 17, "o_custkey": 1 / 2, "p_partkey": 7 / 8, "r_regionkey": 4 / 9, "s_suppkey": 1 / 2,
                  "s_nationkey": 5 / 9},
    "l_suppkey": {"n_nationkey": 1 / 3, "n_regionkey": 1 / 3, "o_orderkey": 6 / 17, "o_custkey": 1 / 2, "p_partkey": 5 / 8, "r_regionkey": 1 / 3, "s_suppkey": 7 / 8,
                  "s_nationkey": 4 / 9},
    "n_nationkey": {"o_orderkey": 8 / 19, "o_custkey": 4 / 9, "p_partkey": 5 / 9, "r_regionkey": 3 / 5, "s_suppkey": 1 / 3, "s_nationkey": 9 / 10},
    "n_regionkey": {"o_orderkey": 10 / 19, "o_custkey": 4 / 9, "p_partkey": 4 / 9, "r_regionkey": 9 / 10, "s_suppkey": 1 / 3, "s_nationkey": 7 / 10},
    "o_orderkey": {"p_partkey": 8 / 17, "r_regionkey": 8 / 19, "s_suppkey": 6 / 17, "s_nationkey": 8 / 19},
    "o_custkey": {"p_partkey": 1 / 2, "r_regionkey": 4 / 9, "s_suppkey": 1 / 2, "s_nationkey": 4 / 9},
    "p_partkey": {"r_regionkey": 4 / 9, "s_suppkey": 5 / 8, "s_nationkey": 5 / 9},
    "r_regionkey": {"s_suppkey": 1 / 3, "s_nationkey": 3 / 5},
}
_PAIRS = [(a, b) if a[0] < b[0] else (b, a) for a, b in combinations(_KEYS, 2) if a[0] != b[0]]
_EDGES = [("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
          ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
          ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"),
          ("supplier", "s_nationkey", "nation", "n_nationkey")]
EDGES = [dict(zip(X.PAIR, e), join_strategy="inner") for e in _EDGES]


def star_tables(spark, d):
    return tables(spark, d, *STAR)


def star_catalog(spark, d):
    return S.key_catalog(star_tables(spark, d))


def _pair_sql(a, b) -> str:
    (t1, c1), (t2, c2) = a, b
    return f"""SELECT '{t1}' AS from_dataset, '{c1}' AS from_column, '{t2}' AS to_dataset, '{c2}' AS to_column,
        (SELECT count(DISTINCT {c1}) FROM {t1}) AS from_values, (SELECT count(DISTINCT {c2}) FROM {t2}) AS to_values,
        (SELECT count(*) FROM (SELECT CAST({c1} AS VARCHAR) FROM {t1} INTERSECT SELECT CAST({c2} AS VARCHAR) FROM {t2})) AS common_values,
        (SELECT count(*) FROM {t1}) AS from_rows, (SELECT count(*) FROM {t2}) AS to_rows, {NAME_SCORES[c1][c2]!r} AS name_similarity"""


_PAIRS_SQL = "WITH p AS (" + union_all(_pair_sql(a, b) for a, b in _PAIRS) + ")"
_STAT_SQL = _PAIRS_SQL + """, m AS (SELECT *, from_values = from_rows AS fu, to_values = to_rows AS tu,
    common_values * 100.0 / from_values AS fwd, common_values * 100.0 / to_values AS rev FROM p)"""


@R.add(_PAIRS_SQL + " SELECT from_column AS left_name, to_column AS right_name, round(name_similarity, 6) AS name_similarity FROM p")
def r1_name_similarity(spark, d):
    """Every two key names of different tables, scored."""
    names = star_catalog(spark, d).select("dataset", "column")
    left, right = names.toDF("left_table", "left_name"), names.toDF("right_table", "right_name")
    pairs = left.join(right, F.col("left_table") < F.col("right_table"))
    return rounded(pairs.select("left_name", "right_name", name_similarity("left_name", "right_name").alias("name_similarity")))


# The similar column names of the star schema, worked out by hand.
_ALIKE = [("customer", "c_custkey", "orders", "o_custkey", 7 / 8), ("customer", "c_nationkey", "nation", "n_nationkey", 9 / 10),
          ("customer", "c_nationkey", "nation", "n_regionkey", 7 / 10), ("customer", "c_nationkey", "region", "r_regionkey", 3 / 5),
          ("customer", "c_nationkey", "supplier", "s_nationkey", 9 / 10), ("lineitem", "l_linestatus", "orders", "o_orderstatus", 14 / 23),
          ("lineitem", "l_orderkey", "orders", "o_orderkey", 8 / 9), ("lineitem", "l_partkey", "part", "p_partkey", 7 / 8),
          ("lineitem", "l_suppkey", "part", "p_partkey", 5 / 8), ("lineitem", "l_suppkey", "supplier", "s_suppkey", 7 / 8),
          ("nation", "n_nationkey", "region", "r_regionkey", 3 / 5), ("nation", "n_nationkey", "supplier", "s_nationkey", 9 / 10),
          ("nation", "n_regionkey", "region", "r_regionkey", 9 / 10), ("nation", "n_regionkey", "supplier", "s_nationkey", 7 / 10),
          ("part", "p_partkey", "supplier", "s_suppkey", 5 / 8), ("region", "r_regionkey", "supplier", "s_nationkey", 3 / 5)]
_ALIKE += [(a, f"{a[0]}_name", b, f"{b[0]}_name", 4 / 5) for a, b in combinations(("customer", "nation", "part", "region", "supplier"), 2)]


@R.add(union_all(f"""SELECT '{a}' AS from_dataset, '{x}' AS from_column, '{b}' AS to_dataset, '{y}' AS to_column, round({score!r}, 6) AS name_similarity
                     WHERE (SELECT count({x}) FROM {a}) > 0 AND (SELECT count({y}) FROM {b}) > 0""" for a, x, b, y, score in _ALIKE))
def r2_name_candidates(spark, d):
    """Similar column names of different tables, from the profiled catalog."""
    catalog = S.column_catalog(star_tables(spark, d))
    pairs = X.candidate_pairs(catalog)
    return rounded(pairs.where(F.col("name_similarity") >= X.NAME_GATE).select(*X.PAIR, "name_similarity"))


@R.add(_PAIRS_SQL + " SELECT from_dataset, from_column, to_dataset, to_column, round(name_similarity, 6) AS name_similarity FROM p")
def r3_key_pairs(spark, d):
    return rounded(X.candidate_pairs(star_catalog(spark, d)).where("both_keys").select(*X.PAIR, "name_similarity"))


@R.add(_PAIRS_SQL + """ SELECT from_dataset, from_column, to_dataset, to_column, from_values, to_values, from_rows, to_rows FROM p
       WHERE from_dataset <> 'documents'""")
def r4_candidate_prefilter(spark, d):
    """Keys only pair with keys of the same kind; text keys and empty columns drop out."""
    catalog = S.column_catalog({**star_tables(spark, d), "documents": table(spark, d, "documents").select(
        F.when(F.col("doc_id") < 0, F.col("doc_id")).alias("doc_key"), F.col("source").alias("source_code"))}, exact=True)
    pairs = X.candidate_pairs(catalog).where("both_keys")
    return pairs.select(*X.PAIR, F.col("from_distinct").alias("from_values"), F.col("to_distinct").alias("to_values"),
                        "from_rows", "to_rows")


@R.add(_PAIRS_SQL + " SELECT from_dataset, from_column, to_dataset, to_column, from_values, to_values, common_values FROM p")
def r5_value_overlap(spark, d):
    return X.overlap_counts(star_tables(spark, d), [(*a, *b) for a, b in _PAIRS])


@R.add(_STAT_SQL + """ SELECT from_dataset, from_column, to_dataset, to_column, CASE WHEN fu AND tu THEN 'one-to-one'
       WHEN tu THEN 'many-to-one' WHEN fu THEN 'one-to-many' ELSE 'many-to-many' END AS relationship_type FROM m""")
def r6_cardinality_type(spark, d):
    out = X.measured_pairs(star_tables(spark, d), X.candidate_pairs(star_catalog(spark, d)))
    return out.select(*X.PAIR, "relationship_type")


@R.add(_STAT_SQL + """ SELECT from_dataset, from_column, to_dataset, to_column, round(fwd, 6) AS match_pct,
       CASE WHEN fwd >= 95 THEN 'inner' ELSE 'left' END AS join_strategy FROM m""")
def r7_join_strategy(spark, d):
    out = X.measured_pairs(star_tables(spark, d), X.candidate_pairs(star_catalog(spark, d)))
    return rounded(out.select(*X.PAIR, "match_pct", "join_strategy"))


_ORIENT_SQL = _STAT_SQL + """, t AS (SELECT *, CASE WHEN tu AND NOT fu THEN false WHEN fu AND NOT tu THEN true ELSE rev > fwd END AS turn FROM m),
    o AS (SELECT CASE WHEN turn THEN to_dataset ELSE from_dataset END AS from_dataset, CASE WHEN turn THEN to_column ELSE from_column END AS from_column,
                 CASE WHEN turn THEN from_dataset ELSE to_dataset END AS to_dataset, CASE WHEN turn THEN from_column ELSE to_column END AS to_column,
                 CASE WHEN turn THEN rev ELSE fwd END AS pct, CASE WHEN turn THEN fwd ELSE rev END AS cover,
                 CASE WHEN turn THEN tu ELSE fu END AS child_unique, CASE WHEN turn THEN fu ELSE tu END AS parent_unique,
                 name_similarity AS sim FROM t),
    c AS (SELECT *, least(1.0, CASE WHEN sim >= 0.6 THEN (0.2 * sim + 0.4 * pct / 100) / 0.6 ELSE pct / 100 END
                 + CASE WHEN child_unique <> parent_unique THEN 0.05 ELSE 0 END) AS confidence FROM o)"""


@R.add(_ORIENT_SQL + """, j AS (SELECT *, parent_unique AND confidence >= 0.8 AND (sim >= 0.6 OR cover >= 90)
         AND NOT (child_unique AND sim < 0.9 AND cover < 50) AS good FROM c),
       k AS (SELECT *, row_number() OVER (PARTITION BY from_dataset, from_column ORDER BY good DESC, sim DESC, cover DESC, to_dataset, to_column) AS rn FROM j)
       SELECT from_dataset, from_column, to_dataset, to_column, round(confidence, 6) AS confidence, good AND rn = 1 AS accepted FROM k""")
def r8_confidence(spark, d):
    edges = X.detect_relationships(star_tables(spark, d), star_catalog(spark, d), all_pairs=True)
    return rounded(edges.select(*X.PAIR, "confidence", "accepted"))


@R.add(_STAT_SQL + """ SELECT from_dataset, from_column, to_dataset, to_column,
       round(CASE WHEN name_similarity >= 0.6 THEN name_similarity END, 6) AS name_similarity,
       round(CASE WHEN fwd >= 50 THEN fwd END, 6) AS match_pct FROM m WHERE name_similarity >= 0.6 OR fwd >= 50""")
def r9_merge_candidates(spark, d):
    out = durable(X.measured_pairs(star_tables(spark, d), X.candidate_pairs(star_catalog(spark, d))))
    return rounded(X.merge_candidates(out.where("name_similarity >= 0.6"), out.where("match_pct >= 50"), "match_pct"))


_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@R.add(f"""WITH v AS (SELECT CAST(label AS VARCHAR) AS dataset, CAST(vec_id AS VARCHAR) AS col, CASE WHEN vec_id % 2 = 0 THEN 'key' ELSE 'measure' END
           AS st, embedding FROM embeddings)
       SELECT a.dataset AS from_dataset, a.col AS from_column, b.dataset AS to_dataset, b.col AS to_column,
       round(least(1.0, {_COSINE} + CASE WHEN a.st = 'key' OR b.st = 'key' THEN 0.05 ELSE 0 END), 6) AS embedding_similarity
       FROM v a JOIN v b ON a.dataset < b.dataset AND {_COSINE} >= 0.3""")
def r10_embedding_candidates(spark, d):
    columns = table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("dataset"), F.col("vec_id").cast("string").alias("column"),
        F.when(F.col("vec_id") % 2 == 0, "key").otherwise("measure").alias("semantic_type"), "embedding")
    return rounded(X.embedding_candidates(columns, threshold=0.3))


@R.add(_ORIENT_SQL + """, j AS (SELECT *, parent_unique AND confidence >= 0.8 AND (sim >= 0.6 OR cover >= 90)
         AND NOT (child_unique AND sim < 0.9 AND cover < 50) AS good FROM c WHERE from_dataset = 'lineitem' OR to_dataset = 'lineitem'),
       k AS (SELECT *, row_number() OVER (PARTITION BY from_dataset, from_column ORDER BY good DESC, sim DESC, cover DESC, to_dataset, to_column) AS rn FROM j)
       SELECT from_dataset, from_column, to_dataset, to_column, round(confidence, 6) AS confidence FROM k WHERE good AND rn = 1""")
def r11_incremental_detection(spark, d):
    stored = star_tables(spark, d)
    new = {"lineitem": stored.pop("lineitem")}
    return rounded(X.detect_relationships(new, star_catalog(spark, d), existing=stored).select(*X.PAIR, "confidence"))


@R.add(_ORIENT_SQL + """, j AS (SELECT *, parent_unique AND confidence >= 0.8 AND (sim >= 0.6 OR cover >= 90)
         AND NOT (child_unique AND sim < 0.9 AND cover < 50) AS good FROM c),
       k AS (SELECT *, row_number() OVER (PARTITION BY from_dataset, from_column ORDER BY good DESC, sim DESC, cover DESC, to_dataset, to_column) AS rn FROM j)
       SELECT from_dataset, from_column, to_dataset, to_column FROM k WHERE good AND rn = 1 AND confidence >= 0.9
         AND from_dataset IN ('orders', 'customer', 'nation') AND to_dataset IN ('orders', 'customer', 'nation')""")
def r12_relationship_lookup(spark, d):
    edges = X.detect_relationships(star_tables(spark, d), star_catalog(spark, d))
    return X.lookup_edges(edges, ["orders", "customer", "nation"], 0.9).select(*X.PAIR)


_JOINED = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def joined_star(spark, d):
    return J.star_join(star_tables(spark, d), EDGES, "lineitem").df


@R.add(f"""SELECT r_name AS region, p_brand AS brand, count(*) AS n,
           round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue FROM {_JOINED} GROUP BY 1, 2""")
def j1_star_join(spark, d):
    """Edges found from the values, then the join along them."""
    all_tables = star_tables(spark, d)
    edges = [r.asDict() for r in X.detect_relationships(all_tables, star_catalog(spark, d)).orderBy(*X.PAIR).collect()]
    sizes = {n: df.count() for n, df in all_tables.items()}
    star = J.star_join(all_tables, edges, J.base_table(edges, sizes))
    return star.df.groupBy(F.col("region_r_name").alias("region"), F.col("part_p_brand").alias("brand")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


@R.add("""SELECT c_custkey, c_name, coalesce(o_orderkey, -1) AS o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000""")
def j2_merge_left(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.merge(table(spark, d, "customer").select("c_custkey", "c_name"), big, "c_custkey", "o_custkey", "left").drop("o_custkey").fillna(-1, ["o_orderkey"])


@R.add("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def j2_merge_inner(spark, d):
    return J.merge(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name"),
                   "o_custkey", "c_custkey").select("o_orderkey", "c_name")


_CATALOG_COLUMNS = [("supplier", "s_suppkey"), ("supplier", "s_name"), ("supplier", "s_nationkey"), ("supplier", "s_acctbal"),
                    ("events", "event_id"), ("events", "ts"), ("events", "user_id"), ("events", "event_type"), ("events", "value"), ("events", "props")]


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", count(DISTINCT {c}) AS "distinct", count(*) AS row_count FROM {t}"""
                 for t, c in _CATALOG_COLUMNS))
def j3_catalog_join(spark, d):
    both = tables(spark, d, "supplier", "events")
    datasets = S.dataset_sizes(both)
    return J.catalog_with_datasets(S.column_catalog(both, exact=True).select("dataset", "column", "distinct"), datasets)


@R.add("""SELECT 'customer' AS dataset, count(*) AS n_rows, CAST(5 AS BIGINT) AS column_count,
            'c_custkey:bigint, c_name:string, c_nationkey:int, c_acctbal:double, c_mktsegment:string' AS columns,
            'c_nationkey -> nation.n_nationkey' AS relationships FROM customer UNION ALL
          SELECT 'nation', count(*), 3, 'n_nationkey:int, n_name:string, n_regionkey:int', '' FROM nation UNION ALL
          SELECT 'supplier', count(*), 4, 's_suppkey:bigint, s_name:string, s_nationkey:int, s_acctbal:double',
            's_nationkey -> nation.n_nationkey' FROM supplier""")
def j4_schema_view(spark, d):
    some = tables(spark, d, "customer", "nation", "supplier")
    catalog = durable(S.column_catalog(some))
    return J.schema_view(catalog, X.detect_relationships(some, catalog)).withColumnRenamed("rows", "n_rows")


@R.add("""SELECT c_custkey, c_name, true AS ordered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
          UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def j5_semi_anti(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    big = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    with_big = J.matching_rows(customers, big, ["c_custkey"]).withColumn("ordered", F.lit(True))
    return with_big.unionByName(J.new_rows(customers, big, ["c_custkey"]).withColumn("ordered", F.lit(False)))


QUERIES, ORACLES = R.queries, R.oracles
