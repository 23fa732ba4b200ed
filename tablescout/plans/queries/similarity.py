from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import similarity as E
from tablescout.plans.queries.base import Registry, rounded, table

R = Registry()

_V = "embedding::DOUBLE[]"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def first_vector(spark, d):
    """The vector that is searched for: that of the smallest id."""
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"]


@R.add(f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(greatest(0, least(1, {_COS})), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def e1_cosine(spark, d):
    e = table(spark, d, "embeddings")
    left = e.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("left_vec"), (F.col("vec_id") + 1).alias("right_id"))
    right = e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("right_vec"))
    return rounded(left.join(right, "right_id").select("left_id", "right_id", E.cosine("left_vec", "right_vec").alias("similarity")))


@R.add(f"""SELECT a.vec_id AS dataset, round({_COS}, 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b
           WHERE {_COS} > 0.15 ORDER BY {_COS} DESC, a.vec_id LIMIT 5""")
def e2_similar_datasets(spark, d):
    datasets = table(spark, d, "embeddings").select(F.col("vec_id").alias("dataset"), F.col("embedding").alias("description_embedding"))
    return rounded(E.similar_datasets(datasets, first_vector(spark, d), 5, 0.15).select("dataset", "similarity"))


@R.add(f"""SELECT a.vec_id AS "column", a.label AS dataset, concat('table_', a.label) AS table_name, round({_COS}, 6) AS similarity
           FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b WHERE {_COS} > 0.1 AND a.label <> 3 ORDER BY {_COS} DESC, a.vec_id LIMIT 10""")
def e3_similar_columns(spark, d):
    e = table(spark, d, "embeddings")
    columns = e.select(F.col("vec_id").alias("column"), F.col("label").alias("dataset"), F.col("embedding").alias("semantic_embedding"))
    datasets = e.groupBy(F.col("label").alias("dataset")).agg(F.first("embedding").alias("description_embedding")).withColumn(
        "table_name", F.concat(F.lit("table_"), F.col("dataset").cast("string")))
    out = E.similar_columns(columns, datasets, first_vector(spark, d), 3, 10, 0.1)
    return rounded(out.select("column", "dataset", "table_name", "similarity"))


@R.add(f"""SELECT a.vec_id AS insight_id, a.label AS domain, round({_COS}, 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b
           WHERE {_COS} > 0.05 AND a.label = 5 ORDER BY {_COS} DESC, a.vec_id LIMIT 5""")
def e4_similar_insights(spark, d):
    insights = table(spark, d, "embeddings").select(F.col("vec_id").alias("insight_id"), F.col("label").alias("domain"),
                                                    F.col("embedding").alias("insight_embedding"))
    return rounded(E.similar_insights(insights, first_vector(spark, d), 5, 5, 0.05).select("insight_id", "domain", "similarity"))


@R.add(f"""SELECT a.vec_id AS query_id, b.vec_id AS match_id, round({_COS}, 6) AS similarity,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {_COS} > 0.25
           QUALIFY rank <= 3""")
def e5_top_matches(spark, d):
    e = table(spark, d, "embeddings")
    out = E.top_matches(e, e, "vec_id", "embedding", 3, 0.25)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


@R.add(f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_COS} >= 0.3")
def e6_similar_pairs(spark, d):
    return rounded(E.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3))


QUERIES, ORACLES = R.queries, R.oracles
