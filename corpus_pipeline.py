"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before has kept and returns the columns of ``documents``; the last one returns the
pieces of the packed sequences.  Null, empty and very long texts, repeated rows, empty tables and further columns
are handled as the operators say; rows without a ``doc_id`` go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescout.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from tablescout.session import durable


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are; without any usable label all stay."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id; one row of rows that repeat an id."""
    groups = jaccard_join.near_duplicates(docs)
    kept = docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    rows = kept.select(F.struct("*").alias("r"), F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())).alias("n"))
    return rows.where("n = 1").select("r.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 20 and more words that also start earlier are cut out of the texts."""
    return substring_dedup.cut(docs, substring_dedup.repeats(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of every benchmark item."""
    leaks = decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
