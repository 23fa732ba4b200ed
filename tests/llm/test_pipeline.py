"""The pipeline's stages against their operators' brute-force results, and the whole of it."""

import numpy as np

import corpus_pipeline
from test_near_copies import brute_components, brute_contained, brute_repeats, brute_sets
from tablescout.llm import quality
from tablescout.session import durable


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]


def test_every_stage_takes_effect_on_what_the_one_before_kept(spark, documents):
    folder = "/root/testdata/sf0.001"
    docs = documents[0]
    columns = docs.columns
    (_, good), (_, single), (_, cut), (_, clean), (_, pack) = corpus_pipeline.STAGES

    kept = durable(good(spark, docs, folder))
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s >= 0.5} and kept.columns == columns

    texts = {r.doc_id: r.text for r in kept.collect()}
    one = durable(single(spark, kept, folder))
    assert {r.doc_id for r in one.collect()} == {d for d, (_, c) in brute_components(brute_sets(texts)).items() if c == d} and one.columns == columns

    texts = {r.doc_id: r.text for r in one.collect()}
    less = durable(cut(spark, one, folder))
    after = {r.doc_id: r.text for r in less.collect()}
    assert less.columns == columns and all(len(r.text) == r.n_chars for r in less.collect())
    assert {d: len((t or "").encode().split()) for d, t in after.items()} == {d: n - gone for d, (n, gone, _) in brute_repeats(texts).items()}

    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    rest = durable(clean(spark, less, folder))
    leaks = {d for d, *_ in brute_contained(after, items)}
    assert {r.doc_id for r in rest.collect()} == set(after) - leaks and rest.columns == columns

    pieces = pack(spark, rest, folder).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in rest.collect()}
    whole = corpus_pipeline.run(spark, folder).toPandas()
    order = ["doc_id", "start"]
    assert np.array_equal(whole.sort_values(order).to_numpy(), pieces.sort_values(order).to_numpy())


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    folder = "/root/testdata/sf0.001"
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    once = corpus_pipeline.keep_one_of_near_duplicates(spark, odd, folder)
    ids = [r.doc_id for r in once.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 3, 4, 8} <= set(ids) and not {5, 6, 7} & set(ids)
