"""Language model, classifiers, packing, nearest vectors, token counts and license notices."""

import math
import os
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tablescout.llm import ann, katz, language_id, license_scan, packing, quality, token_counts
from tablescout.llm.words import WordHashes, fold, raw

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_by_id(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}


def brute_katz(texts: dict, train: set) -> dict:
    tokens = {d: (t or "").encode().lower().split() + [b"</s>"] for d, t in texts.items()}
    uni = Counter(w for d in train for w in tokens[d])
    pairs = Counter(p for d in train for p in zip([b"<s>", *tokens[d]], tokens[d]))
    before = Counter()
    for (a, _), c in pairs.items():
        before[a] += c
    total, types = sum(uni.values()), len(uni)
    model = katz.unigram_model({r: n for r, n in Counter(uni.values()).items() if r <= katz.CUT + 1}, total, types, len(train))
    factor = katz.discounts({r: n for r, n in Counter(pairs.values()).items() if r <= katz.CUT + 1})
    low = {w: float(model.probability(np.array([c]))[0]) for w, c in uni.items()}
    high_sum, low_sum = Counter(), Counter()
    for (a, b), c in pairs.items():
        high_sum[a] += factor[min(c, katz.CUT + 1)] * c / before[a]
        low_sum[a] += low[b]

    def probability(a, b):
        if a not in before:
            return low.get(b, model.unknown)
        shrink = before[a] / (before[a] + 1) if 1 - high_sum[a] <= 1e-12 else 1
        if (a, b) in pairs:
            c = pairs[a, b]
            return factor[min(c, katz.CUT + 1)] * c / before[a] * shrink
        return (1 - high_sum[a] * shrink) / (1 - low_sum[a]) * low.get(b, model.unknown)

    for a in [*list(before)[:25], "never"]:  # exactly normalised over all types and the unknown word
        assert math.isclose(sum(probability(a, b) for b in [*uni, "never"]), 1, rel_tol=1e-9)
    return {d: (len(t), sum(w in uni for w in t), total, sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in t),
                sum(math.log10(probability(a, b)) for a, b in zip([b"<s>", *t], t))) for d, t in tokens.items()}


def check_katz(df, monkeypatch=None):
    texts = rows_by_id(df)
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2}
    rows = katz.score(df, fold("doc_id", 7) != 2).collect()
    expected = brute_katz(texts, train)
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        e = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (*e[:3], r.doc_id in train)
        assert math.isclose(r.base_score, e[3], rel_tol=1e-9) and math.isclose(r.score, e[4], rel_tol=1e-9)


def test_katz_equals_brute_force(documents, odd):
    check_katz(documents[0])
    check_katz(odd)


def test_katz_with_split_histories(documents, monkeypatch):
    """Frequent histories are dealt over several buckets; the scores stay the same."""
    monkeypatch.setattr(katz, "BUCKET", 4000)
    monkeypatch.setattr(katz, "MAX_FREQUENT", 400)
    monkeypatch.setattr(katz, "FLUSH", 3000)
    check_katz(documents[0])


def test_katz_with_one_bigram_in_every_document(spark, monkeypatch):
    """Occurrences of a bigram that copies of a text repeat are dealt by document; no bucket holds them all."""
    monkeypatch.setattr(katz, "BUCKET", 500)
    rows = [(i, "the same short text in each copy" if i % 3 else f"word{i} word{i % 50} again again again again") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    largest, of = [], katz.bigram_blocks
    monkeypatch.setattr(katz, "bigram_blocks", lambda *a: largest.append(of(*a)) or largest[-1])
    check_katz(docs)
    sizes = Counter()
    for r in largest[0].collect():
        sizes[r.bucket] += int(np.frombuffer(r.block, np.int64, 3)[2])
    assert sum(sizes.values()) == 1500 + sum(len(t.split()) for _, t in rows) and max(sizes.values()) <= 1.5 * katz.BUCKET


def test_katz_without_training(spark, nothing):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(docs, F.lit(False)).collect()}
    assert got == {1: (3, 0, 0, 0, 0), 2: (1, 0, 0, 0, 0), 3: (1, 0, 0, 0, 0)}
    assert katz.score(nothing, F.lit(True)).collect() == []


def test_text_hashes_tell_words_apart(monkeypatch):
    """Equal words, A-Z as a-z, have equal hashes and no others have, across slices, sliced columns and long words; it costs less than word by word."""
    rng = np.random.default_rng(3)
    odd = [None, "", " ", "a", "A a\x0bB\x0c", "\x1c odd \x85", "漢字 Ä ä", "x" * 63 + " " + "X" * 64 + " " + "x" * 65 + " x", "y" * 500 + " Y y " + "Y" * 500, None, "ab", "ba",
           "\n".join(f"W{i % 90} w{i}" for i in range(3000)), ""]
    words = [b for t in odd for b in (t or "").encode().lower().split()]
    column = pa.array(["left out", *odd, "left out"]).slice(1, len(odd))
    for size in (katz.TextHashes.SLICE, 200):
        monkeypatch.setattr(katz.TextHashes, "SLICE", size)
        for texts in (column, column.cast(pa.large_string())):
            got, lengths = katz.TextHashes().of(texts)
            assert list(lengths) == [len((t or "").encode().split()) for t in odd]
            assert len(set(zip(words, got.tolist()))) == len(set(words)) == len(set(got.tolist()))
    tokens, lengths = katz.token_hashes(column, katz.TextHashes())
    assert len(tokens) == len(words) + len(odd) == lengths.sum() and (tokens[np.cumsum(lengths) - 1] == katz.END).all()
    for none in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        assert [len(x) for x in katz.TextHashes().of(none)] == [0, len(none)]
    monkeypatch.undo()
    many = pa.array([" ".join(f"word{i}" for i in rng.integers(0, 50_000, 300)) for _ in range(1000)])
    new, old = katz.TextHashes(), WordHashes()

    def cost(f) -> float:
        begun = time.process_time()
        f()
        return time.process_time() - begun

    one_by_one = lambda: [old.of(t.lower().split()) for t in raw(many)]
    assert min(cost(lambda: new.of(many)) for _ in range(5)) < min(cost(one_by_one) for _ in range(5))


def test_bigram_blocks_come_back_whole():
    rng = np.random.default_rng(5)
    w1, w2 = rng.integers(0, 40, (2, 5000)).astype(np.uint64) * np.uint64(katz.START)
    doc = rng.integers(-30, 30, 5000)
    words, first, second, docs, known, local = katz.unpack_block(katz.pack_block(w1, w2, doc, doc % 3 > 0))
    assert sorted(zip(words[first], words[second], docs[local], known[local])) == sorted(zip(w1, w2, doc, doc % 3 > 0))


def check_packing(df, rows: list) -> None:
    tok = Tokenizer.from_file(WORD_BPE)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    pieces = packing.pack(df, WORD_BPE, with_ids=True).toPandas()
    copies = Counter(d for d, _ in rows)
    assert Counter(pieces[pieces.start == 0].doc_id) == copies
    assert pieces.length.sum() == sum(len(ids[d]) * n for d, n in copies.items())
    for p in pieces.itertuples():
        own = ids[p.doc_id][p.start:p.start + p.length]
        assert list(p.ids) == own and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    lengths = []
    for number, part in sorted(pieces.sort_values("offset").groupby("sequence_id")):
        assert number == len(lengths) and list(part.offset) == [0, *part.length.cumsum()[:-1]]
        lengths.append(part.length.sum())
    assert all(n == packing.LENGTH or n < packing.LENGTH and n & (n - 1) == 0 for n in lengths)
    assert all(n == packing.LENGTH for n in lengths[:pieces.length.sum() // packing.LENGTH])


def test_packing_is_an_exact_round_trip(documents, odd, nothing):
    check_packing(documents[0], list(documents[1].items()))
    check_packing(odd, [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    assert packing.pack(nothing, WORD_BPE).collect() == []


def test_fast_ids_equal_the_tokenizer():
    tok, fast = Tokenizer.from_file(WORD_BPE), packing.Tokens(WORD_BPE)
    rng = np.random.default_rng(1)
    letters = list("abzABZ  '’\"!?.,;:-_/\\()0123456789éÉñßÆÿŸİıſ漢🙂\t\n\r\x0b\x1c\x85\xa0\xad|<>") + ["<|endoftext|>", "'ll", "'S", "é"]
    for _ in range(1500):
        text = "".join(rng.choice(letters, int(rng.integers(0, 30))))
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_hilbert_curve_visits_every_cell_once_in_steps_of_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_neighbours(table, vectors: dict, every: int, k: int, least: float, settings=ann.Settings()) -> None:
    rows = ann.nearest(table, every, k, settings).collect()
    ids, x = np.array(sorted(vectors)), np.array([vectors[i] for i in sorted(vectors)], np.float64)
    hits = 0
    queries = [i for i in ids if i % every == 0]
    for q in queries:
        score = x @ x[np.searchsorted(ids, q)]
        others = ids != q
        order = np.lexsort((ids[others], -score[others]))[:k]
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, min(k, len(ids) - 1) + 1))
        assert all(math.isclose(r.score, score[np.searchsorted(ids, r.vec_id)], rel_tol=1e-9, abs_tol=1e-12) for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({r.vec_id for r in got} & set(ids[others][order].tolist())) / max(len(order), 1)
    assert hits / len(queries) >= least, hits / len(queries)


def test_neighbours_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 2000)] + 0.4 * rng.standard_normal((2000, 24))) * rng.uniform(0.5, 2, (2000, 1))
    x[rng.random(2000) < 0.3] = x[0]  # a third of the rows are one vector
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n int")
    check_neighbours(table, dict(enumerate(x)), 40, 20, 0.9)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table, 10, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 8, 0.5), (0, 3, 10, -1.0), (10, 1, 8, -0.5), (10, 2, 0, -1.0), (10, 3, 7, -1.0)]
    assert ann.nearest(table.where("1 = 0"), 10, 20).collect() == []


def test_language_of_held_out_documents(documents, odd, nothing):
    docs = documents[0]
    model = language_id.fit(docs)
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id.with_fold(language_id.predict(docs, model)).collect()]
    assert len(rows) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(odd, model).collect()]
    assert {d for d, lang in got if lang == "und"} == {0, 1, 2} and len(got) == 13
    assert language_id.fit(nothing) is None and language_id.predict(nothing, None).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    logits = rng.standard_normal((4000, 3)) * 0.8
    logits[np.arange(4000), y] += 1
    assert language_id.temperature(logits * 5, y) > 2 * language_id.temperature(logits, y)


def test_quality_of_held_out_documents(spark, documents, odd, nothing):
    docs, labels = documents[0], spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.with_fold(quality.score(docs, model)).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in quality.accepted(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}
    scores = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert scores[0] == scores[1] == 0 and all(0 <= s <= 1 for s in scores.values())
    assert quality.accepted(odd, model).columns == odd.columns
    for empty in (quality.fit(nothing, labels), quality.fit(docs, labels.where("1 = 0"))):
        assert empty is None and {r.score for r in quality.score(odd, empty).collect()} == {0.0}
    assert quality.accepted(odd, None).count() == 13


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    model = quality.QualityModel(np.ones(20, np.float32), rng.standard_normal((20, 6)).astype(np.float32),
                                 quality.unit(rng.standard_normal((200, 6)).astype(np.float32)), rng.integers(0, 2, 200).astype(np.float32), 4, 7)
    counts = rng.integers(0, 5, (30, 20)).astype(np.float32)
    z = quality.unit(np.sqrt(counts / counts.sum(axis=1, keepdims=True)) @ model.basis)
    for got, row in zip(quality.vote(model, counts), z):
        like = sorted(zip(model.vectors @ row, model.votes), key=lambda p: -p[0])[:7]
        assert math.isclose(got, sum(s * v for s, v in like) / sum(s for s, _ in like), rel_tol=1e-4)


def test_equal_votes_are_taken_in_the_order_of_the_sample():
    rng = np.random.default_rng(5)
    for columns in (10, 64, 65, 300):
        like = rng.integers(0, 4, (40, columns)).astype(np.float32) / 4
        for k in (1, 7, columns):
            expected = np.sort(np.argsort(-like, axis=1, kind="stable")[:, :k], axis=1)
            assert np.array_equal(quality.nearest(like, k), expected)


def test_models_reach_workers_that_have_no_copy_of_the_package(documents, tmp_path):
    """Another driver, started elsewhere, whose workers cannot import the package."""
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))!r})
from tablescout.llm import language_id, quality
from tablescout.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {str(tmp_path / 'checkpoint')!r}}})
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
assert quality.score(docs, quality.fit(docs, labels)).count() == 60 == quality.accepted(docs, quality.fit(docs, labels), 0.0).count()
assert language_id.predict(docs, language_id.fit(docs)).where("lang_pred <> 'und'").count() > 50
def missing(batches):
    try:
        import tablescout
    except ModuleNotFoundError:
        yield from batches
assert docs.select("doc_id").mapInArrow(missing, "doc_id long").count() == 60, "the worker found the package"
""")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]


def test_ids_with_usable_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, "a"), (1, [0.0, 0.0], 1, "a"), (1, [1.0, 0.5], 1, "a"), (2, [float("-inf"), 1.0], 1, "a"), (2, [0.3, 0.3], 1, "a"),
            (3, [0.9, 0.0], 1, "a"), (3, [0.1, 0.0], 1, "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(table, 20, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.3), (0, 3, 3, 0.1)]


@pytest.fixture(scope="module")
def unigram():
    pieces = token_counts.vocabulary(PIECES)
    tok = Tokenizer(models.Unigram(pieces, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return pieces, tok


def test_token_counts_equal_the_library(spark, documents, odd, nothing, unigram):
    _, tok = unigram
    for df in (documents[0], odd):
        rows = token_counts.count_tokens(df, PIECES).collect()
        texts = rows_by_id(df)
        assert len(rows) == df.where("doc_id is not null").count()
        assert all(r.n_tokens == len(tok.encode(texts[r.doc_id] or "").ids) for r in rows)
    assert token_counts.count_tokens(nothing, PIECES).collect() == []


@pytest.mark.parametrize("whole_bytes", [True, False])
def test_ties_and_unknown_characters(whole_bytes):
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -2.0), ("aa", -2.0)]
    pieces += [(f"<0x{b:02X}>", -9.0) for b in range(256)] * whole_bytes
    tok = Tokenizer(models.Unigram(pieces, 0, whole_bytes))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    counter, rng = token_counts.UnigramCounter(pieces), np.random.default_rng(8)
    for _ in range(2000):
        text = "".join(rng.choice(list("ab zyé漢"), int(rng.integers(0, 12))))
        assert counter.text(text)[0] == len(tok.encode(text).ids), text


def test_runs_of_blanks_and_spelled_control_pieces(spark, unigram):
    _, tok = unigram
    texts = ["a    b", "    return x", "a" + " " * 40 + "b", " ", "  ", "\t  x  ", "tab\t    x", "end  "]
    rows = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(tok.encode(t).ids) for i, t in enumerate(texts)}
    counter = token_counts.UnigramCounter(token_counts.vocabulary(PIECES), special=token_counts.special_pieces(PIECES))
    assert len(token_counts.special_pieces(PIECES)) == 259
    for spelled in ("</s>", "<s>", "<unk>", "<0x0A>"):
        assert counter.text(spelled)[0] > 2  # no single token, as the piece of that name would be


@pytest.mark.parametrize("pieces", [
    [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("▁▁", -2.5), ("▁▁▁", -3.0), ("▁a", -2.2)],  # runs of marks
    [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("a▁", -1.5), ("b▁▁a", -1.2), ("▁a", -2.2)],  # pieces that reach over a mark
    [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -1.5)],  # a vocabulary without the mark
])
def test_marks_inside_pieces(pieces):
    tok = Tokenizer(models.Unigram(pieces, 0, False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    counter, rng = token_counts.UnigramCounter(pieces, special=frozenset(["<unk>"])), np.random.default_rng(9)
    for _ in range(1000):
        text = "".join(rng.choice(list("ab  z"), int(rng.integers(0, 14))))
        assert counter.text(text)[0] == len(tok.encode(text).ids), text


def test_license_notices(spark, odd, nothing):
    apache, mit = license_scan.TEMPLATES["apache-2.0"], license_scan.TEMPLATES["mit-text"]
    changed = mit.replace("merge, publish,", "merge, adapt, publish,").replace("free of charge", "FREE of cost").replace("persons", "people")
    rows = [(1, f"one two {apache} three {apache} {apache}"), (2, f"lead\n{changed}\ntail"), (3, "the software is licensed under the moon"), (4, None), (5, "")]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word, round(r.coverage, 3))
                 for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g for g in got if g[0] == 1] == [(1, "apache-2.0", s, s + 7, 1.0) for s in (2, 10, 17)]
    assert [(g[0], g[1], g[2]) for g in got if g[0] > 1] == [(2, "mit-text", 1)] and 0.9 < got[-1][4] < 1
    assert license_scan.scan(odd).count() == license_scan.scan(nothing).count() == 0


def test_alignment_rises_and_finds_moved_gaps():
    rng = np.random.default_rng(5)
    for _ in range(200):
        b = [f"t{x}" for x in rng.integers(0, 15, 20)]
        a = [w for w in b if rng.random() > 0.2]
        a[len(a) // 2:len(a) // 2] = ["z"] * int(rng.integers(0, 4))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    unique = [f"u{i}" for i in range(50)]
    some = unique[:20] + ["x", "y"] + unique[25:]
    assert len(license_scan.align(some, unique)) == 45


def test_longest_increasing_subsequence():
    rng = np.random.default_rng(9)
    for _ in range(200):
        b = rng.permutation(9)
        best = max(sum(1 for _ in s) for m in range(512) for s in [[b[i] for i in range(9) if m >> i & 1]] if s == sorted(s))
        assert len(license_scan.increasing(list(enumerate(b.tolist())))) == best


LICENSES = {
    "Released under the BSD License.": "bsd",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
    "Licensed under the Apache License, Version 1.1.": "apache-1.1",
    "distributed under the terms of the GNU GPL v2 or later": "gpl-2.0",
    "free to share under the LGPL": "lgpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "Released under the BSD 3-Clause License.": "bsd-3-clause",
    "Released under the ISC License.": "isc",
    "Released under the Modified BSD License.": "bsd-3-clause",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Released under the moon and the license of nobody.": None,
}


def test_licenses_are_told_apart_by_their_names():
    """Sentences that differ in the naming word only, in the usual spellings, most of them not in the given documents."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8, license_scan.NAMES, license_scan.SPELLINGS, license_scan.IDENTIFIERS)
    for text, name in LICENSES.items():
        assert [n[0] for n in scanner.notices(f"Some text before it. {text} And some words after it.".encode())] == ([name] if name else []), text


def test_whole_license_texts_and_headers():
    """Each text, as it is and as a numbered comment, is found under its own name and no sister license's."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8, license_scan.NAMES, license_scan.SPELLINGS, license_scan.IDENTIFIERS)
    assert license_scan.NAMES.keys() == license_scan.TEMPLATES.keys()
    parts = {"mit-full": {"mit-text", "mit-full"}, "apache-2.0-header": {"apache-2.0", "apache-2.0-header"}}
    for name, text in license_scan.TEMPLATES.items():
        if name.endswith(("-header", "-text", "-full", "~author")):
            words = text.split()
            comment = "/*\n" + "\n".join(" * " + " ".join(words[i:i + 11]) for i in range(0, len(words), 11)) + "\n */"
            license = name.split("~")[0]
            wanted = parts.get(license, {license})
            for form in (text, comment, comment.replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")):
                got = {n[0] for n in scanner.notices(f"int x;\n{form}\nint y;".encode())}
                # A header's own sentence may be reported as the short notice it holds.
                assert wanted <= got and got - wanted <= {license.removesuffix("-header")}, (name, got)
