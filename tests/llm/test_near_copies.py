"""Substring dedup, Jaccard join and decontamination against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tablescout.llm import decontaminate, jaccard_join, substring_dedup
from tablescout.llm.components import components
from tablescout.llm.words import WordHashes, mix, shingle_set


def brute_repeats(texts: dict, n: int = 20) -> dict:
    seen, out = set(), {}
    for doc in sorted(texts):
        words = (texts[doc] or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - n + 1):
            key = tuple(words[a:a + n])
            if key in seen:
                gone[a:a + n] = [True] * n
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_sets(texts: dict, n: int = 5) -> dict:
    out = {}
    for doc, text in texts.items():
        w = (text or "").encode().lower().split()
        out[doc] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute_components(sets: dict, percent: int = 80) -> dict:
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    holders: dict = {}
    for d in sets:
        for g in sets[d]:
            holders.setdefault(g, []).append(d)
    for d in sets:
        for e, common in Counter(e for g in sets[d] for e in holders[g] if e < d).items():
            if 100 * common >= percent * (len(sets[d]) + len(sets[e]) - common):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}


def removed(docs) -> dict:
    rows = substring_dedup.digest(docs, substring_dedup.repeats(docs)).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}


def near(docs, **kw) -> dict:
    rows = jaccard_join.near_duplicates(docs, **kw).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def by_id(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}


@pytest.fixture(scope="module")
def planted(spark):
    """Small words, so that all kinds of partial repeats, overlaps and near copies come up."""
    rng = np.random.default_rng(1)
    rows, pool = [], [[f"v{x}" for x in rng.integers(0, 400, 120)] for _ in range(6)]
    for i in range(160):
        words = [f"v{x}" for x in rng.integers(0, 400, rng.integers(0, 90))]
        if i % 2:
            source = pool[rng.integers(6)]
            a, b = sorted(rng.integers(0, 121, 2))
            words[len(words) // 2:len(words) // 2] = source[a:b]
        if i % 3 == 0 and rows:
            words = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 4)):
                if words:
                    words[rng.integers(len(words))] = f"v{rng.integers(400)}"
        if i % 17 == 0:
            words = ["same"] * int(rng.integers(1, 70))
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats_equal_brute_force(documents, planted):
    assert removed(documents[0]) == brute_repeats(documents[1])
    assert removed(planted) == brute_repeats(by_id(planted))


def test_repeats_of_odd_rows(odd, nothing):
    assert removed(odd) == brute_repeats(by_id(odd))
    assert removed(nothing) == {}
    assert substring_dedup.repeats(nothing).collect() == []


def test_cut_keeps_rows_columns_and_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"a\n{passage}\nb", 5, "k"), (2, f"  c\t{passage} d\n e ", 6, "k"), (3, None, None, "k"), (4, "f  g", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    out = {r.doc_id: r for r in substring_dedup.cut(docs, substring_dedup.repeats(docs)).collect()}
    assert out[1].text == rows[0][1] and out[3].text is None and out[4].text == "f  g"
    assert out[2].text == "c\td\n e " and out[2].n_chars == 7
    assert [out[i].spans for i in (1, 4)] == ["k", None]


def test_components_equal_brute_force(documents, planted):
    assert near(documents[0]) == brute_components(brute_sets(documents[1]))
    sets = brute_sets(by_id(planted))
    assert near(planted) == brute_components(sets)
    assert near(planted, percent=60) == brute_components(sets, 60)


def test_components_of_odd_rows(odd, nothing):
    texts = by_id(odd)
    got = near(odd)
    assert got == brute_components(brute_sets(texts))
    assert got[0] == (0, 0) and got[2] == (0, 2)  # empty sets link with nothing
    assert near(nothing) == {}


def test_large_group_of_near_copies(spark):
    """A third of the rows are copies that all differ a little; no link between different texts is lost."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.integers(0, 300, 5):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(docs) == brute_components(brute_sets(dict(rows)))


@pytest.mark.parametrize("low, high", [(1, 1), (2, 3), (4, 6), (7, 11), (20, 33), (150, 247), (900, 1484)])
def test_similar_sets_share_a_signature(low, high):
    """The pigeonhole bound itself, at the largest difference that still links."""
    rng = np.random.default_rng(low)
    plan = jaccard_join.allocate(low, high, 1000, 80)
    assert plan.ones + 2 * plan.twos >= plan.need
    for _ in range(60):
        size = int(rng.integers(low, high + 1))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        gone = int(rng.integers(0, size // 5 + 1))
        grown = int(rng.integers(0, max((size - gone) * 100 // 80 - size, 0) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, grown).astype(np.uint64) * np.uint64(2)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 80 * (len(a) + len(b) - common) and min(len(a), len(b)) >= low:
            assert len(np.intersect1d(jaccard_join.signatures(a, plan, 3)[0], jaccard_join.signatures(b, plan, 3)[0]))


def test_passage_that_many_documents_quote(spark, monkeypatch):
    """Frequent signatures are left out where other ones suffice, and no link is lost by that."""
    monkeypatch.setattr(jaccard_join, "HEAVY", 3)
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = [f"w{x}" for x in rng.integers(0, 10 ** 6, int(rng.integers(5, 200)))]
        words[len(words) // 3:len(words) // 3] = passage
        if i % 6 == 0 and rows:
            words = rows[int(rng.integers(len(rows)))][1].split()
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = f"n{rng.integers(10 ** 6)}"
        rows.append((i, " ".join(words)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(brute_sets(dict(rows)))


def test_partner_above_the_top_of_a_band(spark):
    """A set at its band's top and a similar one of the next band, whose only shared signatures are frequent ones."""
    size, larger, others = 797, 996, 20
    edges = jaccard_join.bands(larger)
    band = int(np.searchsorted(edges, size, "right")) - 1
    plan = jaccard_join.allocate(int(edges[band]), int(edges[band + 1]) - 1, others + 1, 80)
    assert edges[band + 1] == size + 1 and not plan.twos
    hashes = WordHashes()
    segment = lambda w: int(shingle_set([w.encode()], hashes, 1)[0] >> np.uint64(32)) * plan.ones >> 32
    a = [f"a{i}" for i in range(size)]
    open_ = {segment(w) for w in a}
    extra = []  # each one changes another segment
    for i in range(10 ** 6):
        if len(extra) < larger - size and segment(f"b{i}") in open_:
            extra.append(f"b{i}")
            open_.remove(segment(extra[-1]))
        elif len(extra) == larger - size:
            break
    quoted = [w for w in a if segment(w) in open_]
    texts = [a, a + extra]
    for i in range(others):
        own = [w for w in (f"c{i}x{j}" for j in range(900)) if segment(w) not in open_]
        texts.append(quoted + own[:700 - len(quoted)])
    # Neither of the two leads a signature.
    ids = np.arange(1, len(texts) + 1)
    ids = ids[np.argsort(mix(ids.astype(np.uint64)))][::-1].tolist()
    rows = [(d, " ".join(t)) for d, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, words=1).collect()}
    assert found[ids[0]] == found[ids[1]] == min(ids[:2]) and len(set(found.values())) == others + 1


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 21), (3, 3), (21, 22), (22, 30), (30, 20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 20: 20, 21: 20, 22: 20, 30: 20}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_shingles_of_short_texts():
    h = WordHashes()
    assert len(shingle_set([], h, 5)) == 0
    assert len(shingle_set(b"a b".split(), h, 5)) == 1
    assert shingle_set(b"a b".split(), h, 5) != shingle_set(b"a b c".split(), h, 5)
    assert len(shingle_set(b"a a a a a a a".split(), h, 5)) == 1


def brute_contained(docs: dict, items: dict, percent: int = 80) -> set:
    d, b = brute_sets(docs), brute_sets(items)
    out = {(x, y, len(b[y] & d[x]), len(b[y])) for x in d for y in b if b[y] and 100 * len(b[y] & d[x]) >= percent * len(b[y])}
    line = lambda t: b" " + b" ".join((t or "").encode().lower().split()) + b" "
    lines = {x: line(t) for x, t in docs.items()}
    short = {y: line(t) for y, t in items.items() if 0 < len((t or "").split()) < 5}
    return out | {(x, y, 1, 1) for x, t in lines.items() for y, s in short.items() if s in t}


def test_containment_equals_brute_force(spark, odd, nothing):
    rng = np.random.default_rng(4)
    items = {i: " ".join(f"i{x}" for x in rng.integers(0, 900, int(rng.integers(1, 60)))) for i in range(50)} | {50: "", 51: None, 52: " ".join(f"base{i}" for i in range(9))}
    docs = {}
    for i in range(200):
        words = [f"d{x}" for x in rng.integers(0, 5000, int(rng.integers(0, 300)))]
        piece = (items[int(rng.integers(50))] or "").upper().split()
        for _ in range(int(rng.integers(0, 5))):
            if piece:
                piece[int(rng.integers(len(piece)))] = "changed"
        words[len(words) // 2:len(words) // 2] = piece
        docs[i] = "\t".join(words)
    table = lambda d, name: spark.createDataFrame([(k, v, 1) for k, v in d.items()], f"{name} long, text string, h int")
    run = lambda a, b: {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contained(a, b).collect()}
    assert run(table(docs, "doc_id"), table(items, "item_id")) == brute_contained(docs, items)
    assert run(odd, table(items, "item_id")) == brute_contained(by_id(odd), items)
    assert run(nothing, table(items, "item_id")) == run(odd, table(items, "item_id").where("1 = 0")) == set()


def dense_components(sets: dict, percent: int = 80) -> dict:
    """As ``brute_components``, by a product of matrices: for many sets that share most of what they share."""
    ids, often = sorted(sets), Counter(g for s in sets.values() for g in s)
    place = {g: i for i, g in enumerate(g for g, n in often.items() if n > 1)}
    member = np.zeros((len(ids), len(place)), np.float32)
    for row, d in enumerate(ids):
        member[row, [place[g] for g in sets[d] if g in place]] = 1
    size = np.array([len(sets[d]) for d in ids])
    root = np.arange(len(ids))
    common = member @ member.T
    linked = 100 * common >= percent * (size[:, None] + size - common)
    while True:
        low = np.where(linked, root, len(ids)).min(axis=1)
        low = np.minimum(root, low)[np.minimum(root, low)]
        if (low == root).all():
            return {d: (int(size[i]), ids[root[i]]) for i, d in enumerate(ids)}
        root = low


def edited(rng, words: list, edits: int) -> list:
    words = list(words)
    for _ in range(edits):
        at = int(rng.integers(len(words)))
        kind = rng.integers(3)
        words[at:at + (kind != 0)] = [] if kind == 2 else [f"e{rng.integers(10**9)}"]
    return words


def test_large_groups_of_partly_similar_copies(spark, monkeypatch):
    rng = np.random.default_rng(21)
    one = [f"t{i}" for i in range(150)]
    two = [w if i % 10 < 7 else f"u{i}" for i, w in enumerate(one)]  # another text that shares most words, few shingles
    near_one = one[:110] + [f"v{i}" for i in range(40)]  # a text whose copies share three quarters with those of the first
    texts = [edited(rng, one, int(rng.integers(0, 9))) for _ in range(1500)]
    texts += [edited(rng, near_one, int(rng.integers(0, 7))) for _ in range(500)] + [edited(rng, two, int(rng.integers(0, 6))) for _ in range(200)]
    for i in range(300):  # a passage that texts of all sizes quote
        own = [f"p{i}x{j}" for j in range(int(rng.integers(20, 160)))]
        texts.append(own[:10] + one[20:20 + int(rng.integers(40, 100))] + own[10:])
    ids = rng.permutation(len(texts)).tolist()
    docs = {d: " ".join(t) for d, t in zip(ids, texts)}
    formed = []
    plausible = jaccard_join.plausible
    monkeypatch.setattr(jaccard_join, "plausible", lambda pairs, *a: formed.append(pairs.count()) or plausible(pairs, *a))
    got = near(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5))
    expected = dense_components(brute_sets(docs))
    assert got == expected
    parts = Counter(c for _, c in expected.values())
    assert max(parts.values()) > 500 and sum(n == 1 for n in parts.values()) > 400  # one large component, many texts apart
    assert sum(formed) < 40 * len(docs)  # all pairs would be half a thousand times as many as texts


def test_many_equal_frequent_parts_in_several_tasks(spark):
    """Every text of a group is apart from all others although they share a frequent passage of most of their length."""
    rng = np.random.default_rng(22)
    passage = [f"q{i}" for i in range(90)]
    docs = {i: " ".join(passage + [f"o{i}x{j}" for j in range(int(rng.integers(24, 60)))]) for i in range(400)}
    docs |= {1000 + i: " ".join(docs[i].split()[:-2]) for i in range(40)}
    got = near(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7))
    assert got == dense_components(brute_sets(docs))
    assert all(got[1000 + i][1] == i for i in range(40))


def test_short_items_and_rows_that_share_an_id(spark):
    docs = [(1, "so it is said that The answer is Seven indeed and that is all there is to it"), (2, "seven"), (3, "the answer\tis\nseven"), (4, "the answer is seventy"),
            (5, "clean words only here and nothing else to be found"), (5, "but this row of five says the answer is seven"), (6, None), (None, "seven")]
    long = "one two three four five six seven eight nine ten"
    docs += [(7, "x " + long + " y"), (7, "unrelated text of the same id which holds no item at all")]
    items = [(10, "the answer is seven"), (11, "seven"), (12, "is"), (13, long), (13, "another text of this item that nobody holds at all"), (14, ""), (15, "answer is seven indeed and")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles, r.containment) for r in decontaminate.contained(d, i).collect()}
    short = (1, 1, 1.0)
    assert got == {**{(x, 10): short for x in (1, 3, 5)}, **{(x, 11): short for x in (1, 2, 3, 5, 7)}, **{(x, 12): short for x in (1, 3, 4, 5)},
                   (7, 13): (6, 6, 1.0), (1, 15): short}
