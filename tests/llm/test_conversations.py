"""Repair of conversations against plain searches over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tablescout.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, copies string, fault int, piece string, `first` int"
FORM = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, [])
        if lot:
            row = (turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
            out[conv] += [row] * (2 if lot == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_edits(rows, faults):
    """Cheapest (cost, letters, lines) by a search over rows and states with inserts of both roles everywhere."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to is not None:
                        way = (cost + 2, audit + "I", lines + [f"{role}:"])
                        best[to] = min(best.get(to, way), way, key=lambda w: w[:2])
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, cost + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(step.get((state, role[:1])), cost + more, "K", [f"{role}:{text}"])]
                ways += [(step.get((state, to[0])), cost + 2 + more, "R", [f"{to}:{text}"]) for to in ("user", "assistant")]
            for to, paid, letter, line in ways:
                if to is not None:
                    way = (paid, audit + letter, lines + line)
                    after[to] = min(after.get(to, way), way, key=lambda w: w[:2])
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])


def every_edit(rows, faults):
    """The same by trying all edits of a very short conversation."""
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    found = []
    options = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", r[1][:1]), ("R", "u"), ("R", "a")] for r, f in zip(rows, faults)]
    for edits in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            letters, initials, cost = "I" * len(inserts[0]), list(inserts[0]), 0
            for (letter, initial), fault, more in zip(edits, faults, inserts[1:]):
                letters += letter + "I" * len(more)
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and fault == "truncated")
                initials += ([] if initial is None else [initial]) + list(more)
            if FORM.fullmatch("".join(initials)):
                found.append((cost + 2 * letters.count("I"), letters))
    return min(found)


def brute_digest(rows):
    out = {}
    for conv, talk in brute_damage(rows).items():
        faults = brute_faults(talk)
        turns = [t for t, *_ in talk if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(talk, talk[1:])]
        cost, audit, lines = brute_edits(talk, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def agree(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    got = repair.digest(repair.repair(repair.damage(df)), df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    expected = brute_digest(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected
    return expected


def talk(rng, conv, n, odd=0.3):
    roles, out = ["user", "assistant"], []
    for turn in range(n):
        role = roles[turn % 2] if rng.random() > odd else rng.choice(["user", "assistant", "system", "tool", "", None, "Ärger"])
        text = rng.choice(["Yes.", "No!", "cut off", "", " \t\n", f"text {turn}.", f"more {rng.random()}", None])
        out.append((conv, turn if rng.random() > 0.05 else None, role, text))
    return out


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert any(x[6] for x in agree(spark, rows).values())


def test_odd_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randrange(1, 12), rng.random())]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (200, None, "user", "x"), (200, None, "user", "x"), (201, 5, "user", "long " * 40_000 + "."),
             (202, -3, "user", "a."), (202, 9, "assistant", "b."), (203, 1, "system", "only."), (204, 2, "user", "x.\x1c"), (205, 2, "user", "x.\x85")]
    rows += [rows[5]] * 7
    agree(spark, rows)


def test_empty_table_and_no_rows_after_damage(spark):
    agree(spark, [])
    gone = [(c, 0, "user", "a.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and set(agree(spark, gone).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_conversation_over_many_pieces(spark):
    """A third of all rows in one conversation, one of equal rows, one of rows that only swap states."""
    rng = random.Random(2)
    rows = talk(rng, 7, 3000) + [(8, 1, "user", "same.")] * 900 + [(9, t, "tool", f"t{t}.") for t in range(700)]
    rows += [(10, t, "assistant", f"a{t}.") for t in range(700)] + [r for c in range(20, 60) for r in talk(rng, c, 8)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
        stored = repair.pieces(repair.faults(repair.damage(df)))
        spread = {r.conv_id: r.n for r in stored.select("conv_id", "piece").distinct().groupBy("conv_id").count().withColumnRenamed("count", "n").collect()}
        assert spread[7] >= 3 and spread[9] >= 2
        assert {c for c, _ in repair.borders(stored)} == {c for c, n in spread.items() if n > 1}
        agree(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("seed", range(3))
def test_search_against_every_edit(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c."])) for t in range(rng.randrange(1, 4))]
        faults = brute_faults(rows)
        assert brute_edits(rows, faults)[:2] == every_edit(rows, faults)


def survivors(rows, faults):
    ways, out = repair.Survivors(), []
    widest = 0
    for i, ((_, role, _), fault) in enumerate(zip(rows, faults)):
        out += ways.push(i, role[:1], fault in ("blank", "duplicate"), fault == "truncated", 1)
        widest = max(widest, i + 1 - len(out))
    end = ways.end()
    cost = ways.costs()[end] + 2 * len(repair.CLOSING[end])
    out += ways.finish(end)
    assert [i for i, _ in out] == list(range(len(rows)))
    return cost, "".join(c for _, c in out) + repair.CLOSING[end], widest


def test_survivors_equal_the_search_and_forget_what_is_decided():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(rng.randrange(0, 40))]
        faults = brute_faults(rows)
        if rows:
            assert survivors(rows, faults)[:2] == brute_edits(rows, faults)[:2]
    rows = [(t, ["user", "assistant"][t % 2] if rng.random() > 0.1 else "system", f"{t}.") for t in range(20_000)]
    assert survivors(rows, brute_faults(rows))[2] < 200
