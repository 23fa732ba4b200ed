"""Repair of conversations with the fewest edits: survivor-coalescence Viterbi over damaged turns.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``.  Its rows, by turn, may be kept
(0), given the role ``user`` or ``assistant`` (2) or deleted (3, required for blank and duplicate rows); empty rows of
either role may be inserted anywhere (2); a truncated row that stays costs 1 more.  Of the cheapest edits those whose
letters (``D I K R``) come first in ASCII order are taken; they fix every role, because the pattern leaves one choice.

* **Survivors.**  Four states, each with its cheapest path as a branch of one tree.  Nodes count what refers to
  them; a path that no survivor needs is released at once.  When all survivors share an ancestor, everything up to it is
  decided and handed out.  A survivor that another one beats even after any possible bridge is dropped, so the branch
  that deletes everything does not keep the tree alive.  Paths of equal cost are compared row by row over all that is
  undecided.  Codes of one row (``D, IK, IR, K, R``) are prefix-free, so the first row that differs decides.
* **Size.**  Identical rows are one row with a count.  Rows are range-sorted into pieces, so a conversation may span any
  number of pieces and no task holds more than one piece's undecided rows.  For conversations that span pieces, each
  piece yields the cheapest cost and the order of its paths between any two states; the states at the borders follow
  from those on the driver (sixteen numbers per border).  All pieces are then decoded side by side.
* **Digest.**  A conversation inside one piece is hashed there.  One that spans pieces is summed up in blocks of about a
  megabyte, which one task streams through SHA-256; that is sequential by nature.  The audit is a letter per edit and
  belongs to one value.

Defined cases: a null role or text is one space; null ids form a conversation of their own; null turns come first;
rows of one turn are ordered by role, then text; an empty role has no initial and cannot be kept.  A conversation
without rows has nothing to repair.  Rows that repeat are duplicates.  Columns other than the four are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.words import small_batches
from tablescout.session import durable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; the state that a further turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
CLOSING = ("", "II", "I", "")
#: What it costs at most to go on from one state (row) as from another (column).
BRIDGE = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
BLOCK_BYTES = 1 << 20


def _after(state: int, initial: str) -> int | None:
    """The state after a kept row, None if it cannot be kept."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _moves(initial: str, forced: bool, truncated: bool) -> list[list[tuple[str, int, int]]]:
    """Per state the codes, costs and targets of one row.

    An insert before a deleted row is as good after it and reads worse, and two inserts before a row lead to a state that
    accepts no more than the one before them, so at most one insert stands before a row that stays.
    """
    out = []
    for state in range(4):
        moves = [("D", DELETE, state)]
        for before, at, paid in () if forced else (("", state, 0), ("I", NEXT[state], INSERT)):
            kept = _after(at, initial)
            if kept is not None:
                moves.append((before + "K", paid + KEEP + TRUNCATED * truncated, kept))
            moves.append((before + "R", paid + REROLE + TRUNCATED * truncated, NEXT[at]))
        out.append(moves)
    return out


class Node:
    """One row on a path: the code of its edits, and how many nodes and survivors refer to it."""

    __slots__ = ("parent", "code", "row", "refs")

    def __init__(self, parent: Node | None, code: str, row) -> None:
        self.parent, self.code, self.row, self.refs = parent, code, row, 0


def _first(a: Node, code_a: str, b: Node, code_b: str) -> bool:
    """Whether path ``a`` reads before path ``b``; both hold the same rows."""
    less = code_a < code_b
    while a is not b:
        if a.code != b.code:
            less = a.code < b.code
        a, b = a.parent, b.parent
    return less


class Survivors:
    """The cheapest path to each state, and what all of them agree on."""

    def __init__(self, entry: int = START) -> None:
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.cost: list[int | None] = [None] * 4
        self.node: list[Node | None] = [None] * 4
        self.cost[entry], self.node[entry], self.base = 0, self.root, 0
        self.moves: dict = {}

    def push(self, row, initial: str, forced: bool, truncated: bool, copies: int) -> list[tuple[object, str]]:
        """Add a row and its identical copies, which go; returns the rows decided by it with their codes."""
        key = initial if initial in ("s", "u", "a") else "-", forced, truncated
        if key not in self.moves:
            self.moves[key] = _moves(*key)
        cost: list[int | None] = [None] * 4
        best: list[tuple[Node, str] | None] = [None] * 4
        for state, moves in enumerate(self.moves[key]):
            if self.node[state] is None:
                continue
            for code, paid, target in moves:
                total = self.cost[state] + paid
                if cost[target] is None or total < cost[target] or total == cost[target] and _first(self.node[state], code, *best[target]):
                    cost[target], best[target] = total, (self.node[state], code)
        for state in range(4):
            if cost[state] is not None and any(cost[t] is not None and cost[t] + BRIDGE[t][state] < cost[state] for t in range(4)):
                best[state] = None
        self.base += DELETE * (copies - 1)
        self._replace(cost, best, row)
        return self._decided()

    def _replace(self, cost: list, best: list, row) -> None:
        before, self.node, self.cost = self.node, [None] * 4, [None] * 4
        for state, way in enumerate(best):
            if way is not None:
                node = Node(way[0], way[1], row)
                way[0].refs += 1
                node.refs = 1
                self.node[state], self.cost[state] = node, cost[state]
        for node in before:
            while node is not None:
                node.refs -= 1
                if node.refs or node is self.root:
                    break
                node = node.parent

    def _path(self, state: int) -> list[Node]:
        """Undecided nodes on the way to a state, first row first."""
        path, node = [], self.node[state]
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _decided(self) -> list[tuple[object, str]]:
        if self.root.refs != 1:
            return []
        out = []
        for node in self._path(next(s for s in range(4) if self.node[s] is not None)):
            if self.root.refs != 1:
                break
            out.append((node.row, node.code))
            node.parent, self.root = None, node
        return out

    def ranks(self) -> list[int]:
        """Place of each state's path in ASCII order, -1 where there is none."""
        live = [s for s in range(4) if self.node[s] is not None]
        live.sort(key=cmp_to_key(lambda a, b: -1 if _first(self.node[a], "", self.node[b], "") else 1))
        return [live.index(s) if s in live else -1 for s in range(4)]

    def costs(self) -> list[int]:
        return [-1 if c is None else c + self.base for c in self.cost]

    def end(self) -> int:
        """The state to end in: cheapest with its closing inserts, then first in ASCII order."""
        ranks = self.ranks()
        return min((s for s in range(4) if ranks[s] >= 0), key=lambda s: (self.cost[s] + INSERT * len(CLOSING[s]), ranks[s]))

    def finish(self, state: int) -> list[tuple[object, str]]:
        return [(n.row, n.code) for n in self._path(state)]


def damage(conversations: DataFrame) -> DataFrame:
    """The damage of the contract by ``crc32(conv_id:turn) % 20``; ``copies`` says how often a row occurs."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    lot = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select("conv_id", "turn", "role", "text", lot.alias("lot")).where("lot <> 0").select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("lot") == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Identical rows as one with the sum of their ``copies``, and ``fault``: what is wrong with the first of them."""
    digest = F.md5("text")
    grouped = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", digest)
    # Texts that one role says in several turns; the first of them is no duplicate.
    said = rows.groupBy(F.col("conv_id").alias("said_in"), F.col("role").alias("said_by"), digest.alias("said")).agg(
        F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("NOT first <=> last").drop("last")
    same = F.col("conv_id").eqNullSafe(F.col("said_in")) & (F.col("role") == F.col("said_by")) & (F.col("digest") == F.col("said"))
    repeated = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(repeated, "duplicate")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))
    return grouped.join(said, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def pieces(rows: DataFrame) -> DataFrame:
    """Rows in order, stored with the number of their ``piece`` and their ``place``; a piece is a range of all rows."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return durable(ranged.withColumns({"piece": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))


def _in_order(df: DataFrame) -> DataFrame:
    """Whole pieces per task, rows in order."""
    return df.repartitionByRange("piece").sortWithinPartitions("piece", "place")


def _runs(batches, names: list[str]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _tables(rows: Iterator[dict], schema, size: int = 1000) -> Iterator:
    """Arrow batches of at most ``size`` rows and about four megabytes of text."""
    import pyarrow as pa

    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += row.pop("_weight", 0)
        if len(held) >= size or weight >= 4 * BLOCK_BYTES:
            yield from pa.Table.from_pylist(held, schema=schema).to_batches()
            held, weight = [], 0
    if held:
        yield from pa.Table.from_pylist(held, schema=schema).to_batches()


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def borders(stored: DataFrame) -> dict[tuple, tuple[int, int | None]]:
    """``(conversation, piece)`` to the states before and after, for conversations that span pieces; None: its end."""
    ends = stored.groupBy("piece").agg(F.min(F.struct("conv_id")).alias("low"), F.max(F.struct("conv_id")).alias("high")).collect()
    seen: dict = {}
    for r in ends:
        for c in {r.low.conv_id, r.high.conv_id}:
            seen[c] = seen.get(c, 0) + 1
    spanning = [c for c, n in seen.items() if n > 1]
    if not spanning:
        return {}
    hit = F.col("conv_id").isin([c for c in spanning if c is not None])
    part = stored.where(hit | F.col("conv_id").isNull() if None in spanning else hit)
    schema = T.StructType([stored.schema["conv_id"], T.StructField("piece", T.IntegerType()),
                           T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.LongType()))])
    arrow = _arrow(schema)

    def solve(batches):
        def found():
            key, ways = None, []
            for conv, piece, role, copies, fault in _runs(batches, ["conv_id", "piece", "role", "copies", "fault"]):
                if key != (conv, piece):
                    if key is not None:
                        yield summed(key, ways)
                    key, ways = (conv, piece), [Survivors(s) for s in range(4)]
                for way in ways:
                    way.push(None, role[:1], fault in ("blank", "duplicate"), fault == "truncated", copies)
            if key is not None:
                yield summed(key, ways)

        def summed(key, ways):
            return {"conv_id": key[0], "piece": key[1], "costs": [c for w in ways for c in w.costs()], "ranks": [r for w in ways for r in w.ranks()]}

        yield from _tables(found(), arrow)

    by: dict = {}
    for r in _in_order(part.select("conv_id", "piece", "place", "role", "copies", "fault")).mapInArrow(solve, schema).collect():
        by.setdefault(r.conv_id, []).append((r.piece, r.costs, r.ranks))
    out = {}
    for conv, links in by.items():
        links.sort(key=lambda x: x[0])
        rest = [[INSERT * len(c) for c in CLOSING]]  # cheapest cost from each state to the end, last piece first
        for _, costs, _ in reversed(links):
            rest.append([min((costs[4 * s + t] + rest[-1][t] for t in range(4) if costs[4 * s + t] >= 0 and rest[-1][t] is not None), default=None) for s in range(4)])
        rest.reverse()
        state = START
        for i, (piece, costs, ranks) in enumerate(links):
            open_ = [t for t in range(4) if costs[4 * state + t] >= 0 and rest[i + 1][t] is not None and costs[4 * state + t] + rest[i + 1][t] == rest[i][state]]
            after = min(open_, key=lambda t: ranks[4 * state + t])
            out[conv, piece] = (state, after, i == len(links) - 1)
            state = after
    return out


def repair(rows: DataFrame) -> DataFrame:
    """Every distinct row of ``conv_id, turn, role, text, copies`` in order, with its fault, edits and what replaces it.

    ``edits`` are the letters of the row's first copy and of inserts before it, ``closing`` those of inserts after the
    conversation's last row; further copies are deleted.  ``repaired`` lists the roles and texts that stand there now.
    ``piece`` and ``place`` give the order of rows; ``spans`` says that the conversation has rows in other pieces.
    """
    small_batches(rows.sparkSession)
    stored = pieces(faults(rows))
    states = stored.sparkSession.sparkContext.broadcast(borders(stored))
    line = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([stored.schema["conv_id"], stored.schema["turn"], T.StructField("piece", T.IntegerType()), T.StructField("place", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("fault", T.StringType()),
                           T.StructField("edits", T.StringType()), T.StructField("closing", T.StringType()), T.StructField("cost", T.LongType()),
                           T.StructField("spans", T.BooleanType()), T.StructField("repaired", T.ArrayType(line))])
    names, arrow = ["conv_id", "turn", "piece", "place", "role", "text", "copies", "fault"], _arrow(schema)

    def decode(batches):
        class Output:
            """Rows of one conversation's piece as they are decided; knows the role of each insert from the state."""

            def __init__(self, key) -> None:
                self.key = key
                self.entry, self.exit, self.last = states.value.get(key, (START, None, True))
                self.state, self.ways, self.held = self.entry, Survivors(self.entry), None

            def written(self, decided, closing: str = ""):
                """All decided rows but the latest, which waits in case that inserts follow it."""
                for row, code in decided:
                    if self.held is not None:
                        yield self.held
                    conv, turn, piece, place, role, text, copies, fault = row
                    lines, cost = [], DELETE * (copies - 1)
                    for letter in code:
                        if letter == "D":
                            cost += DELETE
                            continue
                        role_now, text_now = role, text
                        if letter == "K":
                            self.state = _after(self.state, role[:1])
                            cost += KEEP
                        else:
                            self.state = NEXT[self.state]
                            role_now, cost = ROLES[self.state], cost + (INSERT if letter == "I" else REROLE)
                            text_now = "" if letter == "I" else text
                        if letter != "I" and fault == "truncated":
                            cost += TRUNCATED
                        lines.append({"role": role_now, "text": text_now})
                    self.held = {"conv_id": conv, "turn": turn, "piece": piece, "place": place, "role": role, "copies": copies, "fault": fault,
                                 "edits": code, "closing": "", "cost": cost, "spans": self.exit is not None, "repaired": lines, "_weight": len(text)}

            def finish(self):
                yield from self.written(self.ways.finish(self.ways.end() if self.exit is None else self.exit))
                if self.last:
                    for letter in CLOSING[self.state]:
                        self.state = NEXT[self.state]
                        self.held["closing"] += letter
                        self.held["cost"] += INSERT
                        self.held["repaired"].append({"role": ROLES[self.state], "text": ""})
                yield self.held

        def found():
            now = None
            for row in _runs(batches, names):
                if now is None or now.key != (row[0], row[2]):
                    if now is not None:
                        yield from now.finish()
                    now = Output((row[0], row[2]))
                yield from now.written(now.ways.push(row, row[4][:1], row[7] in ("blank", "duplicate"), row[7] == "truncated", row[6]))
            if now is not None:
                yield from now.finish()

        yield from _tables(found(), arrow)

    return _in_order(stored).mapInArrow(decode, schema)


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = ("su", "ua", "au")


def digest(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """The contract's row for every ``conv_id`` of ``ids``: counts, cost, audit and the hash of the repaired rows."""
    id_field, turn_type = repaired.schema["conv_id"], repaired.schema["turn"].dataType
    long = T.LongType()
    block = T.StructType([id_field, T.StructField("at", long), *[T.StructField(n, long) for n in SUMS], T.StructField("turns", long),
                          T.StructField("low", turn_type), T.StructField("high", turn_type), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
                          T.StructField("audit", T.StringType()), T.StructField("lines", T.BinaryType()), T.StructField("sha", T.StringType())])
    whole = T.StructType([id_field, T.StructField("gaps", long), *[T.StructField(n, long) for n in SUMS],
                          T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    names = ["conv_id", "piece", "place", "turn", "role", "copies", "fault", "edits", "closing", "cost", "spans", "repaired"]
    of_block, of_whole = _arrow(block), _arrow(whole)

    def blocks(batches):
        import hashlib

        def found():
            now = key = sha = None
            for conv, piece, place, turn, role, copies, fault, edits, closing, cost, spans, lines in _runs(batches, names):
                if now is not None and not spans and key == (conv, piece) and len(now["lines"]) >= BLOCK_BYTES:
                    hashed(now, sha)
                if now is None or key != (conv, piece) or spans and len(now["lines"]) + len(now["audit"]) >= BLOCK_BYTES:
                    if now is not None:
                        yield packed(now, sha)
                    key, sha = (conv, piece), None if spans else hashlib.sha256()
                    now = {"conv_id": conv, "at": place, **dict.fromkeys(SUMS, 0), "turns": 0, "low": None, "high": None, "first": role[:1], "last": None,
                           "audit": bytearray(), "lines": bytearray()}
                if now["last"] is not None:
                    now["illegal"] += now["last"] + role[:1] not in LEGAL
                now["illegal"] += copies - 1
                now["last"] = role[:1]
                if turn is not None:
                    now["turns"] += now["high"] is None or now["high"] != turn
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                if fault == "blank":
                    now["blank"] += copies
                else:
                    now["duplicate"] += copies - (fault != "duplicate")
                    now["truncated"] += fault == "truncated"
                now["cost"] += cost
                now["audit"] += (edits + "D" * (copies - 1) + closing).encode()
                for line in lines:
                    now["lines"] += f"{line['role']}:{line['text']}\n".encode()
            if now is not None:
                yield packed(now, sha)

        def hashed(now, sha) -> None:
            """A newline stands between lines, so the last one waits for the next block."""
            sha.update(now["lines"][:-1])
            now["lines"] = now["lines"][-1:]

        def packed(now, sha):
            done = None
            if sha is not None:  # nothing of this conversation is elsewhere, its lines need not travel
                hashed(now, sha)
                done, now["lines"] = sha.hexdigest(), b""
            return {**now, "audit": now["audit"].decode(), "lines": bytes(now["lines"]), "sha": done, "_weight": len(now["lines"])}

        yield from _tables(found(), of_block)

    def merged(batches):
        import hashlib

        fields = [f.name for f in block]

        def found():
            now, key = None, object()
            for row in _runs(batches, fields):
                b = dict(zip(fields, row))
                if now is None or key != b["conv_id"]:
                    if now is not None:
                        yield done(now)
                    key = b["conv_id"]
                    now = {**b, "audit": [], "done": b["sha"], "hash": hashlib.sha256(), "begun": False}
                else:
                    for n in SUMS:
                        now[n] += b[n]
                    now["illegal"] += now["last"] + b["first"] not in LEGAL
                    if b["low"] is not None:
                        now["turns"] += b["turns"] - (now["high"] == b["low"])
                        now["low"], now["high"] = b["low"] if now["low"] is None else now["low"], b["high"]
                    now["last"] = b["last"]
                now["audit"].append(b["audit"])
                if b["lines"]:  # lines are joined by a newline, the last one has none
                    now["hash"].update((b"\n" if now["begun"] else b"") + b["lines"][:-1])
                    now["begun"] = True
            if now is not None:
                yield done(now)

        def done(now):
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return {"conv_id": now["conv_id"], "gaps": gaps, **{n: now[n] for n in SUMS}, "audit": "".join(now["audit"]), "repaired_sha256": now["done"] or now["hash"].hexdigest()}

        yield from _tables(found(), of_whole)

    summed = repaired.mapInArrow(blocks, block).repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(merged, whole)
    every = ids.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(summed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(f.name, nothing.get(f.name, F.lit(0))).alias(f.name) for f in whole if f.name != "conv_id"])
