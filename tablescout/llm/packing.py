"""Packing of documents into training sequences along a space-filling curve.

Every document is tokenised once; its hashed token counts are projected to a few dimensions by fixed random
directions, and the place of that point on a Hilbert curve is its key.  Documents are range-sorted by key,
their token positions in that order are running totals (per range partition, plus the totals of the partitions
before, of which there is one number each), and the stream is cut every ``length`` tokens.  What remains at the
end is cut into powers of two, which need no padding, so nothing is padded at all, and neighbours on the curve
share sequences.

Tokens are stored once; only row numbers, keys and lengths are sorted.

Edge cases: a null or empty text is the end token alone; rows that repeat a ``doc_id`` are packed each; rows
without one are left out; equal keys are ordered by ``doc_id``; a text longer than a sequence is cut over
several; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.words import mix, only
from tablescout.session import durable

LENGTH = 4096
END = 2
DIMENSIONS, BITS, HASHED = 4, 12, 512


class Pieces(dict):
    """The ids of each distinct piece of text; forgets all when it holds ``limit`` of them."""

    def __init__(self, encode: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        value = self.encode(piece)
        if len(piece) < 64:
            self[piece] = value
        return value

    def joined(self, pieces: list[str]) -> bytes:
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, pieces))


class Tokens:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``, as numbers of type ``kind``.

    A text of plain Latin characters is cut by the tokenizer's own pattern and each distinct piece is encoded
    once per task; any other text, or one that holds a special token, goes through the tokenizer whole.
    """

    #: Code points for which lower-casing and the classes of the pattern are the same in all libraries.
    PLAIN = [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x17F)]

    def __init__(self, path: str, limit: int = 1_000_000, kind: str = "<u4") -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.kind, self.cuts = Tokenizer.from_file(path), kind, None
        self.pieces = Pieces(self._piece, limit)
        spec = json.loads(self.whole.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = [chr(c) for c in self.PLAIN]
        self.odd = re.compile(f"[^{re.escape(''.join(plain))}]")
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [t["type"] for t in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            # The classes of the pattern, written out for the plain characters.
            pattern = steps[0]["pattern"]["Regex"].replace(r"\s", re.escape("".join(c for c in plain if c.isspace())))
            for name in "LN":
                pattern = pattern.replace(rf"\p{{{name}}}", re.escape("".join(c for c in plain if unicodedata.category(c)[0] == name)))
            self.cuts = re.compile(pattern)
            step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes = {ord(c): step.pre_tokenize_str(c)[0][0] for c in plain if not c.isspace()}

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.whole.model.tokenize(piece.translate(self.bytes))], self.kind).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids, one after another."""
        if self.cuts is None or self.odd.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return self.pieces.joined(self.cuts.findall(text.lower()))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points with ``bits`` bits per coordinate (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions() -> np.ndarray:
    return np.random.default_rng(5).standard_normal((HASHED, DIMENSIONS))


def slots(size: int) -> np.ndarray:
    """The hashed feature of every id."""
    return (mix(np.arange(size, dtype=np.uint64)) >> np.uint64(40)).astype(np.int64) % HASHED


def place(ids: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Hashed token counts of a document, of length one."""
    v = np.log1p(np.bincount(slot[ids], minlength=HASHED))
    return v / max(np.linalg.norm(v), 1e-12)


def keys(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Hilbert keys; coordinates are spread evenly over the grid as if they were normal."""
    z = (vectors - HASHED ** -0.5) @ basis * 1.5
    grid = (1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(grid, 0, (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``row, doc_id, key, n, ids``: curve key, number of ids with the end token, and the ids."""
    size = vocabulary_size(path, end)
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, basis, slot = Tokens(path, kind=kind), directions(), slots(size)
        last = np.array([end], kind).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [tokens.ids(t or "") + last for t in part.column(1).to_pylist()]
                vectors = np.array([place(np.frombuffer(b, kind), slot) for b in ids])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys(vectors, basis)), pa.array([len(b) // len(last) for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "key", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def vocabulary_size(path: str, end: int) -> int:
    from tokenizers import Tokenizer

    return max(*Tokenizer.from_file(path).get_vocab().values(), end) + 1


def id_type(size: int) -> str:
    """The smallest number type that holds all ids below ``size``."""
    return "<u2" if size <= 65536 else "<u4"


def positions(stored: DataFrame, partitions: int) -> tuple[DataFrame, int]:
    """``row, at``: where in the stream each document begins, and the length of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            local = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(local)],
                                             ["row", "n", "part", "local"])

    ordered = stored.select("row", "n", "key", "doc_id").repartitionByRange(partitions, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    local = durable(ordered.select("row", "n").mapInArrow(run, "row long, n long, part int, local long"))
    # One total per range partition reaches the driver.
    totals = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    begin = stored.sparkSession.createDataFrame(starts, "part int, begin long")
    return local.join(F.broadcast(begin), "part").select("row", (F.col("begin") + F.col("local")).alias("at")), total


def borders(at: int, n: int, total: int, length: int) -> list[int]:
    """Where a document that begins at ``at`` is cut: its own ends and the sequence borders between."""
    full = total // length * length
    cuts = {at, at + n}
    cuts.update(range(-(-at // length) * length, min(at + n, full) + 1, length))
    edge, rest = full, total - full
    while rest:
        size = 1 << (rest.bit_length() - 1)
        edge, rest = edge + size, rest - size
        if at < edge < at + n:
            cuts.add(edge)
    return sorted(c for c in cuts if at <= c <= at + n)


def sequence_of(at: int, total: int, length: int) -> tuple[int, int]:
    """Sequence and offset of a position of the stream."""
    full = total // length * length
    if at < full:
        return at // length, at % length
    number, edge, rest = full // length, full, total - full
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < edge + size:
            return number, at - edge
        number, edge, rest = number + 1, edge + size, rest - size


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; ``with_ids`` adds the ids themselves (``array<int>``)."""
    spark = docs.sparkSession
    stored = durable(tokenised(only(docs, "doc_id", "text"), path, end))
    at, total = positions(stored, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = id_type(vocabulary_size(path, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, n, begin, blob in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(blob, kind).astype("<u4")
                edges = borders(begin, n, total, length)
                for a, b in zip(edges, edges[1:]):
                    piece = ids[a - begin:b - begin]
                    for column, value in zip(out, (doc, a - begin, b - a, zlib.crc32(piece.tobytes()), n, *sequence_of(a, total, length), piece)):
                        column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out[:7]]
            names = [f.split()[0] for f in PIECE.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array([p.astype(np.int32) for p in out[7]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = stored.select("row", "doc_id", "n", "ids").join(at, "row").select("doc_id", "n", "at", "ids")
    return rows.mapInArrow(run, PIECE + ", ids array<int>" * with_ids)
