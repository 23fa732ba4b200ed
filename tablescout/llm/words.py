"""Words, word hashes and small helpers that the operators of this package share.

A word is a maximal run of characters outside ``0x20`` and ``0x09``-``0x0D``; on UTF-8 bytes that is exactly
what ``bytes.split()`` returns.  Words are hashed to 64 bits once per task and n-grams are combined from
those hashes with numpy, so nothing here walks over characters in Python.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, for expressions that stay in the JVM.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd 64-bit multipliers for combining hashes (fixed values).
GOLDEN = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


class WordHashes(dict):
    """64-bit hash of each distinct word; forgets all when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class TextHashes:
    """64-bit hashes of all words of a column of texts, A-Z lower-cased, without a Python object per word.

    A word is a polynomial over scrambled bytes: the difference of two running sums, shifted to the word's start.  Sums run
    over slices of ``SLICE`` bytes, so memory beyond the texts is a few bytes a byte; long words are hashed one by one.
    """

    SLICE = 1 << 16
    LONG = 64

    def __init__(self) -> None:
        codes = np.arange(256, dtype=np.uint64)
        codes[65:91] += np.uint64(32)
        self.letters = mix((codes + np.uint64(1)) * np.uint64(GOLDEN))
        self.blank = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
        self.up, self.down = np.full(self.SLICE, MIX_B, np.uint64), np.full(self.SLICE, pow(MIX_B, -1, 1 << 64), np.uint64)
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def of(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of an Arrow string column, and how many of them each text has; a null has none."""
        import pyarrow as pa

        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        inside = ~self.blank[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        some = edges[:-1] < edges[1:]
        first[edges[:-1][some]] = inside[edges[:-1][some]]
        last[edges[1:][some] - 1] = inside[edges[1:][some] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            base = start[i]
            j = int(np.searchsorted(end, base + self.SLICE, "right"))
            if j > i:
                size = end[j - 1] - base
                sums = np.zeros(size + 1, np.uint64)
                np.cumsum(self.letters[data[base:base + size]] * self.up[:size], out=sums[1:])
                a, b = start[i:j] - base, end[i:j] - base
                out[i:j] = mix((sums[b] - sums[a]) * self.down[a])
            i = max(j, i + 1)
        for i in np.flatnonzero(end - start >= self.LONG):
            out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes().lower())
        return out, np.diff(np.searchsorted(start, edges))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int, seed: int = GOLDEN) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    step = np.uint64(seed | 1)
    for j in range(n):
        out = out * step + h[j:j + m]
    return mix(out)


def shingle_set(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle, no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    grams = gram_hashes(h, n) if len(h) >= n else gram_hashes(h, len(h), GOLDEN ^ (len(h) << 1))
    return np.unique(grams)


def raw(texts) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives an empty text."""
    import pyarrow as pa

    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def fold(column: str, parts: int) -> Column:
    """Remainder of the crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about 4 MB in this session, because documents are long."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the rows that have an id, which is the first of them.

    Further columns, whatever their names, are left behind here, so none can clash with those of an operator.
    """
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).where(F.col(f"`{columns[0]}`").isNotNull())


def one_row_per_id(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that repeat an id are one document; where their texts differ the smallest one counts."""
    key = df.columns[0]
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return df
    return df.groupBy(key).agg(F.min(text).alias(text))


def long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's signed longs."""
    return x.view(np.int64)
