"""Hashed character n-grams of whole texts, as dense counts."""

from __future__ import annotations

import numpy as np

#: Multipliers for combining up to three code points (fixed values).
FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
CHUNK = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each hashed n-gram occurs; long texts are counted piece by piece in constant memory."""
    counts = np.zeros(1 << bits, np.int64)
    for n in orders:
        for start in range(0, max(len(codes) - n + 1, 0), CHUNK):
            part = codes[start:start + CHUNK + n - 1]
            m = len(part) - n + 1
            h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ part[j:j + m]) * np.uint32(FACTORS[j])
                h ^= h >> np.uint32(15)
            counts += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


def _classes() -> np.ndarray:
    """Code point to shape: letters by case, digits and blanks by class, all else itself."""
    import unicodedata

    table = np.arange(0x3000, dtype=np.uint32)
    for c in range(len(table)):
        kind = unicodedata.category(chr(c))
        if kind == "Lu":
            table[c] = ord("A")
        elif kind[0] in "LM":
            table[c] = ord("a")
        elif kind[0] == "N":
            table[c] = ord("0")
        elif kind == "Zs":
            table[c] = ord(" ")
    return table


class Shapes:
    """Counts of the 1- to 3-grams of a text's shape and of words that repeat the one before."""

    def __init__(self, bits: int = 11) -> None:
        self.bits, self.table = bits, _classes()
        self.width = (1 << bits) + 1

    def counts(self, text: str) -> np.ndarray:
        codes = code_points(text)
        shape = np.where(codes < len(self.table), self.table[np.minimum(codes, len(self.table) - 1)], ord("a")).astype(np.uint32)
        words = text.split()
        again = sum(map(str.__eq__, words, words[1:]))
        return np.append(gram_counts(shape, (1, 2, 3), self.bits), again)
