"""License notices inside documents, by patience alignment with known templates.

Words are compared without case and outer punctuation.  Pairs of neighbouring template words that occur in a
document propose places where the template would start; places close to each other are one candidate window.  In a
window, words that are unique to it and to the template are matched, the longest increasing subsequence of
those matches gives the anchors, equal words right before and after an anchor are matched as well, and
the gaps between anchors are aligned the same way.  The share of template words that are matched is the coverage.

Whatever the coverage, the phrases that name the license and its version (``licenses.NAMES``) have to be matched word
by word, with nothing between them but marks and single characters, as at the start of a line of a comment.  Short
sentences like "under the <name>", in the usual spellings, and SPDX identifiers are looked up as they are, and count
where no template of that license is found; a name without a version counts where there is none with a version.

Every document is scanned whole, by itself, so nothing is shuffled.

Edge cases: null and empty texts hold no notice; rows without a ``doc_id`` are left out; repeated rows are
scanned each; a notice that occurs several times is reported at each place; of overlapping places of one template
the one with more coverage counts, then the earlier one.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablescout.llm.licenses import IDENTIFIERS, LEADS, NAMES, OPEN, SPDX, SPELLINGS, TEMPLATES
from tablescout.llm.words import only

OUTER = string.punctuation.encode()


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(OUTER) or w for w in text.lower().split()]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first place, that also rises in the second (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        tops[pile:pile + 1] = [b]
        piles[pile:pile + 1] = [i]
        back.append(piles[pile - 1] if pile else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two word lists, rising in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        many_a, many_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if many_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if many_a[w] == 1 and w in place])
        if anchors:
            matched += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(matched)


def filler(word: bytes) -> bool:
    """Marks and single characters, which may stand within a name."""
    return len(word) == 1 or not word.strip(OUTER)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str], coverage: float, names: dict[str, list[str]] | None = None,
                 spellings: dict[str, str] | None = None, identifiers: dict[str, str] | None = None) -> None:
        self.coverage = coverage
        self.templates = {name: words_of(t.encode()) for name, t in templates.items()}
        self.pairs: dict[tuple[bytes, bytes], list[tuple[str, int]]] = {}
        for name, t in self.templates.items():
            for j, pair in enumerate(zip(t, t[1:])):
                self.pairs.setdefault(pair, []).append((name, j))
        self.first = {p[0] for p in self.pairs}
        # Template places of every naming phrase, and the words that a document needs for the template.
        self.names: dict[str, list[range]] = {}
        for name, phrases in (names or {}).items():
            t = self.templates[name]
            for phrase in (words_of(p.encode()) for p in phrases):
                at = next(j for j in range(len(t)) if t[j:j + len(phrase)] == phrase)
                self.names.setdefault(name, []).append(range(at, at + len(phrase)))
        self.needs = {name: {t[j] for r in self.names.get(name, ()) for j in r} for name, t in self.templates.items()}
        clean = lambda text: tuple(w for w in words_of(text.encode()) if w.strip(OUTER))
        lead, ids = [clean(x) for x in LEADS], {clean(x): n for x, n in (identifiers or {}).items()}
        self.spelled = {x + clean(a): n for a, n in (spellings or {}).items() for x in lead} | {clean(SPDX) + x: n for x, n in ids.items()}
        self.starts = {x[0] for x in self.spelled}
        self.prefixes = {x[:n] for x in self.spelled for n in range(1, len(x) + 1)}

    def windows(self, words: list[bytes]) -> Iterator[tuple[str, int, int]]:
        """Template and word range of every candidate window."""
        have = set(words)
        possible = {name for name, need in self.needs.items() if need <= have}
        starts: dict[str, list[int]] = {}
        for i, w in enumerate(words[:-1] if possible else ()):
            if w in self.first:
                for name, j in self.pairs.get((w, words[i + 1]), ()):
                    if name in possible:
                        starts.setdefault(name, []).append(i - j)
        for name, places in starts.items():
            size = len(self.templates[name])
            slack = max(size // 4, 2)
            places = sorted(set(places))
            group = [places[0]]
            for p in [*places[1:], None]:
                if p is not None and p - group[-1] <= slack and p - group[0] <= size:
                    group.append(p)
                    continue
                yield name, max(group[0] - slack, 0), min(group[-1] + size + slack, len(words))
                group = [p]

    def named(self, name: str, words: list[bytes], matched: list[tuple[int, int]]) -> bool:
        """Whether the naming phrases are matched whole and in one piece."""
        place = {j: i for i, j in matched}
        return all(all(j in place for j in r) and all(filler(w) for j in r[1:] for w in words[place[j - 1] + 1:place[j]])
                   for r in self.names.get(name, ()))

    def spellings(self, words: list[bytes]) -> Iterator[tuple[str, int, int, int, float]]:
        """The longest spelled name at each place."""
        for i, w in enumerate(words):
            if w in self.starts:
                key, best = (), None
                for k in range(i, len(words)):
                    if words[k].strip(OUTER):
                        key += (words[k],)
                        if key not in self.prefixes:
                            break
                        if key in self.spelled:
                            best = (self.spelled[key], i, k + 1, len(key), 1.0)
                if best:
                    yield best

    def notices(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """License, first word, word after the last, matched words and coverage of every notice."""
        words = words_of(text)
        found = []
        for name, a, b in self.windows(words):
            template = self.templates[name]
            matched = align(words[a:b], template)
            share = len(matched) / len(template)
            if share >= self.coverage and self.named(name, words[a:b], matched):
                found.append((name.split("~")[0], a + matched[0][0], a + matched[-1][0] + 1, len(matched), share))
        out: list[tuple] = []
        spelled = list(self.spellings(words)) if self.spelled else []
        for f in [*sorted(found, key=lambda f: (f[0], -f[4], f[1], f[2])), *sorted(spelled)]:
            if all(f[0] != g[0] or f[2] <= g[1] or f[1] >= g[2] for g in out):
                out.append(f)
        if self.spelled:
            out = [f for f in out if f[0] not in OPEN or all(not g[0].startswith(f[0] + "-") or f[2] <= g[1] or f[1] >= g[2] for g in out)]
        return sorted(out, key=lambda f: (f[1], f[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """``doc_id, license, start_word, end_word, matched, coverage`` of every notice."""
    import numpy as np

    chosen = (TEMPLATES, coverage, NAMES, SPELLINGS, IDENTIFIERS) if templates is None else (templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*chosen)
        for batch in batches:
            rows = [(d, *n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for n in scanner.notices(t.encode())]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(columns[0], np.int64)), pa.array(columns[1], pa.string()), *[pa.array(c, pa.int64()) for c in columns[2:5]],
                 pa.array(columns[5], pa.float64())], ["doc_id", "license", "start_word", "end_word", "matched", "coverage"])

    return only(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, license string, start_word long, end_word long, matched long, coverage double")
