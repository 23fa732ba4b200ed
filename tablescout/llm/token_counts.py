"""Token counts under a unigram vocabulary, by a Viterbi pass that carries only score and count.

Blanks become the word-start mark and a text starts with one.  The best path is that over the whole text; it is found segment by
segment, where a run of marks and what follows it up to the next mark is a segment, because no piece reaches from one
into the next (a vocabulary with such a piece, or without the mark itself, takes a text as one segment).  In a segment an Aho-Corasick automaton finds all vocabulary pieces; per position
the best score from the left and the number of tokens on that path are kept, never the path.  A candidate
replaces the best one only if its score is strictly higher, and candidates come in order of their start, so of
equal scores the longest last piece wins.  A character that is no piece costs ten less than the lowest
score; it counts as its UTF-8 bytes if the vocabulary holds all 256 byte pieces, else neighbouring ones count once.
Control, unknown and byte pieces stand for no text: where a text happens to spell one, it is read as ordinary characters.

Segments repeat, so each task keeps the result of the segments it has seen (bounded in number and length).

Edge cases: null and empty texts have no tokens and score 0; rows without a ``doc_id`` are left out; repeated rows are
counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablescout.llm.words import only

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
BYTE_PIECE = re.compile("<0x[0-9A-F]{2}>")
#: How much less than the lowest score an unknown character costs (fixed value).
PENALTY = 10.0


class UnigramCounter:
    """Counts tokens of texts for a vocabulary of (piece, score); pieces in ``special`` never match text."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 300_000, special: frozenset[str] = frozenset()) -> None:
        import ahocorasick

        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        texts = {p: s for p, s in pieces if p and p not in special and not (self.bytes and BYTE_PIECE.fullmatch(p))}
        self.automaton = ahocorasick.Automaton()
        for piece, score in texts.items():
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.cut = MARK in texts and not any(re.search(f"[^{MARK}]{MARK}", p) for p in texts)
        self.limit, self.cache = limit, {}

    def segment(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path."""
        n = len(text)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            matches[end].append(match)
        for end in range(1, n + 1):
            top = None
            single = False
            # Longest first, that is in order of their start.
            for length, score in sorted(matches[end - 1], reverse=True):
                single |= length == 1
                value = best[end - length] + score
                if top is None or value > top:
                    top, tokens, run = value, count[end - length] + 1, False
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    step = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not open_run[end - 1])
                    top, tokens, run = value, count[end - 1] + step, True
            best[end], count[end], open_run[end] = top, tokens, run
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Tokens of a whole text, and the summed scores of the best paths."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        if len(self.cache) > self.limit:
            self.cache.clear()
        tokens, score = 0, 0.0
        for s in SEGMENT.findall(marked) if self.cut else [marked]:
            known = self.cache.get(s)
            if known is None:
                known = self.segment(s)
                if len(s) < 64:
                    self.cache[s] = known
            tokens += known[0]
            score += known[1]
        return tokens, score


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())]


def special_pieces(model_file: str) -> frozenset[str]:
    """Pieces of a SentencePiece model that stand for no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return frozenset(m.id_to_piece(i) for i in range(m.vocab_size()) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary(model_file), special=special_pieces(model_file))
        for batch in batches:
            out = [counter.text(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())],
                                             ["doc_id", "n_tokens", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
