"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton gives all vocabulary pieces that end at each character; dynamic programming carries the best
score and the number of pieces to there. As in the tokenizer, a path only gives way to one with a greater score, so of
equals the piece that starts first wins; a character without a piece of its own costs the unknown score and counts as its
UTF-8 bytes. No piece goes on after a word, so a text falls into segments at its spaces and line ends, whose results add up
and are kept for when they come again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import Kept, blocks

SPACE = "▁"
CACHE, CORE = 300_000, 240_000
_PENALTY = 10.0


class UnigramCounter:
    """pieces: (piece, score) of the vocabulary; its byte pieces make unknown characters count as bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - _PENALTY
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in pieces):
            raise ValueError("a piece goes on after a space or line end")
        self.numbers: dict[str, int] = {}
        self.counts, self.scores = np.zeros(1 << 16, np.int64), np.zeros(1 << 16)

    def segment(self, text: str) -> tuple[int, float]:
        """Pieces and score of one segment, spaces already replaced."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for k in range(n):
            best, pieces = None, 0
            for length, own in sorted(ends[k], reverse=True):  # the longest starts first
                value = score[k + 1 - length] + own
                if best is None or value > best:
                    best, pieces = value, count[k + 1 - length] + 1
            if text[k] not in self.single:
                value = score[k] + self.unknown
                if best is None or value > best:
                    best, pieces = value, count[k] + len(text[k].encode("utf-8", "surrogatepass"))
            score[k + 1], count[k + 1] = best, pieces
        return count[n], score[n]

    def _number(self, key: str) -> int:
        n = len(self.numbers)
        if n >= len(self.counts):
            self.counts, self.scores = (np.concatenate((x, np.zeros_like(x))) for x in (self.counts, self.scores))
        self.counts[n], self.scores[n] = self.segment(key)
        self.numbers[key] = n
        return n

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of whole texts, a space put before each that does not start with one."""
        if len(self.numbers) > CACHE:
            self.numbers = dict(islice(self.numbers.items(), CORE))
        lists = [segments(t) if t else [] for t in texts]
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=first[1:])
        known, number = self.numbers, self._number
        which = np.fromiter((known[x] if x in known else number(x) for x in chain.from_iterable(lists)), np.int64, int(first[-1]))
        totals = []
        for values in (self.counts, self.scores):
            run = np.zeros(len(which) + 1, values.dtype)
            np.cumsum(values[which], out=run[1:])
            totals.append(run[first[1:]] - run[first[:-1]])
        return totals[0], totals[1]


def segments(text: str) -> list[str]:
    """Cut before each run of spaces and around each line end; joined again they are the text with its spaces replaced."""
    text = text.replace(" ", SPACE)
    if not text.startswith(SPACE):
        text = SPACE + text
    out = []
    for line in text.split("\n"):
        parts = line.split(SPACE)
        if parts[0]:
            out.append(parts[0])
        run = 0
        for p in parts[1:]:
            run += 1
            if p:
                out.append(SPACE * run + p)
                run = 0
        if run:
            out.append(SPACE * run)
        out.append("\n")
    out.pop()
    return out


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces and scores in a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.vocab_size())]


_counters = Kept(lambda path: UnigramCounter(pieces_of(path)))


def _kept() -> Kept:
    """The worker's own; a task would otherwise carry the driver's."""
    return _counters


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, score; one row per row.

    path: a sentencepiece model, whose pieces and scores are taken as a unigram vocabulary. Null and empty texts have no
    tokens and score 0. Texts of any length are whole; ties are decided as stated above. Repeated rows count once each.
    Extra columns are not read; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _kept().use(path) as counter:
            for b in blocks(batches):
                n, score = counter.count(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
