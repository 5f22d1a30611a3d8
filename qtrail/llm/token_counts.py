"""Operator 3: token counts by a count-only Viterbi pass.

An Aho-Corasick automaton enumerates the vocabulary's matches of a text in one
scan; dynamic programming keeps for each boundary the best score and the number
of pieces on the best path, and no backpointers.  Parts that no piece spans are
independent and repeat (words), so each worker remembers theirs.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows
and null ids are counted and passed on as they are; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unigram import Vocabulary, vocabulary

#: parts a worker remembers, and the longest such part
REMEMBERED, SHORT = 400_000, 48


@functools.cache
def _automaton(path: str):
    import ahocorasick
    found = ahocorasick.Automaton()
    for piece, (score, _) in vocabulary(path).pieces.items():
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found


def best(part: str, automaton, words: Vocabulary) -> tuple[float, int]:
    """(score, number of pieces) of the best segmentation of ``part``."""
    n = len(part)
    score, count = [0.0] * (n + 1), [0] * (n + 1)
    done = 0  # boundaries up to here are final

    def close(end: int, matched: list) -> None:
        # longest match first, so that a tie keeps the earliest start
        top, pieces, single = None, 0, False
        for length, value in matched:
            start = end - length
            single |= length == 1
            if top is None or score[start] + value > top:
                top, pieces = score[start] + value, count[start] + 1
        if not single and (top is None or score[end - 1] + words.unknown_score > top):
            top, pieces = score[end - 1] + words.unknown_score, count[end - 1] + len(part[end - 1].encode())
        score[end], count[end] = top, pieces

    matched: list = []
    for last, value in automaton.iter(part):
        while done < last:
            done += 1
            close(done, matched)
            matched = []
        matched.append(value)
    while done < n:
        done += 1
        close(done, matched)
        matched = []
    return score[n], count[n]


class Counter(dict):
    """Scores and counts of remembered parts."""

    def __init__(self, path: str):
        super().__init__()
        self.words, self.automaton = vocabulary(path), _automaton(path)

    def __missing__(self, part: str) -> tuple[float, int]:
        finer = self.words.cuts(part)
        if len(finer) > 1:
            found = tuple(map(sum, zip(*map(self.__getitem__, finer))))
        else:
            found = best(part, self.automaton, self.words)
        if len(part) <= SHORT:
            self[part] = found
        return found

    def count(self, text: str) -> tuple[float, int]:
        found = list(map(self.__getitem__, self.words.parts(text)))
        if len(self) > REMEMBERED:
            self.clear()
        return sum(s for s, _ in found), sum(c for _, c in found)


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def _counted(batches, path: str):
    counter = _counter(path)  # kept over a worker's tasks
    for batch in batches:
        found = [counter.count(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([c for _, c in found], pa.int64()),
             pa.array([float(s) for s, _ in found], pa.float64())], names=["doc_id", "n_tokens", "score"])


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: one row per row of ``docs``, one pass without a shuffle."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda b: _counted(b, model), "doc_id bigint, n_tokens bigint, score double")
