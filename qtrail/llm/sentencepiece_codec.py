"""Operator 6: SentencePiece encoding and decoding by streaming Viterbi.

``StreamingViterbi`` reads a text chunk by chunk.  It keeps the best paths to the
boundaries that a later piece can still start at (a window bounded by the longest
piece) and the backpointers since the last commit; as soon as all of these paths
go through one boundary, the ids before it are final and are given out.  A text's parts that no piece spans are where that always happens;
each worker remembers the ids of the short ones (words).  ``Lattice`` takes the
same steps for all short parts that are new in a batch of texts side by side:
a boundary's best score is one array over the parts.

Defined results: null and empty texts have no ids and decode to the empty text;
a U+2581 in a text reads as a blank (as in the library), all other texts decode
to themselves; ids out of range raise; repeated rows, null ids of documents and
other columns need nothing; an empty table gives no row.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unigram import BLANK, Vocabulary, vocabulary

REMEMBERED, SHORT = 400_000, 48
CELLS = 40_000  # characters of the parts that a lattice holds at once


class StreamingViterbi:
    """Ids of a stream of prepared text.

    An automaton enumerates the pieces that end at each boundary; a boundary's best
    path is final as soon as it is reached, but which paths survive is open for
    ``longest`` boundaries, as a later piece may still start there."""

    def __init__(self, words: Vocabulary):
        import ahocorasick
        self.words = words
        self.automaton = ahocorasick.Automaton()
        for piece, (score, piece_id) in words.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, piece_id))
        self.automaton.make_automaton()

    def encode(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Yield committed ids; ``chunks`` may part the text anywhere."""
        reach = self.words.longest
        text = ""  # from the last commit on; boundaries count from there
        score, back = [0.0], [(0, None)]  # of each boundary; back: start and id of its best last piece
        for chunk in chunks:
            text += chunk
            self._advance(text, score, back)
            while len(text) >= 2 * reach:
                meet = set(range(len(text) - reach + 1, len(text) + 1))  # boundaries that a later piece can start at
                while len(meet) > 1:
                    meet.add(back[last := max(meet)][0])
                    meet.discard(last)
                boundary = meet.pop()
                if not boundary:
                    break
                yield self._ids(text, back, boundary)
                text = text[boundary:]
                kept = score[boundary]
                score = [v - kept for v in score[boundary:]]
                back = [(max(start - boundary, 0), piece_id) for start, piece_id in back[boundary:]]
        if text:
            yield self._ids(text, back, len(text))

    def _advance(self, text: str, score: list, back: list) -> None:
        """Best paths to the boundaries that are new since the last call."""
        done = len(score) - 1
        first = max(0, done - self.words.longest + 1)
        unknown = self.words.unknown_score
        matched: list = []

        def close(end: int) -> None:
            # longest piece first, so that a tie keeps the earliest start
            top, best, single = None, None, False
            for length, value, piece_id in matched:
                start = end - length
                single |= length == 1
                total = score[start] + value
                if top is None or total > top:
                    top, best = total, (start, piece_id)
            if not single and (top is None or score[end - 1] + unknown > top):
                top, best = score[end - 1] + unknown, (end - 1, None)
            score.append(top)
            back.append(best)

        for last, match in self.automaton.iter(text[first:] if first else text):
            end = first + last + 1
            if end <= done:
                continue
            while len(score) < end:
                close(len(score))
                matched.clear()
            matched.append(match)
        while len(score) <= len(text):
            close(len(score))
            matched.clear()

    def _ids(self, text: str, back: list, boundary: int) -> list[int]:
        """Ids of the best path to ``boundary``."""
        groups = []
        while boundary:
            start, piece_id = back[boundary]
            groups.append([piece_id] if piece_id is not None
                          else [self.words.byte_ids[b] for b in text[start:boundary].encode()])
            boundary = start
        return [i for group in reversed(groups) for i in group]


class Lattice:
    """Ids of many short parts: sums, order and ties of ``StreamingViterbi``, with an array
    over the parts for each boundary.  Cell ``start * parts + part`` of a block is a character."""

    def __init__(self, words: Vocabulary):
        self.words = words
        places, edges = {"": 0}, []
        letters = {c: k for k, c in enumerate(sorted(set("".join(words.pieces))), 1)}  # 0: in no piece
        for piece in words.pieces:
            for k, c in enumerate(piece, 1):
                if piece[:k] not in places:
                    edges.append((places[piece[:k - 1]], letters[c], len(places)))
                    places[piece[:k]] = len(places)
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        self.score, self.id = np.full(len(places), -np.inf), np.full(len(places), -1, np.int32)
        for piece, (score, piece_id) in words.pieces.items():
            self.score[places[piece]], self.id[places[piece]] = score, piece_id
        # the trie's edges by open addressing, at most a quarter full; key 0 (root, no letter) is free
        bits = max(4, (4 * len(edges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.array([node * self.letters + letter for node, letter, _ in edges], np.int64)
        for key, slot, (_, _, target) in zip(keys.tolist(), self._slots(keys).tolist(), edges):
            while self.keys[slot]:
                slot = (slot + 1) & self.last
            self.keys[slot], self.targets[slot] = key, target

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _follow(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node behind each node by its letter; 0 if there is none."""
        keys = nodes * np.int64(self.letters) + letters
        slots = self._slots(keys)
        at = self.keys[slots]
        found = np.where(at == keys, self.targets[slots], 0)
        rest = np.flatnonzero((at != keys) & (at != 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.last
            at = self.keys[slots[rest]]
            hit = rest[at == keys[rest]]
            found[hit] = self.targets[slots[hit]]
            rest = rest[(at != keys[rest]) & (at != 0)]
        return found

    def encode(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each part with its little-endian 32-bit ids, in any order; no part is empty."""
        parts = sorted(parts, key=len)
        while parts:
            n = max(1, CELLS // len(parts[-1]))
            block, parts = parts[-n:], parts[:-n]
            yield from zip(block, self._block(block))

    def _block(self, parts: list[str]) -> Iterator[bytes]:
        n, sizes = len(parts), np.array([len(p) for p in parts])
        longest, reach = int(sizes.max()), min(int(sizes.max()), self.words.longest)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        first = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(n), sizes)
        cell = (np.arange(len(codes)) - first[part]) * n + part
        letter = np.zeros(longest * n, np.int64)
        letter[cell] = self.letter[codes]
        # score and id of the piece of each length that starts at each cell
        value = np.full((reach + 1, longest * n), -np.inf)
        piece = np.full((reach + 1, longest * n), -1, np.int32)
        starts = np.flatnonzero(letter)
        node = self._follow(np.zeros(len(starts), np.int64), letter[starts])
        for length in range(1, reach + 1):
            starts, node = starts[node > 0], node[node > 0].astype(np.int64)
            value[length, starts], piece[length, starts] = self.score[node], self.id[node]
            inside = starts + length * n < longest * n
            starts, node = starts[inside], node[inside]
            node = self._follow(node, letter[starts + length * n])
        value[1, cell[np.isneginf(value[1, cell])]] = self.words.unknown_score
        value = value.reshape(reach + 1, longest, n)
        some = np.isfinite(value).any(axis=2)
        score, back = np.full((longest + 1, n), -np.inf), np.zeros((longest + 1, n), np.int64)
        score[0] = 0.0
        for end in range(1, longest + 1):
            # longest piece first, so that a tie keeps the earliest start
            for length in range(min(reach, end), 0, -1):
                if some[length, end - length]:
                    total = score[end - length] + value[length, end - length]
                    better = total > score[end]
                    np.copyto(score[end], total, where=better)
                    np.copyto(back[end], length, where=better)
        left, who, steps = sizes, np.arange(n), []
        while len(who):
            length = back[left, who]
            left = left - length
            steps.append((who * longest + left, piece[length, left * n + who]))
            left, who = left[left > 0], who[left > 0]
        at = np.concatenate([a for a, _ in steps])
        order = np.argsort(at)
        at, ids = at[order], np.concatenate([i for _, i in steps])[order]
        owner, count = at // longest, np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):  # characters without a piece become their bytes
            spelt = [chr(c).encode() for c in codes[first[owner[unknown]] + at[unknown] % longest].tolist()]
            count[unknown] = [len(s) for s in spelt]
            ids = np.repeat(ids, count)
            ids[ids < 0] = [self.words.byte_ids[b] for s in spelt for b in s]
        ends = 4 * np.cumsum(np.bincount(owner, count, n).astype(np.int64))
        raw, ends = ids.astype("<i4").tobytes(), [0, *ends.tolist()]
        return (raw[a:b] for a, b in zip(ends, ends[1:]))


class Encoder(dict):
    """Little-endian 32-bit ids of remembered parts."""

    def __init__(self, path: str):
        super().__init__()
        self.words = vocabulary(path)
        self.viterbi = StreamingViterbi(self.words)
        self.lattice = Lattice(self.words)

    def __missing__(self, part: str) -> bytes:
        finer = self.words.cuts(part)
        if len(finer) > 1:
            ids = b"".join(map(self.__getitem__, finer))
        else:
            step = 4 * self.words.longest  # fed in chunks: scores and back-pointers of a window are held, not of the part
            chunks = (part[a:a + step] for a in range(0, len(part), step))
            ids = b"".join(np.array(group, "<i4").tobytes() for group in self.viterbi.encode(chunks))
        if len(part) <= SHORT:
            self[part] = ids
        return ids

    def _learn(self, parts: set[str]) -> None:
        """Remembers short ``parts`` and the short ones that longer parts are made of."""
        finer = {p: self.words.cuts(p) for p in parts}
        self.update(self.lattice.encode([q for q in set().union(*finer.values()) if len(q) <= SHORT and q not in self]))
        for part, cuts in finer.items():
            if len(cuts) > 1 and len(part) <= SHORT:
                self[part] = b"".join(map(self.__getitem__, cuts))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; parts that are new in them are worked out together."""
        parts = [self.words.parts(t) for t in texts]
        self._learn(set().union(*parts).difference(self))
        ids = [b"".join(map(self.__getitem__, p)) for p in parts]
        if len(self) > REMEMBERED:
            self.clear()
        return ids

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(batches, path: str):
    encoder = _encoder(path)  # kept over a worker's tasks
    for batch in batches:
        ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))],
            names=["doc_id", "ids"])


def _decoded(batches, path: str):
    words = vocabulary(path)
    for batch in batches:
        ids, sizes = batch.column("ids").flatten(), batch.column("ids").value_lengths().fill_null(0)
        texts = words.decode_all(ids.to_numpy(), sizes.to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digests(batches, path: str):
    encoder = _encoder(path)  # kept over a worker's tasks
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = encoder.encode_all(texts)
        decoded = encoder.words.decode_all(np.frombuffer(b"".join(ids), "<i4"), [len(i) // 4 for i in ids])
        rows = [(len(i) // 4, zlib.crc32(i), zlib.crc32(back.encode()), back == text.replace(BLANK, " "))
                for text, i, back in zip(texts, ids, decoded)]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                         names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per row of ``docs``."""
    return _source(docs, id_col, text_col).mapInArrow(lambda b: _encoded(b, model), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of ``encode``'s rows."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, model), "doc_id bigint, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_crc32, round_trip: both ways in one pass."""
    return _source(docs, id_col, text_col).mapInArrow(
        lambda b: _digests(b, model),
        "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean")
