"""Operator 7: lexical retrieval packing.

Documents become token ids and are packed into windows of ``window`` ids so
that texts which share rare words lie together:

1. every text is tokenised once; full windows of a long document are cut off
   at once (they need no neighbour) and the rest, shorter than a window, is the
   *unit* to be packed;
2. the document frequency of every token id over **all** units (a table bounded
   by the vocabulary) gives the idf of BM25;
3. units are dealt by their content over shards, as many as the data needs for
   ``shard_units`` units each: on a line ordered by the rarest id that any other
   unit holds and then by the second rarest, cut at equal lengths, units that
   share them lie together at every size; a shard is one task's inverted index;
4. in a shard the longest unused unit seeds a window; BM25 scores of the units
   that share any of its ids order the unused neighbours, which fill the
   window.  The last one is cut where the window ends and its rest stays in the
   index as a unit.  Without a neighbour the next longest unit is taken.

A window is full unless it is the last of its shard, so padding is at most one
window per shard.  An id that is the rarest of many units is dealt by the second
rarest, and a hot pair of both (exact copies, a hot source) by the row's place in
its partition, so a shard holds little more than its share.

Defined results: a null text is an empty text (its only id is ``end_id``); null
or repeated ids are kept, each row being a document of its own; an empty table
gives no piece; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LONG_WORD, Budget, U64, drop_stored, mix, per_worker, stored

WINDOW = 4096
END_ID = 2
SHARD_UNITS = 4096
K1, B = 1.2, 0.75
CACHED = 192 << 20  # bytes that a worker's words may take

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
_SIGNS = string.punctuation.replace("'", "")
_LARGE = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_SMALL = _LARGE.lower() + "\xdf\xff"
BLANK, LETTER, SIGN, DIGIT, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)  # of a byte of UTF-8; letters beyond ASCII begin with 0xC3
for _kind, _bytes in ((BLANK, b"\t\n\v\f\r "), (SIGN, _SIGNS.encode()), (DIGIT, string.digits.encode()),
                      (LETTER, string.ascii_letters.encode() + bytes([0xC3, *range(0x80, 0xC0)]))):
    _KIND[list(_bytes)] = _kind
# the character by which a byte of a plain word is spelled in a model of bytes, in lower case
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = np.empty(256, np.uint32)
_SPELLED[_PRINTED] = _PRINTED
_SPELLED[np.setdiff1d(np.arange(256), _PRINTED)] = np.arange(256, 512 - len(_PRINTED))
_SPELLED[65:91], _SPELLED[0x80:0x9F], _SPELLED[32] = _SPELLED[97:123], _SPELLED[0xA0:0xBF], 32
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # the first n of 8 bytes


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _bare(tokenizer):
    """A tokenizer of parts between blanks by ``tokenizer``'s model alone, None if it gives other ids for plain words."""
    from tokenizers import Tokenizer, pre_tokenizers
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    small, large = string.ascii_lowercase + _SMALL, string.ascii_uppercase + _LARGE
    probe = [*small, *large, small, *(a + b for a in string.ascii_lowercase for b in small), "7", "1234", "a1b22c", *_SIGNS, _SIGNS,
             *(f"a{s}b{s}{s}" for s in _SIGNS), *(f"{s}A1{s}2" for s in _SIGNS), *(a + b for a in _SIGNS for b in _SIGNS if a + b != "<|")]
    data = np.frombuffer(" ".join(probe).encode() + b" ", np.uint8)
    same = bare.encode(_parted(data, _KIND[data])[0], add_special_tokens=False).ids == [
        i for e in tokenizer.encode_batch(probe, add_special_tokens=False) for i in e.ids]
    return bare if same and all(t.content.startswith("<|") for t in tokenizer.get_added_tokens_decoder().values()) else None


def _parted(data: np.ndarray, kind: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Plain words, a blank behind each, as a model of bytes spells them in lower case, with blanks between
    their parts too: runs of letters, runs of signs, single digits.  Where each word's spelling ends, and
    how many parts end there or before."""
    inner = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] != BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))) + 1
    stops = np.flatnonzero(kind == BLANK)
    before = np.searchsorted(inner, stops)
    text = np.insert(_SPELLED[data], inner, 32).astype("<u4").tobytes().decode("utf-32-le")
    return text, stops + before, before + np.arange(1, len(stops) + 1)


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words between blanks of all texts, and where each text's words begin and the last ends."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _KIND[data] != BLANK
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begin, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.searchsorted(begin, np.cumsum([0, *(len(r) + 1 for r in raw)]))


def _gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``count`` entries of ``flat`` from ``begin`` in order, and where each ends."""
    ends = np.cumsum(count)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)], ends


class _Table:
    """Ids of short words, in arrays that are read and written for many words at once: a word has one slot,
    by its bytes, and a new word takes it unless the word there was met in the same call."""

    WIDTH, IDS = 16, 8  # bytes of a word, ids of a word

    def __init__(self, most: int, kind: np.dtype):
        slots = 1 << (most // (22 + self.IDS * kind.itemsize)).bit_length() - 1  # 22 bytes a slot besides the ids
        self.low, self.high = np.zeros(slots, U64), np.zeros(slots, U64)
        self.size, self.count = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
        self.met, self.calls = np.zeros(slots, np.uint32), 0
        self.ids = np.zeros((slots, self.IDS), kind)

    def find(self, words: pa.Array) -> np.ndarray:
        """Which words the table holds; ``put`` and ``of`` speak of the words asked for last."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
        data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8)[:offsets[-1]], np.zeros(self.WIDTH, np.uint8)])
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the 8 bytes from each place
        begin, size = offsets[:-1], np.diff(offsets)
        low = eights[begin] & _FIRST[np.minimum(size, 8)]
        high = eights[begin + np.minimum(size, 8)] & _FIRST[np.clip(size - 8, 0, 8)]
        slot = (mix(low ^ mix(high + U64(1))) & U64(len(self.low) - 1)).astype(np.int64)
        self.asked = low, high, size, slot
        found = (self.size[slot] == size) & (self.low[slot] == low) & (self.high[slot] == high)
        self.calls += 1
        self.met[slot[found]] = self.calls
        return found

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places`` in order, and how many each has."""
        slot = self.asked[3][places]
        count = self.count[slot]
        return self.ids[slot][np.arange(self.IDS) < count[:, None]], count

    def put(self, places: np.ndarray, flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Takes what it can of the words at ``places`` with their ids; which of them it has not taken."""
        low, high, size, slot = (a[places] for a in self.asked)
        fit = np.flatnonzero((size <= self.WIDTH) & (count <= self.IDS) & (self.met[slot] != self.calls))
        fit = fit[np.unique(slot[fit], return_index=True)[1]]
        at = slot[fit]
        self.low[at], self.high[at], self.size[at], self.count[at] = low[fit], high[fit], size[fit], count[fit]
        self.met[at] = self.calls
        self.ids[at] = np.concatenate([flat, np.zeros(self.IDS, flat.dtype)])[begin[fit][:, None] + np.arange(self.IDS)]
        return np.delete(np.arange(len(places)), fit)

    def words(self) -> list[str]:
        full = np.flatnonzero(self.size)
        raw = np.stack([self.low[full], self.high[full]], 1).astype("<u8").tobytes()
        return [raw[a:a + n].decode() for a, n in zip(range(0, len(raw), self.WIDTH), self.size[full].tolist())]


class WordIds:
    """Ids of whole texts by a tokenizer whose pieces never span white space:
    the ids of a text are those of its words in order, and words repeat.  Words
    are parted, made distinct and looked up as arrays over the texts of a call;
    only a word that the table does not hold is a Python string.

    A worker remembers words over all its tasks: half of ``CACHED`` is the table
    of short words, and words that it does not take are kept in two generations
    of a quarter each: when the newer is full the older is forgotten, and a word
    met again moves to the newer, so frequent words stay.  New words of letters,
    digits and signs are parted and put in lower case as arrays, as the tokenizer
    does it, and many are encoded by its model in one call and parted again where
    an id ends a part; others pass the whole tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.bare = _bare(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.table = _Table(CACHED // 2, self.kind)
        self.known: dict[str, bytes] = {}
        self.older: tuple[dict] = {},
        self.budget = Budget(CACHED // 4)
        self.learnt = None

    @property
    def plain(self) -> list[str]:
        """The words of the table."""
        return self.table.words()

    def _encode_plain(self, data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words in order, and where each word's end."""
        text, stops, parts = _parted(data, kind)
        cuts = [0, *stops[249:-1:250].tolist(), len(text)]
        ids = np.concatenate([np.array(self.bare.encode_batch_fast([text[a:b]], add_special_tokens=False)[0].ids, self.kind)
                              for a, b in zip(cuts, cuts[1:])])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != parts[-1] or ends[-1] != len(ids):
            raise ValueError("the tokenizer parts plain words")
        return ids, ends[parts - 1]

    def _learn(self, words: list[str]) -> None:
        """Sets ``learnt``: ids, and where each word's ids begin and how many they are."""
        data = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
        kind = _KIND[data]
        sizes = np.diff(np.flatnonzero(kind == BLANK), prepend=-1)
        strange = kind == ODD
        strange[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        strange[1:] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))  # may be a special token
        odd = np.logical_or.reduceat(strange, np.cumsum(sizes) - sizes) if self.bare else np.ones(len(words), bool)
        found = self.tokenizer.encode_batch_fast([words[k] for k in np.flatnonzero(odd).tolist()], add_special_tokens=False)
        count = np.zeros(len(words), np.int64)
        count[odd] = [len(e.ids) for e in found]
        flat = [np.array([i for e in found for i in e.ids], self.kind)]
        order = [np.flatnonzero(odd)]
        if not odd.all():
            keep = np.repeat(~odd, sizes)
            ids, ends = self._encode_plain(data[keep], kind[keep])
            count[~odd] = np.diff(ends, prepend=0)
            flat.append(ids)
            order.append(np.flatnonzero(~odd))
        order = np.concatenate(order)
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        self.learnt = np.concatenate(flat), begin, count

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's begin and how many they are."""
        found = self.table.find(words)
        held, missing = np.flatnonzero(found), np.flatnonzero(~found)
        strings = words.take(pa.array(missing)).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, strings))
        older = self.older[0]
        for k in [k for k, i in enumerate(ids) if i is None and strings[k] in older] if older else ():
            ids[k] = self.known[strings[k]] = older[strings[k]]
        kept = [k for k, i in enumerate(ids) if i is not None]
        new = [k for k, i in enumerate(ids) if i is None]
        known = [ids[k] for k in kept]
        flat, count = self.table.of(held)
        flat, counts = [flat, np.frombuffer(b"".join(known), self.kind)], [count, [len(i) // self.kind.itemsize for i in known]]
        if new:
            self._learn([strings[k] for k in new])
            ids, begin, count = self.learnt
            rest = self.table.put(missing[new], ids, begin, count)
            later = {strings[new[k]]: ids[begin[k]:begin[k] + count[k]].tobytes() for k in rest.tolist() if len(strings[new[k]]) <= LONG_WORD}
            self.known.update(later)
            if self.budget.spent(later):
                self.older, self.known = (self.known,), {}
            flat.append(_gather(ids, begin, count)[0])
            counts.append(count)
        order, count = np.concatenate([held, missing[kept], missing[new]]).astype(np.int64), np.concatenate(counts).astype(np.int64)
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], size[order] = np.cumsum(count) - count, count
        return np.concatenate(flat), begin, size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        words, bounds = _words(texts)
        if not len(words):
            return [b""] * len(texts)
        coded = words.dictionary_encode()
        flat, begin, count = self._ids_of(coded.dictionary)
        at = coded.indices.to_numpy()
        found, ends = _gather(flat.astype("<u4"), begin[at], count[at])
        ends = 4 * np.concatenate([[0], ends])[bounds]
        raw = found.tobytes()
        return [raw[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]


def _word_ids(path: str) -> WordIds:
    return per_worker("word ids", path, lambda: WordIds(path))


def _units(batches, path: str, end_id: int, window: int):
    ids_of = _word_ids(path)
    end = np.array([end_id], "<u4").tobytes()
    place = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = [i + end for i in ids_of.encode([t or "" for t in batch.column("text").to_pylist()])]
        size = [len(i) // 4 for i in ids]
        whole = [[zlib.crc32(i[4 * a:4 * (a + window)]) for a in range(0, n - window + 1, window)]
                 for i, n in zip(ids, size)]
        tail = [np.frombuffer(i[4 * window * len(c):], "<u4").astype("<u2").tobytes() for i, c in zip(ids, whole)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(whole, pa.list_(pa.int64())),
             pa.array(tail, pa.binary()), pa.array(range(place, place + len(size)), pa.int64())],
            names=["doc_id", "doc_tokens", "whole", "tail", "place"])
        place += len(size)


def _frequencies(batches, vocabulary: int):
    total = np.zeros(vocabulary, np.int64)
    for batch in batches:
        for tail in batch.column("tail").to_pylist():
            total[np.unique(np.frombuffer(tail, "<u2"))] += 1
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "df"])


def _rarest(tails: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of the rarest two ids of each tail by ``order`` (rank of an id, ``len(order)``
    where no other unit has it); -1 where there is none."""
    none = len(order)
    sizes = np.array([len(t) // 2 for t in tails])
    first, second = np.full(len(tails), none), np.full(len(tails), none)
    filled = np.flatnonzero(sizes)
    if len(filled):
        rank = order[np.frombuffer(b"".join(tails), "<u2")]
        starts = np.cumsum(sizes[filled]) - sizes[filled]
        first[filled] = np.minimum.reduceat(rank, starts)
        second[filled] = np.minimum.reduceat(np.where(rank == np.repeat(first[filled], sizes[filled]), none, rank), starts)
    return np.where(first < none, first, -1), np.where(second < none, second, -1)


def _line(first: pd.DataFrame, pairs: pd.DataFrame, size: float) -> tuple[dict, dict]:
    """Places on the line of shards: (begin, length) of each first id and of the hot
    pairs.  ``first``: first, count; ``pairs``: first, second, count of pairs of ids
    that hold over ``size / 8`` units, where the first holds over ``size / 2``."""
    begin, spans, hot = 0, {}, {}
    of = {k: g for k, g in pairs.groupby("first")}
    for key, count in sorted(zip(first["first"].tolist(), first["count"].tolist())):
        for second, n in sorted(zip(of[key]["second"].tolist(), of[key]["count"].tolist())) if key in of else ():
            hot[key, second] = begin, n if n > size / 2 else 0
            begin, count = begin + n, count - n
        spans[key] = begin, count if count > size / 2 else 0
        begin += count
    return spans, hot


def _shards(tails, places, order: np.ndarray, spans: dict, hot: dict, size: float, shards: int) -> np.ndarray:
    """The shard of each unit."""
    first, second = _rarest(tails, order)
    by_second = mix(second.astype(np.int64).view(U64) + U64(1)) / 2.0 ** 64
    by_place = mix(np.asarray(places, np.int64).view(U64)) / 2.0 ** 64
    at = np.empty(len(first))
    for i, key in enumerate(zip(first.tolist(), second.tolist())):
        if key in hot:
            begin, length = hot[key]
            at[i] = begin + length * by_place[i]
        else:
            begin, length = spans[key[0]]
            at[i] = begin + length * by_second[i]
    return np.minimum(at / size, shards - 1).astype(np.int32)


def _counts(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unit, id, count of all units' ids, by unit and id; 256 units are sorted at once."""
    found = []
    for a in range(0, len(tails), 256):
        part = tails[a:a + 256]
        keys = np.sort(np.repeat(np.arange(a, a + len(part)) << 16, [len(t) for t in part]) | np.concatenate(part))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        found.append((keys[first], np.diff(first, append=len(keys))))
    keys, count = (np.concatenate(c) for c in zip(*found))
    return keys >> 16, keys & 0xFFFF, count


class _Index:
    """BM25 over the units of one shard: postings in one array, sorted by id; ids that
    over a quarter of the units hold have a row of weights over all units instead."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(t) for t in tails], float)
        unit, term, count = _counts(tails)
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[unit] / mean))
        order = np.argsort(term, kind="stable")
        self.unit, self.weight = unit[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.terms = np.split(term, np.searchsorted(unit, np.arange(1, len(tails))))
        self.idf = idf
        # at most four times the mean number of a unit's ids
        self.common = {}
        for t in np.flatnonzero(4 * np.diff(self.first) > max(len(tails), 4)).tolist():
            at = slice(self.first[t], self.first[t + 1])
            self.common[t] = row = np.zeros(len(tails))
            row[self.unit[at]] = self.weight[at]

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> np.ndarray:
        """Unused units by falling score (ties: the earlier unit), ``most`` at a time."""
        terms = self.terms[seed]
        size = self.first[terms + 1] - self.first[terms]
        terms = terms[size > 1]
        if not len(terms):
            return np.empty(0, np.int64)
        rows = [self.common.get(t) for t in terms.tolist()]
        spans = [slice(a, b) for a, b, r in zip(self.first[terms].tolist(), self.first[terms + 1].tolist(), rows) if r is None]
        score = np.zeros(len(used))
        if spans:
            score += np.bincount(np.concatenate([self.unit[s] for s in spans]),
                                 np.concatenate([self.weight[s] for s in spans]), len(used))
        for row in rows:
            if row is not None:
                score += row
        score[used] = 0.0
        score[seed] = 0.0
        found = np.flatnonzero(score)
        if len(found) > most:
            found = found[np.argpartition(-score[found], most - 1)[:most]]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(units: pd.DataFrame, shard: int, idf: np.ndarray, mean: float, window: int) -> pd.DataFrame:
    """Pieces of one shard's documents: doc_id, doc_tokens, whole (checksums of
    the full windows cut before), tail (16-bit ids of the rest)."""
    rows, sequence = [], shard << 32
    tails = [np.frombuffer(t, "<u2") for t in units["tail"]]
    start = []
    for doc, tokens, whole in zip(units["doc_id"], units["doc_tokens"], units["whole"]):
        for k, crc in enumerate(whole):
            rows.append((doc, k * window, window, int(crc), tokens, sequence, 0))
            sequence += 1
        start.append(len(whole) * window)
    docs, tokens = list(units["doc_id"]), list(units["doc_tokens"])
    used = np.array([len(t) == 0 for t in tails])
    at = np.zeros(len(tails), np.int64)
    index = _Index(tails, idf, mean) if len(tails) else None
    longest = [(-len(t), k) for k, t in enumerate(tails) if len(t)]
    heapq.heapify(longest)

    def next_longest() -> int | None:
        while longest:
            left, k = heapq.heappop(longest)
            if not used[k] and -left == len(tails[k]) - at[k]:
                return k
        return None

    carry = None
    while (seed := carry if carry is not None else next_longest()) is not None:
        carry, room, offset, unit = None, window, 0, seed
        queue, more = iter(()), True
        while unit is not None:
            left = len(tails[unit]) - at[unit]
            take = int(min(left, room))
            piece = tails[unit][at[unit]:at[unit] + take]
            rows.append((docs[unit], int(start[unit] + at[unit]), take, zlib.crc32(piece.astype("<u4").tobytes()),
                         tokens[unit], sequence, offset))
            at[unit] += take
            used[unit] = at[unit] == len(tails[unit])
            room, offset = room - take, offset + take
            if not used[unit]:
                carry = unit  # the rest of a cut unit seeds the next window
            if not room:
                break
            unit = next((int(k) for k in queue if not used[k]), None)
            if unit is None and more:
                found = index.neighbours(seed, used, 64)
                queue, more = iter(found), len(found) > 0
                unit = next((int(k) for k in queue if not used[k]), None)
            if unit is None:
                unit = next_longest()
        sequence += 1
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
         shard_units: int = SHARD_UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (``PIECES``) of all documents; runs jobs while it is built."""
    spark = docs.sparkSession
    vocabulary = _tokenizer(tokenizer).get_vocab_size()
    if max(vocabulary, end_id + 1) > 1 << 16:
        raise ValueError("ids are shuffled as 16 bits; the vocabulary is larger")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units, _ = stored(src.mapInArrow(lambda b: _units(b, tokenizer, end_id, window),
                                     "doc_id bigint, doc_tokens bigint, whole array<bigint>, tail binary, place bigint"), "units")
    # at most one row per id of the vocabulary
    counted = (units.select("tail").mapInArrow(lambda b: _frequencies(b, vocabulary), "id bigint, df bigint")
               .groupBy("id").agg(F.sum("df").alias("df")).toPandas())
    n, ids = units.agg(F.count(F.lit(1)), F.sum(F.length("tail") / 2)).first()
    df = np.zeros(vocabulary)
    df[counted["id"]] = counted["df"]
    shared = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    mean = max(float(ids or 0) / max(n, 1), 1.0)
    shards = max(1, round(n / shard_units))

    def packed(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "doc_tokens", "place"], kind="stable", ignore_index=True)
        return pack_shard(group, int(key[0]), shared.value, mean, window)

    order = np.full(1 << 16, vocabulary)
    ranked = np.lexsort((np.arange(vocabulary), df))
    ranked = ranked[df[ranked] > 1]
    order[ranked] = np.arange(len(ranked))
    size = max(n, 1) / shards
    order = spark.sparkContext.broadcast(np.where(order < len(ranked), order, 1 << 16))

    def keys(batches):
        for batch in batches:
            first, second = _rarest(batch.column("tail").to_pylist(), order.value)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=["first", "second"])

    pairs, path = stored(units.select("tail").mapInArrow(keys, "first int, second int")
                         .groupBy("first", "second").agg(F.count(F.lit(1)).alias("count")), "rarest")
    first = pairs.groupBy("first").agg(F.sum("count").alias("count")).toPandas()  # at most a row per id of the vocabulary
    large = set(first.loc[first["count"] > size / 2, "first"].tolist())
    many = pairs.filter(F.col("count") > size / 8).toPandas()  # at most 8 rows a shard
    drop_stored(spark, path)
    line = spark.sparkContext.broadcast(_line(first, many[many["first"].isin(large)], size))

    @F.pandas_udf("int")
    def shard(tails: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(_shards(tails.tolist(), places, order.value, *line.value, size, shards))

    return units.withColumn("shard", shard("tail", "place")).groupBy("shard").applyInPandas(packed, PIECES)
