"""Which texts contain which names (J7), by a rarest-gram index.

A text that contains a name contains all its grams (runs of q bytes of UTF-8), so one of
them may stand for the name: the *anchor*, the gram that the texts hold least often.  Names
that share a prefix, or a word that every line holds, then meet few texts.

1. q follows the length of each name: the largest of 1, 2, 4, 8 that fits, so that one
   short name does not make the grams of all others short;
2. a sketch, the gram counts of every ``SKETCHED``-th line about, says which grams are
   frequent; a name's anchor is its rarest (then the one fewest names hold, then the first).
   The sketch steers only the work: any gram of a name finds it;
3. the anchors fill a Bloom filter of bounded size, which drops the grams of a text
   before they become rows; what passes is joined with the anchors and the whole name is
   tested.

Grams are numbers: a task takes those of all texts of an Arrow batch at once, by shifts
over their bytes, and tests them against the filter as arrays.  Two grams of one number
only make a candidate more.

Rows made are about the texts times the anchors that they hold, near the number of
hits; no plan depends on how many names there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..session import importable, materialize

LENGTHS = (1, 2, 4, 8)
SKETCHED = 16
_PART = 1 << 17            # bytes of a batch that are taken at once
_BITS, _MOST_BITS = 32, 1 << 26
_PROBES = (0, 21, 42)      # bit places are taken from these parts of a hash
_U64 = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain): spreads all 64 bits."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The number of the run of ``q`` bytes at each place of ``data``."""
    runs, width = data.astype(_U64), 1
    while width < q:
        runs = runs[:-width] | runs[width:] << _U64(8 * width)
        width *= 2
    return _mixed(runs + _U64(q * 0x9E3779B97F4A7C15 % (1 << 64)))


def _text(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts of an Arrow column, the place where each text ends); a null has none."""
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    texts = column.cast(pa.large_binary()).fill_null(b"")
    _, places, held = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[places[0]:places[-1]] if held is not None else np.empty(0, np.uint8)
    return data, places[1:] - places[0]


def grams_in(column, lengths, holds=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the distinct grams of each text of a column that pass the filter, by row."""
    data, ends = _text(column)
    rows, found = [np.empty(0, np.int64)], [np.empty(0, _U64)]
    for q in lengths:
        for a in range(0, len(data) - q + 1, _PART):
            runs = grams(data[a:a + _PART + q - 1], q)
            at = np.arange(len(runs)) if holds is None else holds.places(runs)
            row = np.searchsorted(ends, a + at, "right")
            whole = a + at + q <= ends[row]
            rows.append(row[whole])
            found.append(runs[at[whole]])
    row, gram = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[first], gram[first]


def _with_grams(batches, text_col: str, lengths, holds):
    for batch in batches:
        row, gram = grams_in(batch.column(text_col), lengths, holds)
        places = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(places), pa.array(gram.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_grams"])


def exploded(texts: DataFrame, text_col: str, lengths, holds=None) -> DataFrame:
    """``texts`` with ``gram``: a row for each distinct gram of a text that passes the filter."""
    importable(texts.sparkSession)
    schema = Y.StructType([*texts.schema.fields, Y.StructField("_grams", Y.ArrayType(Y.LongType()))])
    found = texts.mapInArrow(lambda b: _with_grams(b, text_col, lengths, holds), schema)
    return found.select(*texts.columns, F.explode("_grams").alias("gram"))


class Bloom:
    """A test of 64-bit hashes that holds for all that filled it and for about one in 1,400 others."""

    def __init__(self, words, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.int64)
        for word, held in words:  # at most _MOST_BITS / 64
            self.words[word] = held

    def __call__(self, hashed: Column) -> Column:
        """The test of a column of hashes; the filter is a constant of the plan."""
        table, test = F.lit(self.words), F.lit(True)
        for place in _places(hashed, self.bits):
            word = F.get(table, F.shiftright(place, 6).cast("int"))
            test &= F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        return test

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where in an array of hashes the test holds."""
        words, at = self.words.view(_U64), np.arange(len(hashes))
        for probe in _PROBES:
            place = hashes[at] >> _U64(probe) & _U64(self.bits - 1)
            at = at[(words[(place >> _U64(6)).view(np.int64)] >> (place & _U64(63)) & _U64(1)).view(np.int64) == 1]
        return at


def _places(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, p).bitwiseAND(F.lit(bits - 1)) for p in _PROBES]


def bloom(values: DataFrame, column: str, count: int, hashed=F.xxhash64) -> Bloom:
    """The filter of the ``hashed`` values of ``column``: ``_BITS`` bits for each, at most ``_MOST_BITS``."""
    bits = min(_MOST_BITS, max(64, 1 << (count * _BITS - 1).bit_length()))
    places = values.select(F.explode(F.array(*_places(hashed(F.col(column)), bits))).alias("place"))
    words = (places.select(F.shiftright("place", 6).cast("int").alias("word"), F.col("place").bitwiseAND(63).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("set")).collect())
    return Bloom(words, bits)


def _size(grams_of_names: DataFrame, name_col: str) -> tuple[int, list[int]]:
    """(rows, lengths of their grams: four at most)"""
    found = grams_of_names.agg(F.count(F.lit(1)).alias("n"), F.collect_set(_own_length(name_col)).alias("lengths")).first()
    return found["n"], sorted(found["lengths"])


def _own_length(name_col: str) -> Column:
    size = F.octet_length(name_col)
    return F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)


def _filter(grams_of_names: DataFrame, name_col: str) -> tuple[list[int], Bloom]:
    """(lengths of the grams, their filter)"""
    count, lengths = _size(grams_of_names, name_col)
    return lengths, bloom(grams_of_names, "gram", count, lambda gram: gram)


def anchors(texts: DataFrame, text_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """(name, gram): each name's rarest gram.  ``names`` are distinct, not empty, and written."""
    own = [exploded(names.select(name_col).filter(_own_length(name_col) == q), name_col, [q]) for q in LENGTHS]
    of_names = materialize(own[0].union(own[1]).union(own[2]).union(own[3]), "name-grams")
    shared = of_names.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    lengths, holds = _filter(of_names, name_col)
    seen = (exploded(texts.sample(1 / SKETCHED, 17).select(text_col), text_col, lengths, holds)
            .groupBy("gram").agg(F.count(F.lit(1)).alias("texts")))
    rated = of_names.join(shared, "gram").join(seen, "gram", "left")
    rank = F.struct(F.coalesce("texts", F.lit(0)), "names", "gram")
    return rated.groupBy(name_col).agg(F.min_by("gram", rank).alias("gram"))


def candidates(texts: DataFrame, text_col: str, names: DataFrame, name_col: str) -> DataFrame | None:
    """``texts`` with ``gram`` and ``name_col`` for every name whose anchor they hold; None without names.
    Runs jobs while it is built."""
    known = materialize(names.select(name_col).filter(F.col(name_col) != "").distinct(), "names")
    if known.isEmpty():
        return None
    anchored = materialize(anchors(texts, text_col, known, name_col), "anchors")
    lengths, holds = _filter(anchored, name_col)
    return exploded(texts, text_col, lengths, holds).join(anchored, "gram")


def mentions(texts: DataFrame, text_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """``texts`` with ``name_col``: one row for every text and every distinct name that it contains.
    Null and empty names, and null texts, meet nothing."""
    found = candidates(texts, text_col, names, name_col)
    if found is None:
        return texts.select("*", F.lit("").alias(name_col)).limit(0)
    return found.filter(F.col(text_col).contains(F.col(name_col))).drop("gram")
