"""Operator 8: MinHash near-duplicates with sequential Bayesian verification.

Texts link when the Jaccard similarity of their sets of five-word shingles is
at least 0.75.  The steps, all Spark jobs:

1. one pass hashes every whole text: a 128-bit key of its word sequence, the
   size of its shingle set and ``BANDS * ROWS`` minima;
2. exact copies fold to one *class* per key before anything else is shuffled, so
   a group of copies costs one row;
3. each band of a class is a bucket; only buckets with two classes or more stay.
   With similarity s two classes share none of the buckets with probability
   (1 - s^4)^32: 5e-6 at s = 0.75, below 1e-9 from s = 0.83;
4. *star pairs*: every class of a bucket is compared with the bucket's leader
   (rows grow with the members of a bucket, not with their pairs).  A pair is
   judged sequentially by batches of 16 minima: it is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``MISS``; the most alike survivor of each class is confirmed on
   whole shingle sets; confirmed links give components;
5. in buckets that still hold several components, the members outside the largest
   one are compared with all members of other components, in blocks inside
   tasks.  A block holds the whole shingle sets too: survivors of the sequential
   test are confirmed there, the most alike first, and two members that a link of
   the block has joined are not tested again.  Only links that join components of
   the block leave it, so at most one row for each of its members, however alike
   they all are;
6. components over all confirmed links are the result.

Nothing is capped: a pair is skipped only when both texts are already in one
component, or in a bucket that is not the first of those they share.

Defined results: a text without words (or null) has an empty set, links with
nothing and is kept; with one to four words its set is the whole sequence;
repeated rows of one id stand for one document (what one links to, all do);
rows with a null id take no part: null component, kept; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ._common import U64, drop_stored, mix, rolling, stored

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-4
#: Members and shingles of one side of a block
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BLOCK = 1024


def shingles(text: bytes, lower: bool = True) -> tuple[bytes, np.ndarray]:
    """128-bit key of the word sequence and its sorted distinct shingle hashes."""
    words = (text.lower() if lower else text).split()  # bytes: A-Z only, ASCII white space only
    key = xxhash.xxh3_128_digest(b" ".join(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    return key, np.unique(rolling(hashes, min(SHINGLE, max(len(words), 1))))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of each hash function's minimum over a shingle set.

    Unequal minima agree by chance with probability 2^-16, which the exact
    confirmation undoes."""
    low = None
    for a in range(0, len(hashes), _BLOCK):
        part = ((hashes[None, a:a + _BLOCK] * _A[:, None]) >> U64(24)).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.uint16)


def _signed(batches):
    for batch in batches:
        keys, sizes, signs = [], [], []
        for text in batch.column("text").to_pylist():
            key, found = shingles(text) if text else (None, ())
            if not len(found):
                keys.append(None), sizes.append(0), signs.append(None)
                continue
            keys.append(key), sizes.append(len(found)), signs.append(minima(found).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
            names=["doc_id", "key", "n_shingles", "sign"])


def _sets(batches):
    for batch in batches:
        found = [shingles(t or b"") for t in batch.column("text").to_pylist()]
        sets = [f.view(np.int64) for _, f in found]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in sets])]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.array([k for k, _ in found], pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
            names=["rep", "key", "shingles"])


def _buckets(signs: np.ndarray) -> np.ndarray:
    """The bucket of every band (columns) of every signature (rows)."""
    shift = (U64(16) * np.arange(ROWS, dtype=U64))[None, None, :]
    salt = mix(np.arange(1, BANDS + 1, dtype=U64))[None, :]
    parts = signs.reshape(-1, BANDS, ROWS).astype(U64) << shift
    return mix(parts.sum(axis=2, dtype=U64) ^ salt).view(np.int64)


def _banded(batches):
    """The bucket of every band of every class."""
    for batch in batches:
        bucket = _buckets(_signs(batch.column("sign")))
        rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
        size = np.repeat(batch.column("n").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(rep), pa.array(size)],
                                         names=["bucket", "rep", "n"])


def least_matches(total: int = BANDS * ROWS, batch: int = BATCH, percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each prefix of ``batch``, ``2 batch``, ... minima: the fewest matches
    that leave P(similarity >= percent / 100 | matches) >= ``miss``.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1); its tail is a
    binomial sum: P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
    return out


def _sequential(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``right`` (same place in ``left``, or its only row) that survive every batch, and their matches."""
    alive, matches = np.arange(len(right)), np.zeros(len(right), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        one = left[:, part] if len(left) == 1 else left[alive, part]
        matches[alive] += (one == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= fewest]
        if not len(alive):
            break
    return alive, matches[alive]


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _likely(batches, least: list[int]):
    """Pairs that survive every batch of minima, with their matches in all."""
    for batch in batches:
        alive, matches = _sequential(_signs(batch.column("sa")), _signs(batch.column("sb")), least)
        a, b = (batch.column(c).take(pa.array(alive)) for c in ("a", "b"))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(matches)], names=["a", "b", "matches"])


def _groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, from sorted batches."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and any(held[-1].column(k)[-1] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _coded(column) -> list[np.ndarray]:
    """Each row's set as codes counted from 0 over all rows."""
    sizes = np.asarray(column.combine_chunks().value_lengths())
    codes = np.unique(column.combine_chunks().flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
    return np.split(codes, np.cumsum(sizes)[:-1])


_CROSS = "bucket bigint, x int, y int, minor boolean, rep bigint, component bigint, sign binary, shingles array<bigint>"


def _joined(batches, least: list[int]):
    """Links of a block of minor members with a block of all members of one bucket: a
    spanning forest of the block's components under its links.

    A pair is judged in the first of the buckets that it shares."""
    for table in _groups(batches, ["bucket", "x", "y"]):
        minor = table.column("minor").to_numpy()
        every = np.flatnonzero(~minor)
        rep = table.column("rep").to_numpy()
        label = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        if not len(every) or (label == label[0]).all():
            continue
        sign, sets = _signs(table.column("sign")), _coded(table.column("shingles"))
        size = np.array([len(s) for s in sets])
        buckets = _buckets(sign)
        here = (buckets == table.column("bucket")[0].as_py()).all(axis=0)
        band = int(here.argmax())
        mark = np.zeros(max(s.max(initial=0) for s in sets) + 1, bool)
        a, b = [], []
        for i in np.flatnonzero(minor):
            small, large = np.minimum(size[i], size[every]), np.maximum(size[i], size[every])
            others = every[(label[every] != label[i]) & (100 * small >= PERCENT * large)]
            alive, matches = _sequential(sign[i:i + 1], sign[others], least)
            others = others[alive]
            first = (buckets[others] == buckets[i]).argmax(axis=1) == band
            others, matches = others[first], matches[first]
            mark[sets[i]] = True
            for j in others[np.lexsort((rep[others], -matches))]:
                if label[j] == label[i]:
                    continue
                shared = np.count_nonzero(mark[sets[j]])
                if 100 * shared >= PERCENT * (size[i] + size[j] - shared):
                    label[label == label[j]] = label[i]
                    a.append(min(rep[i], rep[j])), b.append(max(rep[i], rep[j]))
            mark[sets[i]] = False
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _size_fits(x: str, y: str):
    """A necessary condition of the threshold on two set sizes."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _confirmed(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets reach the threshold."""
    tested = (likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
              .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
              .select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("shared")))
    return stored(tested.filter(100 * F.col("shared") >= PERCENT * (F.col("both") - F.col("shared"))).select("a", "b"), "links")[0]


def _star_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of classes with the leader of one of their buckets, the most alike one."""
    pairs = (members.filter((F.col("rep") != F.col("leader")) & _size_fits("n", "leader_n"))
             .select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    sign = classes.select("rep", "sign")
    both = (pairs.join(sign.select(F.col("rep").alias("a"), F.col("sign").alias("sa")), "a")
            .join(sign.select(F.col("rep").alias("b"), F.col("sign").alias("sb")), "b"))
    least = least_matches()
    likely = (both.mapInArrow(lambda b: _likely(b, least), "a bigint, b bigint, matches bigint")
              .groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")))
    return _confirmed(stored(likely, "likely-pairs")[0], sets)


def _open_members(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members (bucket, rep, n, component) of the buckets that hold several components."""
    placed, _ = stored(members.select("bucket", "rep", "n")
                       .join(component.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
                       .withColumn("component", F.coalesce("component", "rep")), "placed-members")
    mixed = (placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter(F.col("lo") != F.col("hi")).select("bucket"))
    return stored(placed.join(stored(mixed, "mixed-buckets")[0], "bucket"), "open-members")[0]


def _cross_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components of a bucket.

    A bucket's members outside its largest component meet all its members, block
    by block inside tasks (see ``_joined``); blocks are cut by members and by shingles."""
    counted, _ = stored(members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")),
                        "bucket-components")
    per_bucket = (counted.groupBy("bucket")
                  .agg(F.sum("k").alias("all"), F.sum("s").alias("all_s"), F.max_by(F.struct("component", "k", "s"), F.struct("k", "component")).alias("main")))
    per_bucket, _ = stored(per_bucket, "open-buckets")
    lot = F.xxhash64("rep", F.lit(8))

    def blocks(rows, size):
        return F.ceil(F.greatest(rows / F.lit(BLOCK), size / F.lit(BLOCK_SHINGLES))).cast("int")

    alls, zero = blocks(F.col("all"), F.col("all_s")), F.lit(0)
    minors = blocks(F.col("all") - F.col("main.k"), F.col("all_s") - F.col("main.s"))
    as_member = F.transform(F.sequence(zero, minors - 1), lambda x: F.struct(
        x.alias("x"), F.pmod(lot, alls).cast("int").alias("y"), F.lit(False).alias("minor")))
    as_minor = F.transform(F.sequence(zero, alls - 1), lambda y: F.struct(
        F.pmod(lot, minors).cast("int").alias("x"), y.alias("y"), F.lit(True).alias("minor")))
    dealt = (members.join(per_bucket, "bucket")
             .withColumn("part", F.explode(F.when(F.col("component") == F.col("main.component"), as_member)
                                           .otherwise(F.concat(as_member, as_minor))))
             .select("bucket", "part.*", "rep", "component").join(sets, "rep")
             .select(*[c.split()[0] for c in _CROSS.split(", ")]))
    least = least_matches()
    joined = (dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
              .mapInArrow(lambda b: _joined(b, least), "a bigint, b bigint"))
    return stored(joined, "cross-links")[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``.

    Runs jobs while it is built; its tables live under the checkpoint folder."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows, _ = stored(src.mapInArrow(_signed, "doc_id bigint, key binary, n_shingles bigint, sign binary"), "signed")
    classes, _ = stored(rows.filter("doc_id is not null and key is not null").groupBy("key")
                        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign")),
                        "classes")
    banded, path = stored(classes.select("rep", "n", "sign").mapInArrow(_banded, "bucket bigint, rep bigint, n bigint"), "banded")
    shared = (banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("rep", "n")).alias("l")).filter("k > 1")
              .select("bucket", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n")))
    members, _ = stored(banded.join(stored(shared, "buckets")[0], "bucket"), "members")
    drop_stored(docs.sparkSession, path)
    # whole shingle sets, one for each class that shares a bucket: rows that repeat count once
    near = members.select("rep").distinct()
    texts = src.withColumnRenamed("doc_id", "rep").join(near, "rep", "left_semi")
    sets = (texts.mapInArrow(_sets, "rep bigint, key binary, shingles array<bigint>")
            .groupBy("key", "rep").agg(F.first("shingles").alias("shingles")))
    sets, _ = stored(sets.join(classes.select("key", "rep", "sign"), ["key", "rep"]).select("rep", "sign", "shingles"), "shingle-sets")
    links = _star_links(members, classes, sets)
    open_members = _open_members(members, connected_components(links, "a", "b"))
    links = links.unionByName(_cross_links(open_members, sets))
    # an id that names several texts joins them
    twice = rows.filter("doc_id is not null and key is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    of = rows.join(classes.select("key", "rep"), "key", "left")
    same = of.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(links.unionByName(same), "a", "b")
    return (of.join(component.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
            .withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
