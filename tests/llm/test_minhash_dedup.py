import random

import numpy as np
import pyarrow as pa
import pytest

from llm_tables import docs, edge_rows, frame, words
from qtrail.llm import minhash_dedup as M


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b] \
                    and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(10 ** 6)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("members, size", [(1024, 1 << 21), (4, 1 << 21), (1024, 300)])
def test_against_brute_force(spark, monkeypatch, members, size):
    monkeypatch.setattr(M, "BLOCK", members)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", size)
    rng = random.Random(11)
    texts = [words(rng, 60) for _ in range(20)]
    passage = words(rng, 60)
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(12)]
    for base in texts[:3]:
        texts += near_copies(rng, base, 25, 3)
    texts += [texts[0].upper()] * 10 + [texts[0].replace(" ", "\n")]
    table = docs(spark, texts).union(frame(spark, edge_rows()))
    got = sorted((tuple(r) for r in M.near_duplicates(table).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])


def test_a_block_gives_one_row_a_member_at_most():
    """Near copies that are all alike, each a component of its own: a forest leaves the block, not the pairs."""
    rng = random.Random(3)
    texts = [t.encode() for t in near_copies(rng, words(rng, 120), 150, 2)]
    found = {k: f for k, f in map(M.shingles, texts)}
    sets = list(found.values())
    signs = [M.minima(f).tobytes() for f in sets]
    n = len(sets)
    links = set()
    for bucket in np.unique(M._buckets(M._signs(pa.array(signs)))):
        inside = [i for i in range(n) if bucket in M._buckets(M._signs(pa.array(signs[i:i + 1])))]
        rows = [(int(bucket), 0, 0, minor, i, i, signs[i], sets[i].view(np.int64)) for minor in (False, True) for i in inside]
        block = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                           names=[c.split()[0] for c in M._CROSS.split(", ")])
        out = [tuple(r.values()) for b in M._joined([block], M.least_matches()) for r in b.to_pylist()]
        assert len(out) < max(len(inside), 1)
        links |= set(out)
    for i, j in links:
        assert 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))
    got = {i: i for i in range(n)}
    for _ in range(n):
        for i, j in links:
            got[i] = got[j] = min(got[i], got[j])
    want = {i: c for i, _, c, _ in brute([(i, t.decode()) for i, t in enumerate({M.shingles(t)[0]: t for t in texts}.values())])}
    assert got == want


def test_empty(spark):
    assert M.near_duplicates(frame(spark, [])).collect() == []


def test_one_id_with_two_texts_joins_them(spark):
    rows = [(i, t, None, None, None, "r", 1, "s", "b") for i, t in [(7, "a b c d e f"), (7, "g h i j k l"), (9, "g h i j k l"), (3, "a b c d e f")]]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False)]


def test_least_matches_is_the_posterior_bound():
    rng = np.random.default_rng(0)
    first = M.least_matches()[0]
    # P(s >= 0.75 | m of 16) under a uniform prior, by drawing from the posterior
    for m, low in ((first, False), (first - 1, True)):
        share = (rng.beta(m + 1, 16 - m + 1, size=2_000_000) >= 0.75).mean()
        assert (share < M.MISS) == low


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2 ** 63, 900, dtype=np.uint64)
    a, b = M.minima(np.unique(both[:800])), M.minima(np.unique(both[100:]))
    assert abs((a == b).mean() - 700 / 900) < 0.15
