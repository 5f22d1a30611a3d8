import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_tables import docs, edge_rows, frame, words
from qtrail.llm import packing as P

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check(table, window, most_padding, **parameters):
    """Every id of every row lies in one piece, windows are gapless, padding is little."""
    own = Tokenizer.from_file(WORDS)
    expected = defaultdict(list)
    for r in table.select("doc_id", "text").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected[r.doc_id, len(ids)].append(ids)
    pieces = defaultdict(list)
    windows = defaultdict(list)
    for r in P.pack(table, WORDS, window, **parameters).collect():
        pieces[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(expected)
    for key, texts in expected.items():
        found = sorted(pieces[key], key=lambda r: r.start)
        assert sum(r.length for r in found) == sum(map(len, texts))
        for ids in texts if len(texts) == 1 else []:
            at = 0
            for r in found:
                assert r.start == at
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
                at += r.length
    padding = 0
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert 0 < end <= window
        padding += window - end
    assert padding <= most_padding * window
    return pieces


def test_round_trip_and_padding(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.choice([1, 5, 40, 300]), "abcdefghijklmnopqrstuvwxyz") for _ in range(80)]
    texts += ["Don't 1,234 a.b,c Über. ΣΑΣ İi \x1ca\x1cb é <|endoftext|>x", "A,B. c.,", "...", "x" * 3000]
    check(docs(spark, texts).union(frame(spark, edge_rows())), 64, 1)


def test_shards_and_empty(spark):
    rng = random.Random(3)
    table = docs(spark, [words(rng, 30) for _ in range(60)])
    check(table, 256, 8, shard_units=10)
    assert P.pack(frame(spark, []), WORDS).collect() == []


def test_neighbours_share_a_window():
    """A seed's lexical neighbours come before other units."""
    import pandas as pd
    topics = [np.arange(100 * k, 100 * k + 40, dtype="<u2") for k in range(8)]
    tails = [np.random.default_rng(i).permutation(topics[i % 8]).astype("<u2") for i in range(32)]
    units = pd.DataFrame({"doc_id": range(32), "doc_tokens": [40] * 32, "whole": [[]] * 32, "tail": [t.tobytes() for t in tails]})
    found = P.pack_shard(units, 0, np.ones(1 << 16), 40.0, 160)
    for _, part in found.groupby("sequence_id"):
        assert len({d % 8 for d in part["doc_id"]}) == 1


def test_repeated_rows_are_spread(spark):
    """Rows that repeat with id and text, or null ids with one text, lie in many shards."""
    rng = random.Random(6)
    copy, null = words(rng, 30), words(rng, 30)
    table = frame(spark, [(1, copy, None, None, None, "r", 1, "s", "b")] * 60 + [(None, null, None, None, None, "r", 1, "s", "b")] * 60)
    pieces = P.pack(table.repartition(3), WORDS, 256, shard_units=10).collect()
    rows = defaultdict(int)
    for r in pieces:
        rows[r.sequence_id >> 32] += r.start == 0
    assert sum(rows.values()) == 120 and len(rows) >= 8 and max(rows.values()) <= 30


def test_related_units_meet_over_shards(spark):
    """Units of one topic lie in one shard, however many shards there are."""
    rng = random.Random(8)
    topics = [words(rng, 6, "abcdefghijklmnopqrstuvwxyz") for _ in range(60)]
    texts = [words(rng, 20, "abc") + " " + topics[i % 60] + " " + words(rng, 20, "abc") for i in range(600)]
    shard = {r.doc_id - 100: r.sequence_id >> 32 for r in P.pack(docs(spark, texts), WORDS, 256, shard_units=30).collect() if r.start == 0}
    assert len(shard) == 600 and len(set(shard.values())) >= 10
    pairs = [shard[i] == shard[j] for i in range(600) for j in range(i + 60, 600, 60)]
    assert sum(pairs) > 0.8 * len(pairs)


def test_all_ids_of_a_seed_are_asked():
    """A neighbour that shares only the seed's commoner ids is found."""
    idf = np.linspace(9.0, 1.0, 1 << 16)
    tails = [np.arange(100, dtype="<u2"), np.arange(30, dtype="<u2"), np.arange(60, 100, dtype="<u2")]
    index = P._Index(tails, idf, 60.0)
    assert set(index.neighbours(0, np.zeros(3, bool), 64).tolist()) == {1, 2}


def test_common_ids_have_a_row_of_weights():
    """Scores of ids with a row and of ids with postings add up to BM25, and neither is lost."""
    rng = np.random.default_rng(5)
    tails = [np.concatenate([rng.integers(0, 12, 30), rng.integers(100, 3000, int(rng.integers(1, 60)))]).astype("<u2") for _ in range(600)]
    idf, mean = rng.random(1 << 16) + 0.1, 60.0
    index = P._Index(tails, idf, mean)
    assert 10 <= len(index.common) <= 4 * np.mean([len(t) for t in index.terms])
    sets = [dict(zip(*map(np.ndarray.tolist, np.unique(t, return_counts=True)))) for t in tails]
    assert [t.tolist() for t in index.terms] == [list(s) for s in sets]
    for seed in range(0, 600, 50):
        score = [sum(idf[t] * s[t] * (P.K1 + 1) / (s[t] + P.K1 * (1 - P.B + P.B * len(tail) / mean)) for t in sets[seed] if t in s)
                 for s, tail in zip(sets, tails)]
        score[seed] = -1.0
        found = index.neighbours(seed, np.zeros(600, bool), 64)
        assert np.allclose(np.array(score)[found], sorted(score, reverse=True)[:64], rtol=1e-5)
