import random
import re
from collections import Counter

import numpy as np

from llm_tables import docs, edge_rows, frame, words
from qtrail.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_base_figures(spark):
    rng = random.Random(1)
    line = words(rng, 9)
    texts = ["\n".join([line, words(rng, 5), line, " ", line]), " ".join(["a b c d e f g h i"] * 4), "# * $ % & | < > x" * 3,
             "non breaking blanks stay in words \x1c\x85", words(rng, 300) + " " + words(random.Random(2), 12) * 2]
    table = docs(spark, texts).union(frame(spark, edge_rows()))
    got = sorted((tuple(r) for r in Q.quality(table, labels(spark, [])).drop("log_ratio", "threshold").collect()), key=str)
    expected = [(r.doc_id, *brute(r.text), not brute(r.text)[-1]) for r in table.select("doc_id", "text").collect()]
    assert got == sorted(expected, key=str)  # without labels the base rules alone decide


def test_ratio_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(Q, "KEEP_SHARE", 0.9)
    rng = random.Random(3)
    clean = [words(rng, 40) for _ in range(60)]
    junk = [" ".join(w + "&&&" for w in words(rng, 40).split()) for _ in range(20)]
    table = docs(spark, clean + junk)
    marks = labels(spark, [(100 + i, 1, 0) for i in range(0, 60, 2)] + [(160, 0, 0), (None, 1, 0), (100, 1, 0)])
    got = {r.doc_id: r for r in Q.quality(table, marks).collect()}
    assert all(got[100 + i].kept for i in range(1, 60, 2))
    assert not any(got[160 + i].kept for i in range(20))
    # the same multinomials by plain counting
    fit = {r.doc_id for r in table.selectExpr("doc_id", "pmod(xxhash64(doc_id, 3), 2) = 0 f").collect() if r.f and r.doc_id < 160 and r.doc_id % 2 == 0}
    raw, target = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    for i, t in enumerate(clean + junk):
        for b in Q.gram_buckets(t.encode(), Q.word_hashes(t.encode())):
            raw[b] += 1
            target[b] += 100 + i in fit
    weight, at = np.empty(Q.BUCKETS), 0
    for size in Q.KINDS:
        part = slice(at, at + size)
        weight[part] = np.log(target[part] / target[part].sum()) - np.log(raw[part] / raw[part].sum())
        at += size
    for i, t in enumerate(clean + junk):
        expected = weight[Q.gram_buckets(t.encode(), Q.word_hashes(t.encode()))].mean()
        assert abs(got[100 + i].log_ratio - expected) < 1e-9


def test_empty(spark):
    assert Q.quality(frame(spark, []), labels(spark, [])).collect() == []


def test_threshold_follows_the_spread(spark):
    """The threshold lies below the target by the order of its spread, whatever the scale."""
    rng = np.random.default_rng(9)
    for middle, spread in ((0.03, 0.01), (0.5, 0.2)):
        ratios = rng.normal(middle, spread, 2000).tolist()
        target = spark.createDataFrame([(x, False) for x in ratios] + [(-5.0, True)], "log_ratio double, base_failed boolean")
        assert middle - 10 * spread < Q._threshold(target) < middle - 3 * spread


def test_every_trusted_text_counts(spark):
    """24,000 trusted texts: the counts come from all of the fit half, the threshold from all of the other."""
    n = 24_000
    table = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 97, ' of ', id % 89, ' ', id % 83) as text").repartition(4)
    marks = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    got = Q.quality(table.unionByName(spark.sql("select cast(null as bigint) doc_id, 'w1 of' text")), marks)
    rows = {r.doc_id: r for r in got.filter("doc_id is null or doc_id < 200").collect()}
    fit = [r.doc_id for r in table.filter("pmod(xxhash64(doc_id, 3), 2) = 0").select("doc_id").collect()]
    assert 11_000 < len(fit) < 13_000
    text = lambda i: f"w{i % 97} of {i % 89} {i % 83}".encode()
    buckets = [Q.gram_buckets(text(i), Q.word_hashes(text(i))) for i in range(n)]
    null = Q.gram_buckets(b"w1 of", Q.word_hashes(b"w1 of"))
    raw = 1.0 + np.bincount(np.concatenate([*buckets, null]), minlength=Q.BUCKETS)
    target = 1.0 + np.bincount(np.concatenate([buckets[i] for i in fit]), minlength=Q.BUCKETS)
    kind = np.repeat(np.arange(len(Q.KINDS)), Q.KINDS)
    weight = np.log(target / np.bincount(kind, target)[kind]) - np.log(raw / np.bincount(kind, raw)[kind])
    assert len(rows) == 201
    assert all(abs(rows[i].log_ratio - weight[buckets[i]].mean()) < 1e-9 for i in range(200))


def test_threshold_judges_the_whole_held_out_half(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "_threshold", lambda target: seen.append({r.doc_id for r in target.collect()}) or Q.LOW)
    table = spark.range(21_000).selectExpr("id as doc_id", "concat('w', id % 97) as text").unionByName(spark.sql("select cast(null as bigint) doc_id, 'w1' text"))
    marks = spark.range(21_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    Q.quality(table, marks)
    assert seen == [{r.doc_id for r in table.filter("doc_id is not null and pmod(xxhash64(doc_id, 3), 2) = 1").collect()}]
