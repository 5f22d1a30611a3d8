import math
import random

import numpy as np
import pytest

from llm_tables import docs, edge_rows, frame
from qtrail.llm import language_id as L

SYLLABLES = {"en": ["the", "ing", "er", "and", "th", "on"], "de": ["ich", "sch", "ung", "ein", "zu", "ä"], "fr": ["eau", "oi", "é", "que", "ment"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang, "s", 1, "r", 1, "s", "b") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    return frame(spark, rows + [(500, None, "en", "s", 1, "r", 1, "s", "b"), (501, "keine Sprache", None, "s", 1, "r", 1, "s", "b")])


def test_held_out_accuracy_and_rejection(spark, training):
    rng = random.Random(2)
    model = L.fit(training)
    langs = ["en", "de", "fr"] * 20
    table = docs(spark, [text(rng, g, 30).upper() for g in langs])
    got = {r.doc_id: r for r in L.identify(table, model).collect()}
    assert [got[100 + i].lang_pred for i in range(60)] == langs
    assert not any(r.rejected for r in got.values())
    assert all(0.0 <= r.score <= 1.0 for r in got.values())
    both = text(rng, "en", 40) + " " + text(rng, "fr", 40)
    odd = " ".join("".join(rng.choice("qxwvkjbyzp") for _ in range(7)) for _ in range(60))
    one, two = sorted(L.identify(docs(spark, [both, odd]), model).collect(), key=lambda r: r.doc_id)
    assert not one.rejected and two.rejected


def test_edges(spark, training):
    model = L.fit(training)
    table = frame(spark, edge_rows())
    got = L.identify(table, model).collect()
    assert len(got) == table.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 8):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in SYLLABLES
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    assert L.identify(frame(spark, []), model).collect() == []
    assert L.fit(frame(spark, edge_rows())) is None
    assert {r.lang_pred for r in L.identify(table, None).collect()} == {"und"}


def test_probabilities_sum_to_one():
    """Interpolated Kneser-Ney over the observed alphabet leaves only the floor's mass."""
    rng = random.Random(3)
    counts = {}
    for word in text(rng, "de", 300).split():
        padded = f" {word} "
        for end in range(2, len(padded) + 1):
            for k in range(1, min(L.ORDER, end) + 1):
                gram = padded[end - k:end]
                counts[gram] = counts.get(gram, 0) + 1
    prob, weight, floor = L.kneser_ney(counts)
    alphabet = [g for g in counts if len(g) == 1]

    def p(history, c):
        if not history:
            return prob.get(c, floor)
        if history + c in prob:
            return prob[history + c]
        return weight.get(history, 1.0) * p(history[1:], c)
    for history in [" ", "sc", "ein", " zu"]:
        assert abs(sum(p(history, c) for c in alphabet) - 1.0) < 1e-2


def test_word_scores_match_plain_look_ups():
    rng = random.Random(4)
    counts = {}
    for lang in ("en", "de"):
        found = counts.setdefault(lang, {})
        for word in text(rng, lang, 200).split():
            padded = f" {word} "
            for end in range(2, len(padded) + 1):
                for k in range(1, min(L.ORDER, end) + 1):
                    found[padded[end - k:end]] = found.get(padded[end - k:end], 0) + 1
    model = L.Model(counts)
    words = ["the", "sch", "unseenword", "é", "einzu", "a"]
    got = model.word_scores(words)
    for j, lang in enumerate(model.langs):
        prob, weight, floor = L.kneser_ney(counts[lang])

        def p(history, c):
            gram = history + c
            if gram in prob:
                return math.log(prob[gram])
            return math.log(floor) if not history else math.log(weight.get(history, 1.0)) + p(history[1:], c)
        for i, w in enumerate(words):
            padded = f" {w} "
            total = sum(p(padded[max(0, e - L.ORDER + 1):e], padded[e]) for e in range(1, len(padded)))
            assert np.isclose(got[i, j], total, rtol=1e-4)
