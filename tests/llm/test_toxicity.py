import random

import numpy as np
import pytest

from llm_tables import docs, edge_rows, frame, words
from qtrail.llm import toxicity as T

INSULTS = ["idiot", "moron", "worthless", "scumbag"]
STEM = ["gruntz" + s for s in ("a", "el", "ig", "os", "um", "ent", "ist", "er", "o", "in")]


def sentence(rng, bad=None):
    w = words(rng, 12).split()
    if bad:
        w[rng.randrange(12)] = bad
    return " ".join(w) + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts, marks = [], []
    for i in range(720):
        toxic = i % 6 == 0
        bad = rng.choice(INSULTS + STEM[:6]) if toxic else None
        texts.append("\n".join([sentence(rng), sentence(rng, bad), sentence(rng)]))
        marks.append((100 + i, 1, int(toxic)))
    labels = spark.createDataFrame(marks + [(None, 1, 1), (100, 1, 1), (9999, 0, None)], "doc_id bigint, quality int, toxic int")
    return T.fit(T.training_rows(docs(spark, texts), labels, T.F.lit(True)))


def test_finds_insults_and_their_variants(spark, model):
    rng = random.Random(2)
    bad = ["idiot", "IDIOT!", "i d i o t", "i.d.i.o.t", "id*iot", "idxiot", "worthlesss", "m-o-r-o-n", *STEM[6:]]
    texts = [sentence(rng) + " " + sentence(rng, b) for b in bad] + [sentence(rng) + "\n" + sentence(rng) for _ in range(60)]
    got = {r.doc_id: r for r in T.toxicity(docs(spark, texts), model).collect()}
    missed = [b for i, b in enumerate(bad) if not got[100 + i].predicted]
    wrong = [i for i in range(len(bad), len(texts)) if got[100 + i].predicted]
    assert not missed and not wrong
    assert all(0.0 <= r.score <= 1.0 for r in got.values())


def test_edges(spark, model):
    table = frame(spark, edge_rows())
    got = T.toxicity(table, model).collect()
    assert len(got) == table.count()
    assert {r.predicted for r in got if r.doc_id in (1, 2, 3, 8)} == {0}
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert T.toxicity(frame(spark, []), model).collect() == []
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert T.fit(T.training_rows(table, none, T.F.lit(True))) is None
    assert {r.score for r in T.toxicity(table, None).collect()} == {0.0}


def kernel(a, b):
    """Common triples by plain enumeration, weighted and normalised."""
    def weights(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + T.SPAN)):
                for k in range(j + 1, min(len(w), i + T.SPAN)):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0.0) + T.DECAY ** (k - i + 1)
        return out
    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(t, 0.0) for t, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_against_enumeration():
    book = ["idiot", "idxiot", "it", "worthless", "a", "stateless"]
    columns = np.unique(T.features(book)[1])
    rows = T.dense(book, columns).astype(float)
    for i, a in enumerate(book):
        for j, b in enumerate(book):
            assert abs(rows[i] @ rows[j] - kernel(a, b)) < 1e-5


def test_weak_words_add_up(spark):
    """Words that clean texts hold as well, but fewer of them, tell together."""
    rng = random.Random(7)
    weak = ["brulk" + s for s in ("a", "el", "ig", "os", "um", "ent", "ist", "er", "o", "in", "ate", "ol", "esk", "un", "ar", "id")]

    def text(count, choice):
        found = [sentence(rng, rng.choice(choice)) for _ in range(count)] + [sentence(rng) for _ in range(6 - count)]
        rng.shuffle(found)
        return "\n".join(found)

    counts = [rng.choice((3, 4, 5)) if i % 8 == 0 else rng.choice((0, 0, 0, 1, 2)) for i in range(800)]
    labels = spark.createDataFrame([(100 + i, 1, int(n > 2)) for i, n in enumerate(counts)], "doc_id bigint, quality int, toxic int")
    model = T.fit(T.training_rows(docs(spark, [text(n, weak[:12]) for n in counts]), labels, T.F.lit(True)))
    held_out = [0, 1, 2, 3, 4, 5] * 20
    got = {r.doc_id: r.predicted for r in T.toxicity(docs(spark, [text(n, weak[6:]) for n in held_out]), model).collect()}
    wrong = [n for i, n in enumerate(held_out) if got[100 + i] != int(n > 2)]
    assert len(wrong) <= 6, wrong
