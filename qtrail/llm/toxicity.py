"""Operator 5: toxicity by a subsequence string kernel and a linear machine on
Nyström features.

The kernel of two words is the normalised gap-weighted subsequence kernel of
order 3: it counts the common character triples, in order but with gaps inside a
span of ``SPAN`` characters, each weighted ``DECAY`` per character spanned.  A word
is read between boundary marks, in lower case, with only its letters ("id*ot",
"i.d.i.o.t"); a run of single letters ("i d i o t") is also read as one word.  So
gapped and inserted characters keep most of an insult's triples.

Two machines are trained, for words that each tell alone and for words that tell
together.  Training data are labelled texts and their sentences (a sentence
inherits its text's label); evidence is counted on the runs of ``GRAM`` characters
of the words, and a run counts if chance alone gives that much with a probability
of e^-``EVIDENCE`` over all runs:

- alone: a run that toxic and (nearly) no clean sentences hold;
- together: a run that is more frequent in toxic texts than in clean ones, however
  many clean ones hold it (a text counts at most ``OFTEN`` occurrences, so that no
  single text makes evidence), also by the words that hold no run of more evidence.

The words of such runs are the positives.  A bounded, documented choice of words
(``POSITIVES`` with the most evidence, for the second machine run by run;
``NEGATIVES`` of the others, for the second machine also the others that its first
fit takes for positive) trains a machine.  Some of them are the landmarks:
K(landmarks)^-1/2 maps the kernel row of a word to Nyström features, on which a
squared-hinge support vector machine is fitted.  As the decision is linear in the
kernel it folds into one weight per triple, so a new word costs one look-up per
triple and machine.

A text is as toxic as its worst word by the first machine, or as the sum of all its
words' decisions by the second (each between 0 and 1 above a floor), whichever is
further beyond its cut.  Cuts are calibrated on whole labelled texts (a second pass
over a bounded sample), each with the fewest errors: the first a quarter up the
best range, as altered insults score between clean words and the insults
themselves; the second, and its floor, on the texts that the first leaves, in the
middle of the best range.  Score = logistic of the distance to the cut.

Defined results: a null, empty or letterless text gets the lowest score of all,
label 0; without toxic or without clean labelled texts every score is 0; repeated
rows and null ids are scored each for itself; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LONG_WORD, Budget, U64, drop_stored, mix, per_worker, sample_by_hash, stored

SPAN, DECAY = 5, 0.6
#: triples are numbered by a hash of so many bits
BITS = 20
#: bounds of the training choice
TRAIN_DOCS = 20_000
POSITIVES, NEGATIVES, LANDMARKS = 1500, 4500, 400
GRAM, GRAMS, EVIDENCE = 5, 5000, 2.0
OFTEN, LIFT = 3, 2.0
FLOORS, STEPS, MOST = (0.0, 0.25, 0.5), 10, 100  # of the summed decisions: floors tried, bins of 1, largest sum told apart
COST, ROUNDS = 10.0, 12
LONGEST = 40  # a longer word is read in overlapping parts of this length
REMEMBERED = 96 << 20  # bytes that a worker's tokens may take
STEEPNESS, CUT = 6.0, 0.25
LOWEST = -4.0

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]*")
_SINGLES = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")


def read(token: str) -> list[str]:
    """The words of a lower-case token: its letters, also part by part where other characters part them."""
    if _PLAIN.fullmatch(token):
        return [token.rstrip(".,;:!?")]
    parts = _LETTERS.findall(token)
    return [] if not parts else ["".join(parts)] if len(parts) == 1 else ["".join(parts), *(p for p in parts if len(p) > 2)]


def spelled(text: str) -> list[str]:
    """Runs of single letters as words."""
    return ["".join(m.split()) for m in _SINGLES.findall(text)]


def sentence_words(text: str) -> list[set[str]]:
    """The words of each sentence."""
    return [{w for t in s.split() for w in read(t)}.union(spelled(s)) for s in _SENTENCE.split(text.lower()) if s]


@functools.lru_cache(30_000)
def _runs(word: str) -> tuple[str, ...]:
    word = f"^{word}$"
    return tuple({word[i:i + GRAM] for i in range(len(word) - GRAM + 1)})


def runs(word: str) -> tuple[str, ...]:
    """The runs of ``GRAM`` characters of a word between its marks; long words are not remembered."""
    return _runs(word) if len(word) <= LONG_WORD else _runs.__wrapped__(word)


def _counts(batches):
    """Words with the toxic and clean sentences they are in, and runs with their
    occurrences in toxic and clean texts, at most ``OFTEN`` a text."""
    for batch in batches:
        found = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for words in sentence_words(text or ""):
                found[0][toxic].update(words)
            text, held = (text or "").lower(), Counter()
            for word, n in Counter([*(w for t in text.split() for w in read(t)), *spelled(text)]).items():
                for run in runs(word):
                    held[run] += n
            found[1][toxic].update({run: min(n, OFTEN) for run, n in held.items()})
        for is_run, (clean, toxic) in enumerate(found):
            keys = list(clean | toxic)
            yield pa.RecordBatch.from_arrays([pa.array([bool(is_run)] * len(keys)), pa.array(keys, pa.string()),
                                              pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
                                             names=["is_run", "key", "toxic", "clean"])


_GAPS = [(i, j) for i in range(1, SPAN) for j in range(i + 1, SPAN)]  # places of the 2nd and 3rd character after the 1st
_FACTORS = mix(np.arange(11, 14, dtype=U64)) | U64(1)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number, weight) of every triple of each word, one row per word; weight 0 pads.

    The weights of a row have norm 1 when equal triples are summed."""
    marked = [f"\x02{w[:LONGEST]}\x03" for w in words]
    width = max(map(len, marked), default=2) + SPAN
    flat = np.zeros((len(marked), width), U64)
    lengths = np.array([len(m) for m in marked])
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    flat[np.arange(width)[None, :] < lengths[:, None]] = chars
    starts = width - SPAN
    numbers = np.empty((len(marked), starts * len(_GAPS)), np.int64)
    weights = np.zeros_like(numbers, dtype=np.float64)
    first = flat[:, :starts] * _FACTORS[0]
    for k, (i, j) in enumerate(_GAPS):
        third = flat[:, j:j + starts]
        code = mix(first + flat[:, i:i + starts] * _FACTORS[1] + third * _FACTORS[2]) >> U64(64 - BITS)
        part = slice(k * starts, (k + 1) * starts)
        numbers[:, part] = code
        weights[:, part] = np.where(third > 0, DECAY ** (j + 1), 0.0)
    return numbers, weights


def features(words: list[str]):
    """The normalised triple weights of words as (row, number, weight), equal triples summed."""
    numbers, weights = triples(words)
    row = np.repeat(np.arange(len(words)), numbers.shape[1])
    key = (row << BITS) + numbers.ravel()
    used = weights.ravel() > 0
    key, at = np.unique(key[used], return_inverse=True)
    value = np.bincount(at, weights.ravel()[used], len(key))
    row = key >> BITS
    norm = np.sqrt(np.bincount(row, value ** 2, len(words)))
    return row, key & ((1 << BITS) - 1), value / norm[row]


def dense(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Rows of normalised triple weights over the given triple numbers."""
    out = np.zeros((len(words), len(columns)), np.float32)
    row, number, value = features(words)
    at = np.searchsorted(columns, number)
    at[at == len(columns)] = 0
    hit = columns[at] == number
    out[row[hit], at[hit]] = value[hit]
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (bias last) of an L2 squared-hinge machine, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        w = np.linalg.solve(a.T @ x[inside] + np.eye(x.shape[1]), a.T @ y[inside])
    return w


def train(positives: list[str], negatives: list[str]) -> tuple[np.ndarray, float]:
    """(weight per triple number, bias) of the machine folded into the kernel's triples."""
    step = lambda words, n: words[::max(1, -(-len(words) // n))]
    landmarks = step(positives, LANDMARKS // 2) + step(negatives, LANDMARKS // 2)
    columns = np.unique(features(landmarks)[1])
    marks = dense(landmarks, columns).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-6
    nystroem = vectors[:, kept] / np.sqrt(values[kept])  # kernel row -> features
    words = positives + negatives
    rows = np.vstack([dense(words[a:a + 500], columns) @ marks.T for a in range(0, len(words), 500)]) @ nystroem
    y = np.repeat([1.0, -1.0], [len(positives), len(negatives)])
    cost = np.where(y > 0, COST * len(words) / (2 * len(positives)), COST * len(words) / (2 * len(negatives)))
    w = fit_machine(rows, y, cost)
    weight = np.zeros(1 << BITS, np.float32)
    weight[columns] = marks.T @ (nystroem @ w[:-1])
    return weight, float(w[-1])


class Model:
    """Machines ``alone`` and ``together``: a (weight, bias) each, None without positives."""

    def __init__(self, alone, together=None, cut: float = 0.0, floor: float = 0.0, sum_cut: float = math.inf):
        self.machines = [m or (None, LOWEST) for m in (alone, together)]
        self.cut, self.floor, self.sum_cut = cut, floor, sum_cut

    @property
    def key(self) -> tuple:
        parts = [(0.0 if w is None else float(w.sum(dtype=np.float64)), bias) for w, bias in self.machines]
        return *parts, self.cut, self.floor, self.sum_cut

    def decisions(self, words: list[str]) -> np.ndarray:
        """A row for each machine, a column for each word."""
        out = np.full((2, len(words)), LOWEST)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(words), 4000):  # words of like length together
            at = order[a:a + 4000]
            numbers, weights = triples([words[i] for i in at])
            # a triple found twice in one word is rare: the norm sums it once each
            norm = np.sqrt((weights ** 2).sum(axis=1))
            for k, (weight, bias) in enumerate(self.machines):
                if weight is not None:
                    out[k, at] = (weight[numbers] * weights).sum(axis=1) / norm + bias
        return out


class Scorer:
    """Worst and summed decisions of texts; a worker remembers the decisions of tokens."""

    def __init__(self, model: Model):
        self.model, self.known, self.told, self.budget = model, {}, {}, Budget(REMEMBERED)

    def _learn(self, tokens) -> None:
        readings = [read(t) for t in tokens]
        words = list({w[a:a + LONGEST] for r in readings for w in r for a in range(0, max(len(w) - LONGEST // 2, 1), LONGEST // 2)})
        found = [dict(zip(words, d)) for d in self.model.decisions(words).tolist()]
        worst = lambda w, k: max(found[k][w[a:a + LONGEST]] for a in range(0, max(len(w) - LONGEST // 2, 1), LONGEST // 2))
        for t, r in zip(tokens, readings):
            self.known[t] = max((worst(w, 0) for w in r), default=LOWEST)
            told = [max(worst(w, 1), 0.0) for w in r]
            if any(told):  # the others add nothing
                self.told[t] = [max(sum(self._above(d, f) for d in told[1:]), self._above(told[0], f)) for f in FLOORS]

    @staticmethod
    def _above(decision: float, floor: float) -> float:
        return min(max(decision - floor, 0.0) / (1 - floor), 1.0)

    def figures(self, texts: list[str], floors=FLOORS) -> tuple[list[float], list[list[float]]]:
        """Worst decision of each text, and for each of the floors the texts' sums."""
        texts = [t.lower() for t in texts]
        tokens = [t.split() + spelled(t) for t in texts]
        new = set().union(*tokens).difference(self.known)
        if new:
            self._learn(sorted(new))
        worst = [max(map(self.known.__getitem__, t), default=LOWEST) for t in tokens]
        told = [[self.told[w] for w in t if w in self.told] for t in tokens]
        sums = [[sum(x[k] for x in t) for t in told] for k in map(FLOORS.index, floors)]
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
                self.told.pop(w, None)
        if self.budget.spent(new):
            self.known, self.told = {}, {}
        return worst, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        worst, (sums,) = self.figures(texts, [self.model.floor])
        distance = np.maximum(np.array(worst) - self.model.cut, np.array(sums) - self.model.sum_cut)
        return 1.0 / (1.0 + np.exp(-np.clip(STEEPNESS * distance, -40, 40)))


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of ``model``, kept over its tasks."""
    return per_worker("toxicity", model.key, lambda: Scorer(model))


def fit(labelled: DataFrame):
    """The model, broadcast, of rows (doc_id, text, toxic); None if a label is missing."""
    spark = labelled.sparkSession
    counted, path = stored(labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
                           .mapInArrow(_counts, "is_run boolean, key string, toxic bigint, clean bigint")
                           .groupBy("is_run", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "word-counts")
    counts = counted.filter("not is_run and length(key) > 1").select(F.col("key").alias("word"), "toxic", "clean")
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1]:
        return None
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    each = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - GRAM + 1),
                                                  lambda i: F.substring(marked, i, F.lit(GRAM))))).alias("gram")
    grams = counts.filter(F.length("word") >= GRAM - 2).select("word", "toxic", "clean", each)
    seen = counts.filter("clean > 0")
    common = [r.word for r in seen.orderBy(F.desc("clean"), "word").limit(NEGATIVES // 3).collect()]
    others = [r.word for r in sample_by_hash(seen.select("word"), "word", NEGATIVES - len(common), 5).collect()]
    negatives = list(dict.fromkeys(common + others))
    alone = _alone(grams, total, negatives)
    together = _together(spark, counted.filter("is_run").select(F.col("key").alias("gram"), "toxic", "clean"), grams, total, seen, negatives)
    drop_stored(spark, path)
    if not alone and not together:
        return None
    model = Model(alone, together)
    _calibrate(model, labelled)
    return spark.sparkContext.broadcast(model)


def _alone(grams: DataFrame, total, negatives: list[str]):
    """The machine of words with a run that nearly no clean sentence holds."""
    chance = -math.log(total[0] / (total[0] + total[1]))  # evidence of one toxic sentence
    telling = (grams.groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
               .withColumn("evidence", F.col("t") * chance))
    kinds = telling.count()
    telling = (telling.filter((F.col("c") * 50 <= F.col("t")) & (F.col("evidence") > math.log(max(kinds, 1)) + EVIDENCE))
               .orderBy(F.desc("evidence"), "gram").limit(GRAMS).select("gram", "evidence"))
    speaking = (grams.filter(F.col("clean") * 50 <= F.col("toxic")).join(F.broadcast(telling), "gram")  # at most GRAMS rows
                .groupBy("word").agg(F.max("evidence").alias("evidence"), F.max("toxic").alias("toxic")))
    positives = [r.word for r in speaking.orderBy(F.desc("evidence"), F.desc("toxic"), "word").limit(POSITIVES).collect()]
    negatives = [w for w in negatives if w not in set(positives)]
    return train(positives, negatives) if positives and negatives else None


def _together(spark, runs_held: DataFrame, grams: DataFrame, total, seen: DataFrame, negatives: list[str]):
    """The machine of words with a run that toxic texts hold more often than clean ones."""
    all_toxic, all_clean, kinds = runs_held.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).first()
    if not all_toxic or not all_clean:
        return None

    def with_evidence(counts, whole_toxic, whole_clean):
        t, c = F.col("toxic"), F.col("clean")
        share = (t + c) / F.lit(float(whole_toxic + whole_clean))
        part = lambda n, whole: F.when(n > 0, n * F.log(n / (share * F.lit(float(whole))))).otherwise(0.0)
        return (counts.filter(t / F.lit(float(whole_toxic)) > LIFT * c / F.lit(float(whole_clean)))
                .withColumn("evidence", part(t, whole_toxic) + part(c, whole_clean)).filter(F.col("evidence") > math.log(kinds) + EVIDENCE))

    telling = with_evidence(runs_held, all_toxic, all_clean).orderBy(F.desc("evidence"), "gram").limit(GRAMS).select("gram", "evidence")
    held = (grams.join(F.broadcast(telling), "gram")  # at most GRAMS rows
            .groupBy("word").agg(F.max(F.struct("evidence", "gram")).alias("best"), F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
            .select("word", "toxic", "clean", F.col("best.gram").alias("gram")))
    # a run must also tell by the words that hold no better one: "achli" does not if it is only "^achl" that tells
    own = held.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("size"))
    own = with_evidence(own, *total).select("gram", "size").collect()
    holding = {r.gram for r in own}
    # a few words of every run before many of one: a hash between 0 and the run's number of words is about a place
    sizes = spark.createDataFrame(own, "gram string, size bigint")
    place = F.pmod(F.xxhash64("word", F.lit(7)), F.lit(1 << 20)) * F.col("size")
    positives = [r.word for r in held.filter("toxic > 0").join(F.broadcast(sizes), "gram").orderBy(place, "word")
                 .limit(POSITIVES).select("word").collect()]
    negatives = [w for w in negatives if holding.isdisjoint(runs(w))]
    if not positives or not negatives:
        return None
    # the others that are most like the positives are learnt as well
    shared = spark.sparkContext.broadcast((Model(None, train(positives, negatives)), holding))

    def nearest(batches):
        model, holding = shared.value
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if len(w) <= LONGEST and holding.isdisjoint(runs(w))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(model.decisions(words)[1])], names=["word", "decision"])

    near = (seen.select("word").mapInArrow(nearest, "word string, decision double").filter("decision > -0.5")
            .orderBy(F.desc("decision"), "word").limit(NEGATIVES // 3).collect())
    return train(positives, list(dict.fromkeys(negatives + [r.word for r in near])))


def _calibrate(model: Model, labelled: DataFrame) -> None:
    """Set the model's cuts and floor by the errors on labelled texts."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def figures(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            worst, sums = scorer.figures([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(np.floor(np.array(worst) * 100).astype(np.int32), pa.int32()),
                 *(pa.array(np.minimum(np.floor(np.array(x) * STEPS), MOST * STEPS).astype(np.int32), pa.int32()) for x in sums)],
                names=["toxic", "bin", *(f"s{k}" for k in range(len(FLOORS)))])

    names = [f"s{k}" for k in range(len(FLOORS))]
    binned = (labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
              .mapInArrow(figures, f"toxic int, bin int, {', '.join(f'{x} int' for x in names)}")
              .groupBy("toxic", "bin", *names).count().toPandas())  # no more rows than the bounded sample has

    def errors(rows, by):
        """Bins, and the errors of a cut at the lower edge of each."""
        found = rows.pivot_table(index=by, columns="toxic", values="count", aggfunc="sum", fill_value=0).reindex(columns=[0, 1], fill_value=0)
        found = found.sort_index()
        return found.index.to_numpy(), found[1].cumsum().shift(fill_value=0).to_numpy() + found[0].to_numpy()[::-1].cumsum()[::-1]

    model.cut = math.inf
    if model.machines[0][0] is not None:
        bins, wrong = errors(binned, "bin")
        best = np.flatnonzero(wrong == wrong.min())
        low = bins[best[0]] if best[0] == 0 else bins[best[0] - 1] + 1
        model.cut = float(low + (bins[best[-1]] - low) * CUT) / 100
    left = binned[binned["bin"] < model.cut * 100]
    fewest = left.loc[left["toxic"] == 1, "count"].sum()  # without any sum
    for floor, name in zip(FLOORS, names):
        bins, wrong = errors(left, name) if len(left) else ([], np.empty(0))
        if len(wrong) > 1 and wrong[1:].min() < fewest:
            fewest = wrong[1:].min()
            best = 1 + np.flatnonzero(wrong[1:] == fewest)[0]
            model.floor, model.sum_cut = floor, float(bins[best - 1] + 1 + bins[best]) / 2 / STEPS


def score_column(model):
    """A column function text -> score in [0, 1]."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scorer(model.value).scores([t or "" for t in texts]))

    return score if model is not None else (lambda _: F.lit(0.0))


def training_rows(docs: DataFrame, labels: DataFrame, usable) -> DataFrame:
    """doc_id, text, toxic of at most TRAIN_DOCS labelled rows of each label (smallest hash of the id).

    ``usable`` is a condition on ``doc_id``."""
    given = labels.filter("doc_id is not null and toxic in (0, 1)").filter(usable).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    chosen = sample_by_hash(given.filter("toxic = 1"), "doc_id", TRAIN_DOCS, 6).union(
        sample_by_hash(given.filter("toxic = 0"), "doc_id", TRAIN_DOCS, 6))
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")


def toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``, one pass without a shuffle."""
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), score_column(model)(F.col(text_col).cast("string")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
