"""Operator 4: language identification by interpolated Kneser-Ney character models.

One character model of order ``ORDER`` per language over lower-case words
(letters only; a word begins and ends with a blank, and history starts at its
first blank).  All languages' n-grams lie in one sorted array of 64-bit hashes
with a column of log probabilities and one of back-off weights per language, so
a look-up is a binary search.  A text's language has the lowest cross-entropy
per character.  A text is *rejected* when its fit (the cross-entropy with every
word charged to its best language, so a text in two languages fits) exceeds the
language's calibrated limit.

Fitting uses at most about ``FIT_DOCS`` and ``CALIBRATE_DOCS`` rows of each
language (smallest hash of the id below a share that the language's row count
sets), a documented bound; words and n-grams are counted by Spark over whole
texts.  Scoring covers every row and needs no shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0
and are rejected; ties go to the language that sorts first; an empty or wholly
unlabelled training part gives ``und`` for every row; repeated rows and null
ids are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LONG_WORD, Budget, U64, mix, per_worker

ORDER = 4
FIT_DOCS = 3000
CALIBRATE_DOCS = 1500
#: limit of a language: this quantile of the calibration texts' cross-entropy plus this margin (nats a character)
QUANTILE, MARGIN = 0.999, 1.0
#: texts with fewer letters get a wider limit
SHORT_MARGIN = 6.0
UNDETERMINED = "und"
REMEMBERED, SHORT = 64 << 20, 48  # bytes that a worker's words may take
_FACTORS = mix(np.arange(1, ORDER + 1, dtype=U64)) | U64(1)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; digits and number signs (½, ², Ⅷ) are none, though the pattern takes them for word characters."""
    return ["".join(filter(str.isalpha, w)) if not w.isalpha() else w for w in _WORD.findall(text.lower()) if any(map(str.isalpha, w))]


def _word_counts(batches):
    """(language, word, count) of a partition's texts, summed batch by batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            found.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(lang, w, c) for lang, words in found.items() for w, c in words.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def _gram_counts(batches):
    """(language, n-gram, count) of word counts, orders 1 to ORDER."""
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            padded = f" {word} "
            for end in range(2, len(padded) + 1):
                for k in range(1, min(ORDER, end) + 1):
                    found[lang, padded[end - k:end]] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                                          pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])


def kneser_ney(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, float], float]:
    """(probability of each stored n-gram, back-off weight of each history, floor).

    Interpolated with one absolute discount per order; below the highest order an
    n-gram counts once for each character seen before it, unless it starts a
    word (then nothing can come before it and its own count holds)."""
    by_order: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
    for gram, n in counts.items():
        by_order[len(gram)][gram] = n
    used = [dict() for _ in range(ORDER + 1)]
    used[ORDER] = by_order[ORDER]
    for k in range(ORDER - 1, 0, -1):
        continued = Counter(gram[1:] for gram in by_order[k + 1])
        used[k] = {g: (n if g[0] == " " and k > 1 else continued.get(g, 0) or n) for g, n in by_order[k].items()}
    prob: dict[str, float] = {}
    weight: dict[str, float] = {}
    total = sum(used[1].values())
    floor = 1.0 / (total + 1) / 1000
    for gram, n in used[1].items():
        prob[gram] = (n + 0.01) / (total + 0.01 * len(used[1]) + 1)
    for k in range(2, ORDER + 1):
        ones = sum(1 for n in used[k].values() if n == 1)
        twos = sum(1 for n in used[k].values() if n == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        mass, kinds = Counter(), Counter()
        for gram, n in used[k].items():
            mass[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        for history, m in mass.items():
            weight[history] = discount * kinds[history] / m
        for gram, n in used[k].items():
            lower = prob.get(gram[1:], floor)
            prob[gram] = max(n - discount, 0.0) / mass[gram[:-1]] + weight[gram[:-1]] * lower
    return prob, weight, floor


class Model:
    """Sorted hash array with log probabilities and back-off weights per language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        built = [kneser_ney(counts[lang]) for lang in self.langs]
        grams = sorted({g for prob, weight, _ in built for g in (*prob, *weight)})
        codes = self._codes(grams)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.prob = np.full((len(grams), len(self.langs)), np.nan, np.float32)
        self.weight = np.zeros((len(grams), len(self.langs)), np.float32)
        at = {g: i for g, i in zip(grams, np.argsort(order))}
        for j, (prob, weight, _) in enumerate(built):
            for g, p in prob.items():
                self.prob[at[g], j] = math.log(p)
            for g, w in weight.items():
                self.weight[at[g], j] = math.log(w)
        self.floor = np.array([math.log(f) for _, _, f in built], np.float32)
        self.limits = np.full(len(self.langs), np.inf)

    @property
    def key(self) -> tuple:
        """Tells models apart in a worker."""
        return (*self.langs, len(self.codes), float(np.nansum(self.prob, dtype=np.float64)), *self.limits.tolist())

    @staticmethod
    def _roll(chars: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k characters up to each place of a flat array of code points."""
        h = np.zeros(len(chars), U64)
        for i in range(k):
            shifted = np.zeros(len(chars), U64)
            shifted[i:] = chars[:len(chars) - i]
            h = h + shifted * _FACTORS[i]
        return mix(h ^ U64(k))

    @classmethod
    def _codes(cls, grams: list[str]) -> np.ndarray:
        out = np.empty(len(grams), U64)
        for i, g in enumerate(grams):
            out[i] = cls._roll(np.array([ord(c) for c in g], U64), len(g))[-1]
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (its characters and the closing blank) per language."""
        text = "".join(f" {w} " for w in words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        lengths = np.array([len(w) + 2 for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(chars)) - np.repeat(starts, lengths)
        logp = np.broadcast_to(self.floor, (len(chars), len(self.langs)))
        for k in range(1, ORDER + 1):
            inside = np.flatnonzero(place >= max(k - 1, 1))  # the opening blank is given
            code = self._roll(chars, k)[inside]
            found = self._find(code)
            stored = np.where(found[:, None] >= 0, self.prob[found], np.nan)
            if k > 1:
                history = self._find(self._roll(chars, k - 1)[inside - 1])
                back = np.where(history[:, None] >= 0, self.weight[history], 0.0)
                lower = logp[inside] + back
            else:
                lower = logp[inside]
            logp = np.array(logp)
            logp[inside] = np.where(np.isnan(stored), lower, stored)
        logp[place == 0] = 0.0
        return np.add.reduceat(logp, starts, axis=0) if len(words) else np.empty((0, len(self.langs)))

    def _find(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == codes, at, -1)


class Scorer:
    """Cross-entropies of texts; a worker remembers the scores of its words."""

    def __init__(self, model: Model):
        self.model, self.known, self.table, self.size, self.budget = model, {}, None, 0, Budget(REMEMBERED)

    def _learn(self, words: set[str]) -> None:
        fresh = sorted(words)
        for a in range(0, len(fresh), 20_000):
            part = fresh[a:a + 20_000]
            scores = self.model.word_scores(part)
            if self.table is None or self.size + len(part) > len(self.table):
                grown = np.zeros((2 * (self.size + len(part)), len(self.model.langs)), np.float32)
                grown[:self.size] = 0 if self.table is None else self.table[:self.size]
                self.table = grown
            self.table[self.size:self.size + len(part)] = scores
            self.known.update(zip(part, range(self.size, self.size + len(part))))
            self.size += len(part)

    def cross_entropies(self, texts: list[str]) -> list[tuple]:
        """(cross-entropy per language, or None without a letter; fit; characters) of each text."""
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        out = []
        for words in split:
            if not words:
                out.append((None, 0.0, 0))
                continue
            places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            n = sum(map(len, words)) + len(words)
            scores = self.table[places]
            out.append((-scores.sum(axis=0, dtype=np.float64) / n, -float(scores.max(axis=1).sum(dtype=np.float64)) / n, n))
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
        if self.budget.spent(new):
            self.known, self.table, self.size = {}, None, 0
        return out


def verdict(model: Model, entropy, fit_: float, n: int) -> tuple[str, float, bool]:
    """(language, score, rejected): the score is the winner's share of
    exp(-cross-entropy * min(characters, 50)), less by how far the fit exceeds the limit."""
    if entropy is None:
        return UNDETERMINED, 0.0, True
    best = int(np.argmin(entropy))
    share = np.exp(-(entropy - entropy[best]) * min(n, 50))
    over = fit_ - model.limits[best] - SHORT_MARGIN / math.sqrt(n) if np.isfinite(model.limits[best]) else -1.0
    score = float(1.0 / share.sum()) * (math.exp(-over) if over > 0 else 1.0)
    return model.langs[best], min(max(score, 0.0), 1.0), bool(over > 0)


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of ``model``, kept over its tasks."""
    return per_worker("language", model.key, lambda: Scorer(model))


def _scored(batches, model):
    scorer = _scorer(model.value)
    for batch in batches:
        found = [verdict(scorer.model, e, f, n) + (f if e is not None else None, n)
                 for e, f, n in scorer.cross_entropies([t or "" for t in batch.column("text").to_pylist()])]
        columns = list(zip(*found)) or [[]] * 5
        kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                         names=["doc_id", "lang_pred", "score", "rejected", "fit", "n_letters"])


_SCORED = "doc_id bigint, lang_pred string, score double, rejected boolean, fit double, n_letters bigint"


def fit(training: DataFrame):
    """The model, broadcast, of rows (doc_id, text, lang); None without any."""
    spark = training.sparkSession
    labelled = training.filter("lang is not null and text is not null")
    rows = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row per language
    if not len(rows):
        return None
    span = 1 << 20
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(span))
    share = {r.lang: ((FIT_DOCS if r.n > FIT_DOCS + CALIBRATE_DOCS else 2 * r.n / 3) / r.n,
                      (CALIBRATE_DOCS if r.n > FIT_DOCS + CALIBRATE_DOCS else r.n / 3) / r.n) for r in rows.itertuples()}
    bounds = spark.createDataFrame([(k, int(span * f), int(span * (f + c)) + 1) for k, (f, c) in share.items()],
                                   "lang string, fit_below long, calibrate_below long")
    sample = (labelled.join(F.broadcast(bounds), "lang").withColumn("place", place)
              .filter(F.col("place") < F.col("calibrate_below")))
    grams = (sample.filter(F.col("place") < F.col("fit_below")).select("text", "lang")
             .mapInArrow(_word_counts, "lang string, word string, n bigint")
             .groupBy("lang", "word").agg(F.sum("n").alias("n"))
             .mapInArrow(_gram_counts, "lang string, gram string, n bigint")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())  # all of them: discounts and continuations count singletons
    counts = {lang: dict(zip(part["gram"], part["n"])) for lang, part in grams.groupby("lang")}
    if not counts:
        return None
    model = Model({k: {g: int(n) for g, n in v.items()} for k, v in counts.items()})
    shared = spark.sparkContext.broadcast(model)
    held = sample.filter(F.col("place") >= F.col("fit_below")).select("doc_id", "text")
    found = (held.mapInArrow(lambda b: _scored(b, shared), _SCORED).filter("n_letters >= 40")
             .groupBy("lang_pred").agg(F.expr(f"percentile_approx(fit, {QUANTILE}, 10000)").alias("q")).toPandas())
    limits = dict(zip(found["lang_pred"], found["q"]))
    model.limits = np.array([limits.get(lang, np.inf) + MARGIN for lang in model.langs])
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, fit, n_letters: one row per row of ``docs``."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return src.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"),
                          F.lit(None).cast("double").alias("fit"), F.lit(0).cast("bigint").alias("n_letters"))
    return src.mapInArrow(lambda b: _scored(b, model), _SCORED)


def accepted(model):
    """A column function text -> boolean: is the text's language accepted?"""
    @F.pandas_udf("boolean")
    def accept(texts: pd.Series) -> pd.Series:
        scorer = _scorer(model.value)
        return pd.Series([not verdict(scorer.model, e, f, n)[2] for e, f, n in scorer.cross_entropies([t or "" for t in texts])], dtype=bool)
    return accept
