"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

The model is fitted on a bounded sample of labelled training rows (parameter `most`). Sentences of the sample
that name an identity group are swapped, term by term, to every other term of the group, and the fit pays for
every change of score between a sentence and its swapped twin, so neutral mentions can't carry weight. Scoring is one pass over
whole texts without a shuffle; the model is a few thousand weights.

Defined results: null and empty texts get the score of no evidence; repeated rows get equal scores; an empty
table or one without labels gives the base rate (0.5 without any label).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import materialize, need, train_fold
from .textstats import label_sample

MOST, FEATURES = 20_000, 4_096
PREFIXES = (4, 5, 6)

#: Terms that may stand for each other in a sentence.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("immigrant", "refugee", "foreigner", "local"),
    ("old", "young", "disabled"),
)
_GROUP_OF = {term: group for group in IDENTITY_GROUPS for term in group}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def tokens(text: str) -> set[str]:
    """The features of a text: '=word' for each word, and the word beginnings of 4 to 6 letters."""
    out: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        out.add("=" + word)
        for n in PREFIXES:
            if len(word) >= n:
                out.add(word[:n])
    return out


def swapped(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, twin) for each identity term of each sentence and each other term of its group; all its places are swapped."""
    for sentence in _SENTENCE.findall(text):
        for term in dict.fromkeys(w for w in _WORD.findall(sentence.lower()) if w in _GROUP_OF):
            for other in _GROUP_OF[term]:
                if other != term:
                    yield sentence, re.sub(rf"\b{term}\b", other, sentence, flags=re.IGNORECASE)


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.weights = {name: float(w) for name, w in zip(names, weights, strict=True) if w}
        self.bias = bias

    def score(self, text: str | None) -> float:
        total, find = self.bias, self.weights.get
        seen = set()
        for word in set(_WORD.findall((text or "").lower())):
            total += find("=" + word, 0.0)
            for n in PREFIXES:
                if len(word) >= n and (head := word[:n]) in self.weights:
                    seen.add(head)
        return float(sigmoid(total + sum(map(self.weights.__getitem__, seen))))


def fit_weights(rows: list[list[int]], y: np.ndarray, twins: list[tuple[list[int], list[int]]], size: int, ridge: float = 1e-3, counterfactual: float = 5.0, rounds: int = 800, times: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on mean logistic loss + ridge + counterfactual x mean squared score change of twins.

    twins holds the features of both sides; `times` says how often each pair stands in the sample (once if None).
    """
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    w, bias = np.zeros(size), float(np.log(rate / (1 - rate)))
    if len(y) < 2 or y.min() == y.max() or not size:
        return w, bias
    flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([k for x in lists for k in x], dtype=np.int64))
    r, c = flat(rows)
    tr, tc = flat([list(set(a) - set(b)) for a, b in twins])
    ur, uc = flat([list(set(b) - set(a)) for a, b in twins])
    # each class weighs half, so that a rare class is learnt
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    often = np.ones(len(twins)) if times is None else np.asarray(times, dtype=float)
    pulled = 2 * counterfactual * often / max(often.sum(), 1.0)
    # diagonal scaling; in scaled weights the curvature is at most that of the longest row and the longest difference
    lift = np.sqrt(np.bincount(c, weight[r], size) + np.bincount(tc, pulled[tr], size) + np.bincount(uc, pulled[ur], size) + 1e-4)
    longest = lambda who, n: int(np.bincount(who, minlength=max(n, 1)).max())
    rate = 1.0 / (0.25 * (1 + longest(r, len(y))) + (longest(tr, len(twins)) + longest(ur, len(twins)) if twins else 0) + ridge)
    v, b, mw, mb = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(rounds):
        look, look_b = v + 0.9 * mw, b + 0.9 * mb
        p = sigmoid(np.bincount(r, look[c] / lift[c], len(y)) + look_b)
        g = (p - y) * weight
        grad = np.bincount(c, g[r], size) / lift + ridge * look
        if twins:
            change = np.bincount(tr, look[tc] / lift[tc], len(twins)) - np.bincount(ur, look[uc] / lift[uc], len(twins))
            pull = pulled * change
            grad += (np.bincount(tc, pull[tr], size) - np.bincount(uc, pull[ur], size)) / lift
        mw, mb = 0.9 * mw - rate * grad, 0.9 * mb - rate * g.sum()
        v, b = v + mw, b + mb
    return v / lift, b


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, features: int = FEATURES, counterfactual: float = 5.0) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic 0/1): at most `most` labelled training rows, by hash order."""
    chosen = label_sample(labels, "toxic", most).orderBy(F.pmod("_h", F.lit(1 << 40)), "_id", "_y").limit(most)
    sample = need(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_y", F.col("text").cast("string").alias("text"))
    sample, _ = materialize(sample, "toxic")

    def count(batches):
        both = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                both[y].update(tokens(text.as_py() or ""))
        for y, counts in enumerate(both):
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([y] * len(counts), pa.int32()), pa.array(counts.values(), pa.int64())], names=["f", "y", "n"])

    totals = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = max(totals.get(0, 0), 1), max(totals.get(1, 0), 1)
    counts = sample.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("p"), F.sum(F.expr("if(y = 0, n, 0)")).alias("q"))
    # features that speak for the class, by how sure their log odds are; rare ones must be pure
    odds = F.log((F.col("p") + 0.5) * F.lit(good + 1.0) / ((F.col("q") + 0.5) * F.lit(bad + 1.0)))
    sure = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    top = counts.where((F.col("p") >= 3) & (sure >= 2.0) & (odds >= 1.5)).orderBy(sure.desc(), "f").limit(features)
    names = [r["f"] for r in top.select("f").collect()]  # at most `features`
    place = {name: k for k, name in enumerate(names)}

    def index(batches):
        for batch in batches:
            rows = [sorted(place[t] for t in tokens(x.as_py() or "") & place.keys()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["y", "f"])

    def differences(batches):
        """Features that only the sentence has, features that only its twin has, and how often that is so."""
        found: Counter[tuple] = Counter()
        for batch in batches:
            for x in batch.column(1):
                for sentence, twin in swapped(x.as_py() or ""):
                    a, b = (tokens(s) & place.keys() for s in (sentence, twin))
                    found[tuple(sorted(place[t] for t in a - b)), tuple(sorted(place[t] for t in b - a))] += 1
        columns = ([list(a) for a, _ in found], [list(b) for _, b in found], list(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()), strict=True)], names=["a", "b", "n"])

    got = sample.mapInArrow(index, "y int, f array<int>").toPandas()  # at most `most` rows of indexes
    rows = [list(x) for x in got["f"]]
    # a difference is what two terms of a group leave of their few features: bounded by the lists of terms
    pairs = sample.mapInArrow(differences, "a array<int>, b array<int>, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    twins = [(list(r["a"]), list(r["b"])) for r in sorted(pairs, key=lambda r: (r["a"], r["b"]))]
    times = [r["n"] for r in sorted(pairs, key=lambda r: (r["a"], r["b"]))]
    y = got["y"].to_numpy(dtype=float)
    weights, bias = fit_weights(rows, y, twins, len(names), counterfactual=counterfactual, times=times)
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = F.coalesce(~train_fold(F.col("doc_id")), F.lit(False))
    return score(docs, train(docs, labels, most)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
