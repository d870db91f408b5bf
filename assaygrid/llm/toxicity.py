"""Toxicity with a classifier chain over document-wide term counts.

Terms are whole words and word beginnings (invented and inflected languages put the offence in a stem). Those that
stand out most in toxic training documents, by a log-likelihood ratio over how many documents hold them once or often, are
the features, however few the documents; the ridge weighs them. A document is described by how often it holds each,
absolutely and for its length.

Categories are predicted in sequence, each by a linear (logistic) model that is also fed the probabilities of
the categories before it: `word` (a toxic document that holds a telling whole word), `stem` (a toxic document that
repeats a telling word beginning), `toxic` (the label itself). While training, those earlier probabilities are
out-of-fold predictions, so a link never sees what its predecessor learned from the same row.

The training sample is bounded: `bound` labelled rows, the first of each class by a hash of the id, half of them toxic
where there are so many; rows weigh as much as their class has among all labels. Scoring covers whole texts of
all rows. Defined results: null and empty texts have no term and score by the intercepts; labels other than 0 and 1 are not
used, repeated labels of an id count once (the largest); labelled documents that repeat an id teach once, by the least of
their texts; rows with a null id teach nothing and are scored; without both classes in the sample every probability is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .shared import cut

WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = ("word", "stem", "toxic")
#: Labelled rows to learn from; terms to keep; folds; lengths of word beginnings; "often".
BOUND, TERMS, FOLDS, STEMS, OFTEN = 8_000, 96, 5, (5, 6, 7, 8), 3
THRESHOLD = 0.5


def term_counts(text: str | None) -> tuple[int, Counter]:
    """Words in the text, and how often each word (w:) and word beginning (p:) stands in it."""
    words = Counter(WORD.findall((text or "").lower()))
    counts: Counter = Counter()
    for w, n in words.items():
        counts["w:" + w] = n
        for k in STEMS:
            if len(w) >= k:
                counts["p:" + w[:k]] += n
    return sum(words.values()), counts


def vector(text: str | None, terms: dict[str, int], whole: set[str], stems: set[str]) -> np.ndarray:
    """log(1 + count) and log(1 + count per 100 words) for each term."""
    words = Counter(WORD.findall((text or "").lower()))
    out = np.zeros(len(terms))
    for w, n in words.items():
        if w in whole:
            out[terms["w:" + w]] += n
        for k in STEMS:
            if w[:k] in stems and len(w) >= k:
                out[terms["p:" + w[:k]]] += n
    return np.concatenate((np.log1p(out), np.log1p(100 * out / max(1, words.total()))))


@dataclass
class Chain:
    terms: dict[str, int]
    links: list[tuple[np.ndarray, float]]

    def __post_init__(self):
        self.whole = {t[2:] for t in self.terms if t[0] == "w"}
        self.stems = {t[2:] for t in self.terms if t[0] == "p"}

    def predict(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.links:
            x = np.column_stack((x, sigmoid(x @ w + b)))
        return x[:, -len(self.links) :]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Newton's method on rows of the given weights; the intercept is not penalised."""
    v = np.ones(len(x)) if weight is None else weight
    x1 = np.column_stack((x, np.ones(len(x))))
    w, keep = np.zeros(x1.shape[1]), np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (v * p * (1 - p) + 1e-9)[:, None]).T @ x1 + keep, x1.T @ (v * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_chain(x: np.ndarray, targets: list[np.ndarray], fold: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, float]]:
    links = []
    for y in targets:
        links.append(logistic(x, y, weight=weight))
        held = np.zeros(len(x))
        for f in np.unique(fold):
            w, b = logistic(x[fold != f], y[fold != f], weight=weight[fold != f]) if (fold != f).any() else (np.zeros(x.shape[1]), 0.0)
            held[fold == f] = sigmoid(x[fold == f] @ w + b)
        x = np.column_stack((x, held))
    return links


def sample_of(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y, h, all) of at most `bound` labelled ids, the first of each class by hash, and how many ids their class has.

    Half are toxic; a class with fewer leaves the rest to the other. The ids are few enough to broadcast.
    """
    ids = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
           .agg(F.max(label).cast("int").alias("__y")))
    have = {r["__y"]: r.n for r in ids.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    neg, pos = have.get(0, 0), have.get(1, 0)
    take = {1: min(pos, max(bound // 2, bound - neg))}
    take[0] = bound - take[1]
    first = [ids.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(take[y]).withColumn("__all", F.lit(have.get(y, 0)).cast("long")) for y in (0, 1)]
    ids = first[0].union(first[1])
    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    once = found.groupBy("__id").agg(F.min("text").alias("text"), F.max("__y").alias("y"), F.max("__all").alias("all"))
    return once.select("text", "y", F.xxhash64("__id").alias("h"), "all")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    sample = cut(sample_of(docs, labels, label, bound, id_col, text_col))
    totals = {r.y: (r.n, r.all) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.max("all").alias("all")).collect()}
    pos, neg = (totals.get(y, (0, 0))[0] for y in (1, 0))
    if not pos or not neg:
        return Chain({}, [(np.zeros(k), -30.0) for k in range(3)])

    def terms(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                for term, n in term_counts(t)[1].items():
                    c = seen.setdefault(term, [0, 0, 0, 0])
                    c[y] += 1
                    c[2 + y] += n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in range(4))], ["term", "n0", "n1", "m0", "m1"])

    found = sample.mapInArrow(terms, "term string, n0 long, n1 long, m0 long, m1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "m0", "m1")))
    part = lambda k, n: k * F.log((k + 1e-9) / n)

    def ratio(a, b):
        a, b = F.col(a), F.col(b)
        gain = 2 * (part(a, pos) + part(b, neg) + part(pos - a, pos) + part(neg - b, neg)
                    - part(a + b, pos + neg) - part(pos + neg - a - b, pos + neg))
        return F.when(a * neg > b * pos, gain).otherwise(0.0)

    best = (found.where("n1 > 0").withColumn("score", F.greatest(ratio("n1", "n0"), ratio("m1", "m0")))
            .where("score > 0").orderBy(F.desc("score"), "term").limit(TERMS).select("term").collect())
    names = {r.term: k for k, r in enumerate(best)}
    chain = Chain(names, [])

    def vectors(batches):
        for batch in batches:
            rows = [vector(t, chain.terms, chain.whole, chain.stems).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch["y"], batch["h"]], ["x", "y", "h"])

    rows = sample.mapInArrow(vectors, "x array<double>, y int, h long").orderBy("h").collect()  # bounded by `bound`
    x, y, fold = np.array([r.x for r in rows]).reshape(len(rows), -1), np.array([r.y for r in rows], float), np.array([r.h % FOLDS for r in rows])
    counts = np.expm1(x[:, : len(names)])
    word = np.array([t[0] == "w" for t in names], bool)
    targets = [y * (counts[:, word] > 0.5).any(1), y * (counts[:, ~word] > OFTEN - 0.5).any(1), y]
    share = {y: n_all / n for y, (n, n_all) in totals.items()}
    weight = np.where(y > 0, share[1], share[0])
    chain.links = fit_chain(x, targets, fold, weight / weight.mean())
    return chain


def score(text: Column, chain: Chain) -> Column:
    """struct of the categories' probabilities."""

    @arrow_udf("struct<" + ",".join(f"{c}:double" for c in CATEGORIES) + ">")
    def of(texts: pa.Array) -> pa.Array:
        if not len(texts):
            p = np.zeros((0, len(CATEGORIES)))
        else:
            p = chain.predict(np.array([vector(t.as_py(), chain.terms, chain.whole, chain.stems) for t in texts]))
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(CATEGORIES))], list(CATEGORIES))

    return of(text)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **names) -> DataFrame:
    """The documents whose probability of `toxic` is below the threshold; columns as given."""
    chain = fit(docs, labels, **names)
    text = names.get("text_col", "text")
    return docs.where(score(F.col(text), chain)["toxic"] < threshold)
