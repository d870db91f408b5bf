"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics cover the whole text. A Gaussian kernel over the standardised statistics is approximated by cosines of random
projections; ridge regression on the 0/1 label is solved from normal equations that each partition sums for itself, by
fold, and a grouped sum adds up row by row of the matrix, so the driver sees one matrix of fixed size a fold. Raw scores are
made probabilities by pooling adjacent violators over score bins of fixed number; a training row's raw score comes from the
other folds, so that calibration does not see what the ridge learned from the row itself.

Defined results: null and empty texts have all-zero statistics and are scored like any other; labels other than 0 and 1 are
not used, repeated labels of an id count once (the largest); rows with a null id teach nothing, are scored, and in the op6 query
are not held out; rows that repeat an id each teach; without usable labels every score is 0.5.
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

FEATURES, BANDWIDTH, RIDGE, SEED, BINS, FOLDS = 256, 4.0, 1e-4, 5, 512, 5
_UPPER, _DIGIT = re.compile(r"[A-Z]"), re.compile(r"[0-9]")
_MARK, _JUNK, _LOUD = re.compile(r"[.,;:]"), re.compile(r"[#$%&*|<>{}\[\]\\^~=@]"), re.compile(r"!")
NAMES = ("log_words", "log_lines", "word_length", "long_words", "short_words", "distinct", "top_word", "repeats", "upper_words", "capitals", "digits", "marks", "junk", "loud", "junk_words", "distinct_lines", "line_words", "beyond_ascii", "top_pair")


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    words, lines, n = text.split(), [x for x in text.split("\n") if x.strip()], len(text)
    w = max(1, len(words))
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    share = lambda rx: len(rx.findall(text)) / n
    return [np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()) if len(words) else 0.0, float((lengths > 12).sum()) / w, float((lengths <= 3).sum()) / w,
            len(counts) / w, max(counts.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w, sum(map(str.isupper, words)) / w,
            share(_UPPER), share(_DIGIT), share(_MARK), share(_JUNK), share(_LOUD), sum(1 for x in counts if not x[-1].isalnum() and x[-1] not in ".,;:") / max(1, len(counts)),
            len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)) / 100, 1 - len(text.encode("ascii", "ignore")) / n, max(pairs.values(), default=0) / w]


def stats_of(text: Column) -> Column:
    @arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return of(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray | None = None
    levels: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(scale=1 / BANDWIDTH, size=(len(self.mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones(len(x))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.levels is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), *self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of the means y with weights n, by pooling adjacent violators; x is sorted."""
    blocks: list[list[float]] = []
    for mean, weight in zip(y, n):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, k = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + k
    return np.concatenate([np.full(int(k), m) for m, _, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame) -> Model:
    """From (x: array of statistics, y: 0 or 1, f: fold)."""
    k = len(NAMES)
    cols = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]
    seen = stats.agg(F.count("*").alias("n"), *cols).first()
    if not seen.n:
        return Model(np.zeros(k), np.ones(k))
    model = Model(np.array([seen[f"m{i}"] for i in range(k)]), np.array([max(seen[f"s{i}"], 1e-9) for i in range(k)]))
    wide = FEATURES + 1

    def sums(batches):
        total = np.zeros((FOLDS, wide, wide + 1))
        for batch in batches:
            if batch.num_rows:
                z, y, f = model.features(np.array(batch["x"].to_pylist())), np.array(batch["y"].to_pylist(), float), np.array(batch["f"].to_pylist())
                for k in range(FOLDS):
                    total[k] += z[f == k].T @ np.column_stack((z[f == k], y[f == k]))
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS * wide)), pa.array(total.reshape(FOLDS * wide, -1).tolist(), pa.list_(pa.float64()))], ["i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"i": rows["i"][:1], "row": pa.array([np.sum(np.array(rows["row"].to_pylist()), axis=0).tolist()], pa.list_(pa.float64()))})

    rows = stats.select("x", "y", "f").mapInArrow(sums, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").collect()
    grams = np.array([r.row for r in sorted(rows, key=lambda r: r.i)]).reshape(FOLDS, wide, -1)
    model.ridge, others = solve_ridge(grams.sum(0)), [solve_ridge(grams.sum(0) - g) for g in grams]
    raw = stats.select(_raw(F.col("x"), F.col("f"), model, others).alias("raw"), "y")
    cell = F.round(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * BINS)
    bins = sorted(raw.groupBy(cell.alias("c")).agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())  # 2 * BINS + 1 at most
    x, y, n = (np.array(v, float) for v in zip(*((r.c / BINS, r.y, r.n) for r in bins)))
    model.levels = (x, isotonic(x, y, n))
    return model


def solve_ridge(gram: np.ndarray) -> np.ndarray:
    """Weights from sums of z (z, y): the last z is 1, its sum the number of rows, and its weight is not penalised."""
    n = max(gram[-1, -2], 1.0)
    return np.linalg.solve(gram[:, :-1] + RIDGE * n * np.diag(np.r_[np.ones(len(gram) - 1), 1e-6]), gram[:, -1])


def _raw(x: Column, fold: Column, model: Model, others: list[np.ndarray]) -> Column:
    """Each row's raw score from the folds that it is not in."""

    @arrow_udf("double")
    def of(rows: pa.Array, folds: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.float64())
        z = model.features(np.array(rows.to_pylist()))
        return pa.array((z * np.array(others)[np.array(folds.to_pylist())]).sum(1), pa.float64())

    return of(x, fold)


def score(x: Column, model: Model) -> Column:
    """0 to 1 from an array of statistics; higher: label 1 likelier."""

    @arrow_udf("double")
    def of(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array(rows.to_pylist()).reshape(len(rows), -1)) if len(rows) else [], pa.float64())

    return of(x)


def classify(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document; `train` is a condition over the id column for rows to learn from."""
    stats = cut(docs.select(F.col(id_col), stats_of(F.col(text_col)).alias("x")))
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("double").alias("y"))
    fold = F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int").alias("f")
    model = fit(cut(stats.where(train).join(known, id_col).select("x", "y", fold)))
    return stats.select(id_col, score(F.col("x"), model).alias("score"))
