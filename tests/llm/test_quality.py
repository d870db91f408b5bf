import random

import numpy as np
from pyspark.sql import functions as F

from assaygrid.llm import quality as ql


def test_isotonic():
    rng = np.random.default_rng(1)
    y, n = rng.random(40), rng.integers(1, 5, 40).astype(float)
    fit = ql.isotonic(np.arange(40), y, n)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * n).sum() - (y * n).sum()) < 1e-9
    want = [max(min((y[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(fit, want)


def plain_statistics(text):
    """The statistics again, character by character."""
    if not text:
        return [0.0] * len(ql.NAMES)
    words, n = text.split(), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    w, kinds = max(1, len(words)), sorted(set(words))
    many = lambda items: max((items.count(x) for x in set(items)), default=0)
    of = lambda chars: sum(c in chars for c in text) / n
    return [np.log(1 + len(words)), np.log(1 + len(lines)), sum(map(len, words)) / w, sum(len(x) > 12 for x in words) / w, sum(len(x) <= 3 for x in words) / w, len(kinds) / w, many(words) / w,
            sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, sum(x.isupper() for x in words) / w, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("0123456789"), of(".,;:"), of("#$%&*|<>{}[]\\^~=@"), of("!"),
            sum(not x[-1].isalnum() and x[-1] not in ".,;:" for x in kinds) / max(1, len(kinds)), len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)) / 100, sum(ord(c) > 127 for c in text) / n, many(list(zip(words, words[1:]))) / w]


def test_against_plain_computation(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab CD.;1!#é\n ") for _ in range(rng.choice([1, 30, 200]))) for _ in range(120)] + ["", " \n "]
    for t in [*texts, None]:
        assert np.allclose(ql.statistics(t), plain_statistics(t))
    y = [float(t.count("a") > t.count("b")) for t in texts]
    rows = [(i, [float(v) for v in plain_statistics(t)], y[i], i % ql.FOLDS) for i, t in enumerate(texts)]
    model = ql.fit(spark.createDataFrame(rows, "id int, x array<double>, y double, f int").repartition(4))
    x = np.array([r[1] for r in rows])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-9), -8, 8)
    f = np.column_stack([np.cos(z @ model.w[:, k] + model.b[k]) * np.sqrt(2 / ql.FEATURES) for k in range(ql.FEATURES)] + [np.ones(len(x))])
    keep = ql.RIDGE * np.diag([1.0] * ql.FEATURES + [1e-6])
    solve = lambda on: np.linalg.solve(f[on].T @ f[on] + keep * on.sum(), f[on].T @ np.array(y)[on])
    every, fold = np.ones(len(x), bool), np.array([r[3] for r in rows])
    assert np.allclose(f @ model.ridge, f @ solve(every), atol=1e-6)
    raw = np.array([f[i] @ solve(fold != fold[i]) for i in range(len(x))])
    cells: dict = {}
    for v, label in zip(np.clip(raw, -0.5, 1.5), y):
        cells.setdefault(float(np.floor(v * ql.BINS + 0.5)) if v >= 0 else -float(np.floor(-v * ql.BINS + 0.5)), []).append(label)
    at = sorted(cells)
    level = ql.isotonic(np.array(at), np.array([np.mean(cells[c]) for c in at]), np.array([len(cells[c]) for c in at], float))
    assert np.allclose(model.levels[0], np.array(at) / ql.BINS) and np.allclose(model.levels[1], level)


def test_equal_texts_and_odd_labels(spark):
    docs = spark.createDataFrame([(i % 7, "same words here") for i in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(0, 1), (1, 0), (2, 5), (3, -1)], "doc_id long, quality int")
    got = ql.classify(docs, lab, F.lit(True)).collect()
    assert len(got) == 40 and len({round(r.score, 9) for r in got}) == 1 and 0.4 < got[0].score < 0.6


def test_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = ["".join(rng.choice(["an", "er", "th", "ou"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(rng.choice([20, 100]))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "%%%" for w in words) if bad else " ".join(words) + "."))
        labels.append((i, int(not bad)))
    rows += [(900, None), (901, ""), (None, "x y"), (902, "word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("y", F.lit(1))
    lab = spark.createDataFrame(labels + [(3, None), (5, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in ql.classify(docs, lab, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0) >= 97
    assert {r.score for r in ql.classify(docs, lab.where("false"), F.lit(True)).collect()} == {0.5}
    assert ql.classify(docs.where("false"), lab, F.lit(True)).count() == 0
