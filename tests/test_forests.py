import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import forests as fo


def plain_tree(codes, y, w, subsets, level=0):
    """(prediction of a row of codes) by the definition, one node at a time."""
    mean = np.float32((w * y).sum() / w.sum())
    best = None
    if level < fo.DEPTH:
        for f in subsets[level]:
            for cut in range(fo.BINS - 1):
                left = codes[:, f] <= cut
                a, b = w[left].sum(), w[~left].sum()
                if a >= fo.LEAF and b >= fo.LEAF:
                    gain = (w * y)[left].sum() ** 2 / a + (w * y)[~left].sum() ** 2 / b
                    if best is None or gain > best[0] * (1 + 1e-12):
                        best = gain, f, cut
    if best is None or best[0] <= (w * y).sum() ** 2 / w.sum() * (1 + 1e-9) + 1e-12:
        return lambda row: mean
    _, f, cut = best
    left = codes[:, f] <= cut
    below = [plain_tree(codes[s], y[s], w[s], subsets, level + 1) for s in (left, ~left)]
    return lambda row: below[int(row[f] > cut)](row)


def table(n=150, p=5, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, p)) + 0.1 * rng.normal(size=(n, p)) + 4
    gap = rng.random((n, p)) < 0.15
    gap[:, 1] = False
    return x, gap


def frame(spark, x, gap, study="s"):
    rows = [(study, i, [None if g else float(v) for v, g in zip(x[i], gap[i])], "kept") for i in range(len(x))]
    return spark.createDataFrame(rows, "study string, id int, x array<double>, means string").repartition(3)


def test_against_plain_trees(spark):
    x, gap = table()
    df = frame(spark, x, gap)
    got = fo.impute(df, "study", trees=12, rounds=1)
    assert got.columns == df.columns
    got = np.array([r.x for r in got.orderBy("id").collect()])
    hashes = np.array([r.h for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).orderBy("id").collect()])
    edges = df.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile_approx("v", [k / fo.BINS for k in range(1, fo.BINS)], 1000).alias("e")).orderBy("j").collect()
    start = np.where(gap, np.array([x[~gap[:, j], j].mean() for j in range(x.shape[1])]), x)
    codes = fo.coded(start, np.array([r.e for r in edges]))
    order = np.argsort(hashes)
    for j in np.flatnonzero(gap.any(0)):
        there = order[~gap[order, j]]
        trees = []
        for t in range(12):
            w = fo.weights(hashes[there], t)
            subsets = [fo.tried(x.shape[1], int(j), t, level, 42) for level in range(fo.DEPTH)]
            trees.append(plain_tree(codes[there][w > 0], start[there, j][w > 0], w[w > 0], subsets))
        want = [np.mean([tree(codes[i]) for tree in trees]) for i in np.flatnonzero(gap[:, j])]
        assert np.allclose(got[gap[:, j], j], want, atol=1e-5)
    assert np.array_equal(got[~gap], x[~gap])


def test_fills_better_than_means_and_settles(spark):
    x, gap = table(400)
    got = np.array([r.x for r in fo.impute(frame(spark, x, gap), "study", trees=20, rounds=6).orderBy("id").collect()])
    means = np.array([x[~gap[:, j], j].mean() for j in range(x.shape[1])])
    assert ((got - x)[gap] ** 2).sum() < 0.3 * ((means - x)[gap] ** 2).sum()


@pytest.mark.parametrize("held", [fo.HELD, 1])
def test_defined_results(spark, monkeypatch, held):
    monkeypatch.setattr(fo, "HELD", held)  # studies one by one
    x, gap = table(60)
    rows = frame(spark, x, gap).unionByName(frame(spark, x, np.zeros_like(gap), "whole")).unionByName(spark.createDataFrame(
        [("single", 1, [None], "a"), ("single", 2, [3.0], "a"), ("never", 1, [None, 2.0], "a"), ("never", 2, [None, float("nan")], "a"), (None, 1, [None], "a"), ("none", 7, None, "a")], "study string, id int, x array<double>, means string"))
    got = {(r.study, r.id): r.x for r in fo.impute(rows, "study", trees=4, rounds=2).collect()}
    assert len(got) == 126 and all(got["whole", i] == x[i].tolist() for i in range(60))
    assert got["single", 1] == [3.0] and got["never", 1] == [0.0, 2.0] and got["never", 2] == [0.0, 2.0] and got[None, 1] == [None] and got["none", 7] is None
    assert fo.impute(rows.where("false"), "study").count() == 0


def test_large_studies_are_sampled_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(fo, "BAG", 50)
    x, gap = table(300)
    got = np.array([r.x for r in fo.impute(frame(spark, x, gap), "study", trees=20, rounds=2).orderBy("id").collect()])
    assert np.array_equal(got[~gap], x[~gap]) and not np.isnan(got).any()


def test_even_trees_predict_like_walks_from_the_root():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    edges = np.quantile(x, np.arange(1, fo.BINS) / fo.BINS, axis=0).T
    codes, y, h = fo.coded(x, edges), np.where(x[:, 1] > 0.8, x[:, 2], 0.0), rng.integers(-(2**62), 2**62, 400)
    trees = [fo.grow(np.ascontiguousarray(codes.T), y, fo.weights(h, t), [fo.tried(6, 0, t, level, 42) for level in range(fo.DEPTH)]) for t in range(7)]
    trees.append(fo.grow(np.ascontiguousarray(codes.T), np.ones(400), np.ones(400), [np.arange(1, 6)] * fo.DEPTH))  # a root alone
    feature, cut, value = (np.stack(a) for a in zip(*trees))
    assert (feature[:, 0] < 0).any() and (feature[:, 1:31] < 0).any()  # leaves above the last level

    def walk(t, row):
        at = 0
        while feature[t, at] >= 0:
            at = 2 * at + 1 + (row[feature[t, at]] > cut[t, at])
        return float(value[t, at])

    want = [np.mean([walk(t, row) for t in range(8)]) for row in codes]
    assert np.allclose(fo.predict(fo.over(codes), fo.levelled((feature, cut, value))), want, rtol=1e-12)
