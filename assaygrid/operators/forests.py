"""Missing values by regression forests, all features with gaps at once.

Values are binned once, at quantiles of what is known; trees are grown on bins, level by level, from grouped sums over (node, feature,
bin). Trees depend on no other tree: a block of them is one group, which gets a study's rows (a bounded sample of a large study, another
one for each block) and grows its trees for every feature that has gaps. Forests go back to the samples as a broadcast, for
so many studies at once that it stays below `HELD` bytes; no study's samples need to meet in one task to be filled.

All features of a round are predicted from the values of the round before. Bootstrap weights are Poisson and, like the
features tried on a level, follow from hashes: runs repeat exactly.
"""

from __future__ import annotations

import pickle
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from assaygrid.operators.staging import staged

#: Bins of a feature; levels below a tree's root; least weight of a leaf; trees of a block; most rows a block takes of a study.
BINS, DEPTH, LEAF, BLOCK, BAG = 32, 6, 5.0, 10, 20_000
#: Bytes of forests that are broadcast at once (one study's at least).
HELD = 200_000_000
_NODES = 2 ** (DEPTH + 1) - 1
#: Rows that are predicted at once.
ROWS = 512
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(12)])


def weights(h: np.ndarray, tree: int) -> np.ndarray:
    """How often a bootstrap of mean one draws each row, from the rows' 64-bit hashes."""
    z = h.astype(np.int64).view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def tried(features: int, target: int, tree: int, level: int, seed: int) -> np.ndarray:
    """The other features, as many as the root of their number, that a level of a tree may split at."""
    others = np.delete(np.arange(features), target)
    return np.sort(np.random.default_rng([seed, tree, target, level]).permutation(others)[: max(1, round(len(others) ** 0.5))])


def grow(columns: np.ndarray, y: np.ndarray, w: np.ndarray, subsets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, cut, value) of a tree's nodes in heap order; codes up to the cut go to the first child. `columns` has the codes by feature."""
    feature, cut, value = np.full(_NODES, -1, np.int16), np.zeros(_NODES, np.uint8), np.zeros(_NODES, np.float32)
    w = w if w.any() else np.ones(len(w))
    rows = np.flatnonzero(w > 0)
    w, size = w[rows], columns.shape[1]
    node, wy, flat = np.zeros(len(rows), np.int64), w * y[rows], columns.ravel()
    for level in range(DEPTH + 1):
        k, base = 2**level, 2**level - 1
        total, sums = np.bincount(node, w, k), np.bincount(node, wy, k)
        there = total > 0
        value[base : base + k][there] = (sums[there] / total[there])
        if level == DEPTH or not len(node):
            break
        fs = subsets[level]
        below, first = np.empty((2, k, len(fs), BINS)), node * BINS
        for i, f in enumerate(fs):  # feature by feature, as keys of all at once do not fit a cache
            keys = first + columns[f].take(rows)
            for v, into in zip((w, wy), below):
                into[:, i] = np.bincount(keys, v, k * BINS).reshape(k, BINS)
        lw, ls = below.cumsum(3)[..., :-1]
        rw, rs = total[:, None, None] - lw, sums[:, None, None] - ls
        gain = np.where((lw >= LEAF) & (rw >= LEAF), ls**2 / np.maximum(lw, 1e-9) + rs**2 / np.maximum(rw, 1e-9), -np.inf).reshape(k, -1)
        best = gain.argmax(1)
        found = gain[np.arange(k), best] > sums**2 / np.maximum(total, 1e-9) * (1 + 1e-9) + 1e-12
        at = base + np.flatnonzero(found)
        feature[at], cut[at] = fs[best[found] // (BINS - 1)], best[found] % (BINS - 1)
        if not found.all():
            on = found[node]
            rows, w, wy, node = rows[on], w[on], wy[on], node[on]
        node = 2 * node + (flat.take(feature[base + node].astype(np.int64) * size + rows) > cut[base + node])
    return feature, cut, value


def levelled(forest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """A forest (each tree a row) made even: the test of every node, level by level, and the values below the last level.

    A test is the place of feature and cut in a row of `over`; a leaf's is never true, and its value goes down with it.
    """
    feature, cut, value = forest
    test, value = np.where(feature >= 0, feature.astype(np.int64) * BINS + cut, BINS - 1), value.copy()
    for level in range(DEPTH):
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        value[:, 2 * at + 1] = np.where(feature[:, at] < 0, value[:, at], value[:, 2 * at + 1])
    return [test[:, 2**level - 1 : 2 ** (level + 1) - 1].ravel() for level in range(DEPTH)], value[:, 2**DEPTH - 1 :].ravel()


def over(codes: np.ndarray) -> np.ndarray:
    """For each row whether its code of a feature is above a cut, at feature * BINS + cut."""
    return (codes[:, :, None] > np.arange(BINS, dtype=np.uint8)).reshape(len(codes), -1)


def predict(above: np.ndarray, even: tuple[list[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of a target's trees (`levelled`) for rows of `over`; few rows at a time stay in a cache."""
    tests, value = even
    at, start, flat = np.arange(len(tests[0]))[None, :], (np.arange(len(above)) * above.shape[1])[:, None], above.view(np.uint8).ravel()
    for test in tests:
        at = 2 * at + flat.take(start + test.take(at))
    return value.take(at).mean(1, dtype=float)


def coded(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def _known(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, means, least, edges, gaps, most): for each study its features' means and inner quantiles, and which of them have gaps."""
    cells = rows.select(by, F.posexplode("x").alias("j", "v"))
    cuts = [float(q) for q in np.arange(1, BINS) / BINS]
    own = cells.groupBy(by, "j").agg(F.avg("v").alias("mean"), F.percentile_approx("v", cuts, 1000).alias("edges"), F.max(F.abs("v")).alias("most"), F.count_if(F.col("v").isNull()).alias("gaps"))
    whole = own.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("j", "mean", "edges", "gaps"))).alias("f"), F.max("most").alias("most"))
    return whole.select(by, "most", F.transform("f", lambda f: F.coalesce(f["mean"], F.lit(0.0))).alias("means"), F.transform("f", lambda f: f["edges"]).alias("edges"),
                        F.transform("f", lambda f: (f["gaps"] > 0) & f["mean"].isNotNull()).alias("open"))


def impute(rows: DataFrame, by: str, key: str = "id", trees: int = 100, rounds: int = 25, near: float = 1e-3, seed: int = 42) -> DataFrame:
    """rows (by, key, x: array<double>, ...) with the nulls of x filled.

    A study's features start at their means; its rounds end when no value moves by more than `near` of its largest known
    value, when the squares of all moves add up to more than in the round before, or after `rounds`. NaN counts as null. A feature without a known value is 0; a study with one feature keeps its mean. Studies
    have vectors of one length each. Rows without a study or vector stay as they are. Other columns stay.
    """
    rest = [c for c in rows.columns if c not in (by, key, "x")]
    x = F.transform("x", lambda v: F.when(~F.isnan(v), v.cast("double")))
    usable = F.col(by).isNotNull() & F.col("x").isNotNull()
    held = staged(rows.where(usable).select(by, key, F.struct(*rest).alias("__rest") if rest else F.lit(0).alias("__rest"), x.alias("x")))
    known = staged(_known(held, by))
    open_ = F.size(F.filter("open", lambda o: o))
    size, studies = known.agg(F.coalesce(F.sum(open_.cast("long") * (trees * _NODES * 7) + F.size("means") * (BINS * 8)), F.lit(0)), F.count("*")).first()
    parts = int(min(max(1, studies), max(1, -(-size // HELD))))
    out = rows.where(~usable)
    for p in range(parts):
        mine = F.pmod(F.xxhash64(by), F.lit(parts)) == p
        done = _filled(held.where(mine), known.where(mine), by, key, trees, rounds, near, seed)
        out = out.unionByName(done.select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in rows.columns)))
    return out


def _filled(held: DataFrame, known: DataFrame, by: str, key: str, trees: int, rounds: int, near: float, seed: int) -> DataFrame:
    spark = held.sparkSession
    studies = {r[by]: (np.array([[np.nan] * (BINS - 1) if e is None else e for e in r.edges]), np.array(r.open), np.array(r.means), r.most or 0.0) for r in known.collect()}  # below HELD
    about = spark.sparkContext.broadcast(studies)
    kind = dict(held.dtypes)[by]
    sizes = held.groupBy(by).agg(F.count("*").alias("__n"))
    gaps = F.transform("x", lambda v: v.isNull())
    start = staged(held.join(F.broadcast(known.select(by, "means")), by).select(by, key, "__rest", gaps.alias("gap"), F.zip_with("x", "means", lambda v, m: F.coalesce(v, m)).alias("x")))
    blocks, settled, last = -(-trees // BLOCK), set(), {}

    def fit(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        study, block = key_
        edges, need, _, _ = about.value[study]
        pdf = pdf.sort_values("h")
        x, gap = np.stack(pdf["x"].to_numpy()), np.stack(pdf["gap"].to_numpy())
        codes, h, found = coded(x, edges), pdf["h"].to_numpy(), {}
        numbers = range(block * BLOCK, min(trees, (block + 1) * BLOCK))
        drawn = [weights(h, t) for t in numbers]
        for j in np.flatnonzero(need) if x.shape[1] > 1 else ():
            there = ~gap[:, j]
            columns = np.ascontiguousarray(codes[there].T)
            grown = [grow(columns, x[there, j], w[there], [tried(x.shape[1], j, t, level, seed) for level in range(DEPTH)]) for t, w in zip(numbers, drawn)]
            found[int(j)] = tuple(np.stack(a) for a in zip(*grown))
        return pd.DataFrame({by: [study], "block": [block], "forest": [pickle.dumps(found)]})

    share = F.pmod(F.xxhash64(F.lit(seed), "block", key), F.lit(1 << 30)) < F.lit(float(BAG) * (1 << 30)) / F.col("__n")
    df = start
    for _ in range(rounds):
        dealt = df.join(F.broadcast(sizes), by).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(share)
        ended = spark.createDataFrame([(study,) for study in settled], f"`{by}` {kind}")
        dealt = dealt.join(F.broadcast(ended), by, "left_anti")
        fitted = dealt.select(by, "block", "x", "gap", F.xxhash64(F.lit(seed), key).alias("h")).groupBy(by, "block").applyInPandas(fit, f"`{by}` {kind}, block int, forest binary")
        whole: dict = {}
        for r in sorted(fitted.collect(), key=lambda r: r.block):  # below HELD
            for j, f in pickle.loads(r.forest).items():
                whole.setdefault(r[by], {}).setdefault(j, []).append(f)
        if not whole:
            break
        forests = spark.sparkContext.broadcast({s: {j: tuple(np.concatenate(a) for a in zip(*f)) for j, f in own.items()} for s, own in whole.items()})

        def fill(study: pd.Series, x: pd.Series, gap: pd.Series) -> pd.DataFrame:
            new, moved, squares = list(x), np.zeros(len(x)), np.zeros(len(x))
            for s, at in study.groupby(study).indices.items():
                edges, _, _, most = about.value[s]
                now, empty = np.stack(x.iloc[at].to_numpy()), np.stack(gap.iloc[at].to_numpy())
                codes, then = coded(now, edges), now.copy()
                even = {j: levelled(forest) for j, forest in forests.value.get(s, {}).items() if empty[:, j].any() and now.shape[1] > 1}
                for part in range(0, len(then) if even else 0, ROWS):
                    rows = slice(part, part + ROWS)
                    above = over(codes[rows])
                    for j, forest in even.items():
                        open_ = empty[rows, j]
                        if open_.any():
                            then[rows][open_, j] = predict(above[open_], forest)
                for k, row in zip(at, then):
                    new[k] = row
                moved[at], squares[at] = np.abs(then - now).max(1, initial=0.0) / max(most, 1e-300), ((then - now) ** 2).sum(1)
            return pd.DataFrame({"x": new, "moved": moved, "squares": squares})

        filled = F.pandas_udf(fill, "x array<double>, moved double, squares double")(by, "x", "gap")
        df = staged(df.select(by, key, "__rest", "gap", filled.alias("f")).select(by, key, "__rest", "gap", "f.*"))
        for r in df.groupBy(by).agg(F.max("moved").alias("moved"), F.sum("squares").alias("squares")).collect():  # a row for each study of the pass
            if r.moved <= near or r.squares > last.get(r[by], float("inf")):
                settled.add(r[by])
            last[r[by]] = r.squares
        df = df.drop("moved", "squares")
        if len(settled) == len(studies):
            break
    return df.select(by, key, "__rest", "x")
