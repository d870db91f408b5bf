"""Tests, scores and linear models, grouped by study so that many run at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from assaygrid.operators.staging import staged


def dose_levels(doses: DataFrame, by: str = "study") -> DataFrame:
    """Sorted doses become None, PosLow, PosHigh; the largest negative dose NegHigh; the largest treatment Yes."""
    w = Window.partitionBy(by)
    rank = F.dense_rank().over(w.orderBy("supplement_dose"))
    level = F.when(F.col("negative_dose") == F.max("negative_dose").over(w), F.when(F.col("negative_dose") > 0, "NegHigh"))
    level = F.coalesce(level, F.element_at(F.array(F.lit("None"), F.lit("PosLow"), F.lit("PosHigh")), F.least(rank, F.lit(3))))
    return doses.withColumn("supplement_level", level).withColumn("treated", F.when((F.col("treatment_dose") > 0) & (F.col("treatment_dose") == F.max("treatment_dose").over(w)), "Yes").otherwise("No"))


def numbered(df: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """df with `r`, the place from 1 of each row in its family by `order`, and `size`, the family's rows.

    Rows are range-partitioned and numbered within partitions; offsets come from one count a partition and family. So one
    family may hold all rows.
    """
    if not df.columns:
        return df
    keyed = df.withColumns({f"__o{k}": c for k, c in enumerate(order)})
    keys = [*by, *(f"__o{k}" for k in range(len(order)))]
    parts = staged(keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    local = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*keys[len(by):])))
    counts = parts.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each partition
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("__n").over(w))
    joined = local.alias("l").join(offsets.alias("o"), [F.col("l.__part") == F.col("o.__part"), *(F.col(f"l.{b}").eqNullSafe(F.col(f"o.{b}")) for b in by)])
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col("__r") + F.col("__before")).alias("r"), F.col("size"))


def contrasts(rows: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = ("treatment", "supplement")) -> DataFrame:
    """Rows with `contrast` and `is_a`, once for each side of a contrast they are on. `pairs` is (contrast, a_<column>, b_<column>); null selects null."""
    sides = [pairs.select("contrast", F.lit(side == "a").alias("is_a"), *(F.col(f"{side}_{c}").alias(f"__{c}") for c in columns)) for side in "ab"]
    return rows.join(sides[0].union(sides[1]), [rows[c].eqNullSafe(F.col(f"__{c}")) for c in columns]).drop(*(f"__{c}" for c in columns))


def average_rank(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Ranks with ties sharing their mean."""
    w = Window.partitionBy(*by)
    return df.withColumn("rnk", F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def mann_whitney(df: DataFrame, *by: str, value: str = "value", group: str = "is_a") -> DataFrame:
    """U of the rows where `group` is true, two-sided p, medians; nulls left out.

    p is exact where a side has eight values or fewer and none tie, else normal with correction for ties and continuity.
    Equal values are counted before they are ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(group)).alias("a"), F.count_if(~F.col(group)).alias("b"))
    t = F.col("a") + F.col("b")
    before = F.sum(t).over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("rnk", F.coalesce(before, F.lit(0)) + (t + 1) / 2)
    middle = lambda n: F.percentile(F.when(F.col(n) > 0, F.col(value)), F.lit(0.5), F.greatest(F.col(n), F.lit(1)))
    s = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rnk")).alias("r1"), F.sum(F.pow(t, 3) - t).alias("ties"),
                                middle("a").alias("median_a"), middle("b").alias("median_b"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / sd
    normal = F.least(F.lit(1.0), 2 * normal_tail(F.greatest(z, F.lit(0.0))))
    few = (F.least("n1", "n2") <= 8) & (F.col("ties") == 0) & (F.col("n1") * F.col("n2") <= 100_000)
    found = s.where("n1 > 0 and n2 > 0").withColumn("u", u)
    return found.withColumn("p", F.when(few, exact_p(F.when(few, F.col("u")), F.col("n1"), F.col("n2"))).when(sd > 0, normal).otherwise(1.0)).select(*by, "n1", "n2", "u", "median_a", "median_b", "p")


def exact_p(u: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p of U without ties: the share of orders at least as far out, doubled. Null where u is null."""

    @F.pandas_udf("double")
    def of(us: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        tails: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for v, a, b in zip(us, n, m):
            if v is None or np.isnan(v):
                out.append(None)
                continue
            a, b = sorted((int(a), int(b)))
            if (a, b) not in tails:
                ways = np.zeros(a * b + 1)  # orders by U, one value of the smaller side after the other
                ways[0] = 1
                for i in range(1, a + 1):
                    if b + i <= a * b:
                        ways[b + i :] -= ways[: -(b + i)].copy()
                    for k in range(i, len(ways)):
                        ways[k] += ways[k - i]
                tails[a, b] = np.cumsum(ways[::-1])[::-1] / ways.sum()
            far = max(v, a * b - v)
            out.append(min(1.0, 2 * float(tails[a, b][int(np.ceil(far))])))
        return pd.Series(out, dtype=float)

    return of(u, n1, n2)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 7 digits, by a rational approximation with fixed coefficients."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / F.sqrt(F.lit(2 * np.pi)) * poly


def benjamini_hochberg(df: DataFrame, p: str = "p", *by: str) -> DataFrame:
    """Adjusted p over all tests of a family (without `by`, of the whole table); tests without a p keep null.

    The least p * m / r from a test upward is a suffix minimum: within range partitions by windows, across them by one
    value for each.
    """
    known = df.where(F.col(p).isNotNull()).select(*by, F.col(p).alias("__p"))
    ranked = staged(numbered(known, [F.col("__p")], *by).withColumn("__q", F.col("__p") * F.col("size") / F.col("r")).repartitionByRange(*by, "__p").withColumn("__part", F.spark_partition_id()))
    local = F.min("__q").over(Window.partitionBy("__part", *by).orderBy(F.desc("__p")).rangeBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each partition
    later = ranked.groupBy("__part", *by).agg(F.min("__q").alias("__m")).withColumn("__later", F.min("__m").over(w.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)))
    same = lambda a, b, *on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*on, *by)]
    least = F.least(F.lit(1.0), F.col("__local"), F.col("__later"))
    found = ranked.withColumn("__local", local).alias("x").join(later.alias("y"), same("x", "y", "__part")).select(*(F.col(f"x.{c}").alias(c) for c in by), F.col("x.__p").alias("__p"), least.alias("p_adj")).groupBy(*by, "__p").agg(F.min("p_adj").alias("p_adj"))
    return df.alias("a").join(found.alias("f"), [*same("a", "f"), F.col(f"a.{p}") == F.col("f.__p")], "left").select("a.*", "f.p_adj")


def folds(df: DataFrame, k: int, seed: int, *by: str, key: str = "id") -> DataFrame:
    """Shuffled (by class, if given) k folds, decided by a hash."""
    n, r = F.col("size"), F.col("r") - 1
    large, least = n % k, F.floor(n / k)  # so many folds have one row more
    fold = F.when(r < large * (least + 1), F.floor(r / (least + 1))).otherwise(large + F.floor((r - large * (least + 1)) / F.greatest(least, F.lit(1))))
    return numbered(df, [F.xxhash64(F.lit(seed), key), F.col(key)], *by).withColumn("fold", fold.cast("int")).drop("r", "size")


def regression_scores(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """(by, r2, mae, rmse) over rows with both values; r2 is null where the target does not vary. A null key is a group of its own."""
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    res = F.col(y) - F.col(p)
    spread = F.nullif(F.sum(F.pow(F.col(y) - F.col("__mean"), 2)), F.lit(0.0))
    return _beside(df, df.groupBy(*by).agg(F.avg(y).alias("__mean")), by).groupBy(*by).agg((1 - F.sum(res * res) / spread).alias("r2"), F.avg(F.abs(res)).alias("mae"), F.sqrt(F.avg(res * res)).alias("rmse"))


def class_f1(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """F1 of each class; 0 where nothing is predicted or true."""
    true = df.select(*by, F.col(y).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col(y) == F.col(p)).cast("int").alias("tp"))
    pred = df.select(*by, F.col(p).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("tp"))
    s = true.union(pred).groupBy(*by, "cls").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("tp").alias("tp"))
    return s.select(*by, "cls", F.coalesce(2 * F.col("tp") / F.nullif(F.col("t") + F.col("q"), F.lit(0)), F.lit(0.0)).alias("f1"))


def macro_f1(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """(by, macro_f1): the mean over classes of each repeat's F1."""
    return class_f1(df, *by, y=y, p=p).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def f1_spread(df: DataFrame, folds: list[str], *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """(by, cls, mean, sd) of each class's F1 over folds."""
    return class_f1(df, *by, *folds, y=y, p=p).groupBy(*by, "cls").agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("sd"))


def replicate_means(df: DataFrame, values: list[str], *by: str) -> DataFrame:
    """Mean of each value per key (replicate strains, repeated scores); nulls are left out."""
    return df.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def standardise(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(x - mean) / population SD."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return _beside(df, s, by).withColumn("z", (F.col(value) - F.col("__m")) / F.nullif("__s", F.lit(0.0))).drop("__m", "__s")


def min_max(df: DataFrame, value: str, *by: str) -> DataFrame:
    s = df.groupBy(*by).agg(F.min(value).alias("__a"), F.max(value).alias("__z"))
    return _beside(df, s, by).withColumn("scaled", (F.col(value) - F.col("__a")) / F.nullif(F.col("__z") - F.col("__a"), F.lit(0.0))).drop("__a", "__z")


def _beside(df: DataFrame, summary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df with its group's summary; a null key is a group of its own. Partial sums and a join, no group in one task."""
    named = summary.toDF(*(f"__by{k}" for k in range(len(by))), *summary.columns[len(by):])
    return df.join(named, [df[c].eqNullSafe(named[f"__by{k}"]) for k, c in enumerate(by)]).drop(*(f"__by{k}" for k in range(len(by))))


def coefficient_summary(coefs: DataFrame) -> DataFrame:
    """Mean and SD over folds, and the mean divided by the target's largest absolute mean."""
    s = coefs.groupBy("target", "pattern_id").agg(F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("sd"))
    return s.withColumn("scaled", F.col("mean") / F.nullif(F.max(F.abs("mean")).over(Window.partitionBy("target")), F.lit(0.0)))


TERMS = ("Intercept", "treated", "dose", "neg", "treated:dose", "treated:neg")


def design(df: DataFrame) -> DataFrame:
    """Columns x0..x5 of y ~ treated * (dose + neg)."""
    t, d, n = F.col("treated").cast("double"), F.col("dose"), F.col("neg").cast("double")
    return df.withColumns({f"x{k}": c for k, c in enumerate((F.lit(1.0), t, d, n, t * d, t * n))})


def ols(df: DataFrame, *by: str, weight: Column | None = None, k: int = 6) -> DataFrame:
    """(by, term, estimate): sums of products in Catalyst, a small solve for each group."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(f"x{i}") for i in range(k)]
    sums = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * x[i] * F.col("y")).alias(f"b{i}") for i in range(k)]
    return _solved(df.groupBy(*by).agg(*sums), list(by), k)


def _solved(grams: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, term, estimate) of least squares from sums of products g{i}_{j} and b{i}, a batch of groups at once."""

    def solve(batches):
        for pdf in batches:
            g = np.stack([np.stack([pdf[f"g{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(k)], axis=1) for i in range(k)], axis=1)
            b = np.stack([pdf[f"b{i}"].to_numpy(float) for i in range(k)], axis=1)
            known = np.isfinite(g).all((1, 2)) & np.isfinite(b).all(1)
            beta = np.full((len(pdf), k), np.nan)
            beta[known] = (np.linalg.pinv(g[known], hermitian=True) @ b[known][:, :, None])[:, :, 0]
            out = pdf[by].loc[pdf.index.repeat(k)].reset_index(drop=True)
            out["term"] = [TERMS[i] if k == 6 else f"x{i}" for i in range(k)] * len(pdf)
            out["estimate"] = beta.ravel()
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema if f.name in by)
    return grams.mapInPandas(solve, kinds + ", term string, estimate double")


def _uniform(h: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each pair of a 64-bit hash and a draw's number."""
    z = h.astype(np.uint64) + (draw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def part_counts(sizes: list[int], part: int, draws: int, seed: int) -> np.ndarray:
    """How many of each replicate's sum(sizes) draws fall to one part: a multinomial by binomial splits down a tree.

    Every node of the tree has a generator of its own, so each part can follow its own branch and all agree.
    """
    ends = np.concatenate(([0], np.cumsum(sizes)))
    a, z, node, counts = 0, len(sizes), 1, np.full(draws, ends[-1], np.int64)
    while z - a > 1:
        mid = (a + z) // 2
        left = np.random.default_rng([seed, node]).binomial(counts, (ends[mid] - ends[a]) / max(1, ends[z] - ends[a]))
        a, z, node, counts = (a, mid, 2 * node, left) if part < mid else (mid, z, 2 * node + 1, counts - left)
    return counts


#: Rows of a part of a study in the bootstrap; replicates a task holds at once.
PART, REPLICATES = 4096, 250


def bootstrap(df: DataFrame, *by: str, draws: int = 5000, seed: int = 1, key: str = "row_id", k: int = 6) -> DataFrame:
    """(by, b, term, estimate) of `draws` refits on rows drawn with replacement, exactly n rows a replicate.

    A study's rows are dealt by hash to parts of about `PART`. Each replicate's n draws are split among the parts by their
    sizes, down a tree of binomial splits; a part then draws that many of its own rows and passes on sums of products only.
    No draw is shuffled; what is shuffled grows with parts and replicates. Rows that repeat a key, or have none, are rows each; a row with a null among
    its terms or y takes no part.
    """
    x = [f"x{i}" for i in range(k)]
    rows = staged(df.select(*by, F.xxhash64(F.lit(seed), key).alias("__h"), *(F.col(c).cast("double").alias(c) for c in (*x, "y"))).dropna(subset=[*x, "y"]))
    named = _beside(rows, rows.groupBy(*by).agg(F.ceil(F.count("*") / PART).cast("long").alias("__parts")), by)
    dealt = staged(named.withColumn("__part", F.pmod(F.col("__h"), F.col("__parts"))))
    sizes = dealt.groupBy(*by, "__part").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__part", "n"))).alias("__sizes"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"g{i}_{j}" for i, j in pairs] + [f"b{i}" for i in range(k)]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in dealt.schema if f.name in by)

    def draw(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = {p["__part"]: p["n"] for p in pdf["__sizes"].iloc[0]}
        parts, me = sorted(own), int(pdf["__part"].iloc[0])
        stem = int.from_bytes(hashlib.sha256(repr([str(g) for g in group[: len(by)]]).encode()).digest()[:8], "big")
        counts = part_counts([own[p] for p in parts], parts.index(me), draws, (seed + stem) % 2**63)
        pdf = pdf.sort_values(["__h", *x, "y"])
        z = pdf[x].to_numpy(float)
        y, n = pdf["y"].to_numpy(float), len(pdf)
        products = np.column_stack([z[:, i] * z[:, j] for i, j in pairs] + [z[:, i] * y for i in range(k)])
        out = np.zeros((draws, len(sums)))
        for first in range(0, draws, REPLICATES):
            these = np.arange(first, min(draws, first + REPLICATES))
            b = np.repeat(np.arange(len(these)), counts[these])
            nth = np.arange(len(b)) - np.repeat(np.cumsum(counts[these]) - counts[these], counts[these])
            h = np.uint64((seed * 0x9E3779B97F4A7C15 + stem + me * 0xD1B54A32D192ED03) % 2**64) + (these[b].astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7)
            drawn = np.minimum((_uniform(h, nth) * n).astype(np.int64), n - 1)
            weight = np.bincount(b * n + drawn, minlength=len(these) * n).reshape(len(these), n)
            out[these] = weight @ products
        return pd.DataFrame({**{c: [v] * draws for c, v in zip(by, group)}, "b": np.arange(draws, dtype=np.int32), **dict(zip(sums, out.T))})

    grams = _beside(dealt, sizes, by).groupBy(*by, "__part").applyInPandas(draw, kinds + "b int, " + ", ".join(f"{c} double" for c in sums))
    return _solved(grams.groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in sums)), [*by, "b"], k)


def bootstrap_summary(boot: DataFrame, point: DataFrame, *by: str) -> DataFrame:
    """SE, 2.5 and 97.5 % bounds and the empirical sign p: (opposite signs + 1) / (B + 1)."""
    est = point.withColumnRenamed("estimate", "est")
    s = boot.join(est, [*by, "term"]).groupBy(*by, "term").agg(
        F.first("est").alias("estimate"), F.stddev_samp("estimate").alias("boot_se"), F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
        ((F.count_if(F.signum("estimate") != F.signum("est")) + 1) / (F.count("*") + 1)).alias("p_emp"))
    return s.select(*by, "term", "estimate", "boot_se", F.col("ci")[0].alias("ci_lo"), F.col("ci")[1].alias("ci_hi"),
                    F.when(F.col("term") != "Intercept", F.exp("estimate")).alias("exp_beta"), F.when(F.col("term") != "Intercept", (F.exp("estimate") - 1) * 100).alias("pct_change"), F.least(F.lit(1.0), "p_emp").alias("p_emp"))


def equimolar(summary: DataFrame, dose: float) -> DataFrame:
    """Slope and interaction rows again at the whole dose, each after its row."""
    row = F.struct(*(F.col(c) for c in ("term", "estimate", "ci_lo", "ci_hi")), F.lit(0).alias("place"))
    scaled = F.struct(F.concat("term", F.lit(f" x {dose:g}")).alias("term"), *((F.col(c) * dose).alias(c) for c in ("estimate", "ci_lo", "ci_hi")), F.lit(1).alias("place"))
    keep = [c for c in summary.columns if c not in ("term", "estimate", "ci_lo", "ci_hi")]
    both = F.when(F.col("term").isin("dose", "treated:dose"), F.array(row, scaled)).otherwise(F.array(row))
    return summary.select(*keep, F.explode(both).alias("r")).select(*keep, "r.*")
