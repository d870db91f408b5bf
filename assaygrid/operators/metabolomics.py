"""Peak tables in long form: (study, sample, feature, molecule, area, kind) with kind QC, Blank or a group.

The order of the steps matters; `preprocess` chains them. Zero counts as missing only where `missing` is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assaygrid.operators.staging import staged


def is_bio() -> Column:
    return ~F.col("kind").isin("QC", "Blank")



def missing(area: Column) -> Column:
    return F.nullif(F.nanvl(area, F.lit(0.0)), F.lit(0.0)).isNull()


def keep_features(peaks: DataFrame, kept: DataFrame) -> DataFrame:
    return peaks.join(kept.select("study", "feature"), ["study", "feature"], "left_semi")


def injected(rows: DataFrame, valid: DataFrame, fixed: tuple[str, ...] = ("MAT1", "MAT2")) -> DataFrame:
    """Rows whose well passed the log check, and those of the QC and blank positions."""
    passed = valid.select("well").union(valid.sparkSession.createDataFrame([(w,) for w in fixed], "well string")).distinct()
    return rows.join(passed, "well", "left_semi")


def with_group(rows: DataFrame, group: str = "kind") -> DataFrame:
    """Without rows that have no group."""
    return rows.dropna(subset=[group])


def drop_empty(peaks: DataFrame) -> DataFrame:
    """Without features that have no value at all."""
    return keep_features(peaks, peaks.groupBy("study", "feature").agg(F.count("area").alias("n")).where("n > 0"))


def missing_share(peaks: DataFrame, most: float, only: Column | None = None) -> DataFrame:
    """Without features whose share of missing or zero areas (in rows where `only` holds) exceeds `most`."""
    rows = peaks if only is None else peaks.where(only)
    bad = rows.groupBy("study", "feature").agg(F.avg(missing(F.col("area")).cast("double")).alias("share")).where(F.col("share") > most)
    return peaks.join(bad, ["study", "feature"], "left_anti")


def blank_filter(peaks: DataFrame, ratio: float = 1.0, first_blank: Column | None = None) -> DataFrame:
    """Without features whose mean in biological samples is under `ratio` times that in blanks; no value counts as 0."""
    area = F.coalesce(F.col("area"), F.lit(0.0))
    blank = (F.col("kind") == "Blank") & (F.lit(True) if first_blank is None else ~first_blank)
    means = peaks.groupBy("study", "feature").agg(F.avg(F.when(is_bio(), area)).alias("bio"), F.avg(F.when(blank, area)).alias("blank"))
    return peaks.join(means.where(F.col("bio") < F.col("blank") * ratio), ["study", "feature"], "left_anti")


def half_minimum(peaks: DataFrame) -> DataFrame:
    """Zero areas become half the feature's smallest other area."""
    least = F.min(F.when(F.col("area") != 0, F.col("area"))).over(Window.partitionBy("study", "feature"))
    return peaks.withColumn("area", F.when(F.col("area") == 0, least / 2).otherwise(F.col("area")))


def best_adducts(peaks: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(study, molecule, feature, rsd): of each molecule the feature with the lowest relative SD in QC, if enough QCs have it."""
    qc = peaks.where(F.col("kind") == "QC").groupBy("study", "molecule", "feature").agg(
        (F.stddev_samp("area") / F.avg("area") * 100).alias("rsd"), F.avg(F.col("area").isNotNull().cast("double")).alias("seen"))
    w = Window.partitionBy("study", "molecule").orderBy("rsd", "feature")
    return qc.where((F.col("seen") >= coverage) & F.col("rsd").isNotNull()).withColumn("k", F.row_number().over(w)).where("k = 1").select("study", "molecule", "feature", "rsd")


def agreeing_pairs(peaks: DataFrame, share: float = 2 / 3) -> DataFrame:
    """(study, f1, f2, share): features equal in at least `share` of all samples. An equality join on sample and area, no pair without an equal value."""
    n = peaks.groupBy("study").agg(F.count_distinct("sample").alias("n"))
    a = peaks.where(F.col("area").isNotNull()).select("study", "sample", "area", F.col("feature").alias("f1"))
    same = a.join(a.withColumnRenamed("f1", "f2"), ["study", "sample", "area"]).where("f1 < f2")
    return same.groupBy("study", "f1", "f2").agg(F.count("*").alias("k")).join(n, "study").withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= share).select("study", "f1", "f2", "share")


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """(study, feature, seed): features in name order open a group unless an earlier seed agrees; not transitive.

    Pairs are few (features of one instrument run), and each round settles every feature whose earlier partners are settled.
    """
    nodes = pairs.select("study", F.col("f1").alias("f")).union(pairs.select("study", "f2")).distinct()
    pairs, state = staged(pairs), staged(nodes.withColumn("seed", F.lit(None).cast("string")))
    while not state.where("seed is null").isEmpty():  # the first open feature by name is settled in each round
        known = pairs.join(state.withColumnRenamed("f", "f1"), ["study", "f1"]).groupBy("study", F.col("f2").alias("f")).agg(
            F.min(F.when(F.col("seed") == F.col("f1"), F.col("f1"))).alias("by"), F.min(F.when(F.col("seed").isNull(), F.col("f1"))).alias("wait"))
        step = state.join(known, ["study", "f"], "left")
        ready = F.col("wait").isNull() | (F.col("by") < F.col("wait"))
        state = staged(step.select("study", "f", F.coalesce("seed", F.when(ready, F.coalesce("by", "f"))).alias("seed")))
    return state.select("study", F.col("f").alias("feature"), "seed")


def merge_features(peaks: DataFrame, groups: DataFrame) -> DataFrame:
    """Grouped features become one, the mean of their areas, named by all members joined with /."""
    names = groups.groupBy("study", "seed").agg(F.array_join(F.array_sort(F.collect_list("feature")), "/").alias("name"))
    named = groups.join(names, ["study", "seed"]).select("study", "feature", "name")
    got = peaks.join(named, ["study", "feature"], "left").withColumn("feature", F.coalesce("name", "feature"))
    return got.groupBy("study", "sample", "kind", "feature").agg(F.avg("area").alias("area"))


def sample_filter(peaks: DataFrame, most: float = 0.5) -> DataFrame:
    """Without samples that miss more than a share of the features."""
    bad = peaks.groupBy("study", "sample").agg(F.avg(F.col("area").isNull().cast("double")).alias("s")).where(F.col("s") > most)
    return peaks.join(bad, ["study", "sample"], "left_anti")


def pqn(peaks: DataFrame) -> DataFrame:
    """Probabilistic quotient normalisation against good QCs; biological samples only.

    A QC is good within 3 MAD of the median total; features absent in over half the good QCs go; a sample's factor is its
    median quotient to the QC median of each feature, 1 if that is 0 or unknown.
    """
    totals = peaks.where(F.col("kind") == "QC").groupBy("study", "sample").agg(F.sum("area").alias("total"))
    mid = totals.groupBy("study").agg(F.median("total").alias("mid"))
    dev = totals.join(mid, "study").withColumn("dev", F.abs(F.col("total") - F.col("mid")))
    good = dev.join(dev.groupBy("study").agg(F.median("dev").alias("mad")), "study").where((F.col("mad") == 0) | (F.col("dev") / F.col("mad") < 3)).select("study", "sample")
    reference = peaks.join(good, ["study", "sample"], "left_semi").groupBy("study", "feature").agg(F.median("area").alias("ref"), F.avg(F.col("area").isNull().cast("double")).alias("gone")).where("gone <= 0.5")
    bio = peaks.where(is_bio()).join(reference.select("study", "feature", "ref"), ["study", "feature"])
    factor = bio.groupBy("study", "sample").agg(F.median(F.col("area") / F.nullif("ref", F.lit(0.0))).alias("f"))
    f = F.when(F.coalesce(F.col("f"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("f"))
    return bio.join(factor, ["study", "sample"]).select("study", "sample", "kind", "feature", (F.col("area") / f).alias("area"))


def preprocess(peaks: DataFrame) -> DataFrame:
    """All steps in order, from raw peaks to normalised biological samples."""
    p = staged(missing_share(drop_empty(staged(peaks)), 0.4, F.col("kind") == "QC"))
    p = staged(blank_filter(p).where(F.col("kind") != "Blank"))
    p = staged(half_minimum(missing_share(p, 1 / 3)))
    p = staged(keep_features(p, best_adducts(p)))
    p = staged(merge_features(p, greedy_groups(agreeing_pairs(p))))
    return pqn(staged(sample_filter(p)))


def to_matrix(peaks: DataFrame) -> DataFrame:
    """Sample by feature; a pair that stands twice is an error."""
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("a sample and feature pair stands twice"))).otherwise(F.first("area"))
    return peaks.groupBy("study", "sample", "feature").agg(one.alias("area")).groupBy("study", "sample").pivot("feature").agg(F.first("area"))
