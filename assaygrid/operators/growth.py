"""Growth curves in long form: (study, plate, well, t_index, t_sec, od, grp). One shuffle by well serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assaygrid.functions.scalars import euclid
from assaygrid.operators.stats import _beside, numbered

KEY = ("study", "plate", "well")
CONTROL = "Media control"


def _by(*more):
    return Window.partitionBy(*KEY).orderBy("t_index", *more)


def time_axis(readings: DataFrame, step: int = 1200) -> DataFrame:
    """k-th file in time order <-> step * k seconds, by plate.

    A plate's times are ranked in ranges, so one plate may hold all files. t_sec is an int, and a bigint where the last second of some
    plate is beyond an int.
    """
    times = numbered(readings.select("study", "plate", "file_time").distinct(), [F.col("file_time")], "study", "plate").drop("size")
    last = times.agg(F.max("r")).first()[0] or 1
    kind = "int" if (last - 1) * step < 1 << 31 else "bigint"
    times = times.withColumn("t_index", (F.col("r") - 1).cast("int")).drop("r")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("study", "plate", "file_time")]
    return readings.alias("a").join(times.alias("b"), same).select("a.*", "t_index", (F.col("t_index").cast(kind) * F.lit(step).cast(kind)).alias("t_sec"))


def with_layout(curves: DataFrame, layout: DataFrame) -> DataFrame:
    return curves.join(layout, ["study", "plate", "well"])


def rolling_median(curves: DataFrame) -> DataFrame:
    """Centred median of three (fewer at the ends); it replaces the data, as in the original workflow."""
    a, b, c = F.lag("od").over(_by()), F.col("od"), F.lead("od").over(_by())
    n = sum((x.isNotNull().cast("int") for x in (a, b, c)), F.lit(0))
    least, most = F.least(a, b, c), F.greatest(a, b, c)  # of those that are there
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return curves.withColumn("od", F.when(n == 3, middle).otherwise((least + most) / 2))


def total_variation(curves: DataFrame) -> DataFrame:
    diff = F.abs(F.col("od") - F.lag("od").over(_by()))
    return curves.withColumn("d", diff).groupBy(*KEY).agg(F.sum("d").alias("tv"))


def features(curves: DataFrame) -> DataFrame:
    """AUC by trapezoid over seconds, largest OD (0 for media controls), total variation, last OD and group of each well."""
    step = curves.withColumn("area", (F.col("od") + F.lag("od").over(_by())) / 2 * (F.col("t_sec") - F.lag("t_sec").over(_by()))).withColumn("d", F.abs(F.col("od") - F.lag("od").over(_by())))
    return step.groupBy(*KEY).agg(F.sum("area").alias("auc"), F.max("od").alias("m"), F.sum("d").alias("tv"), F.max_by("od", "t_index").alias("last_od"), F.first("grp").alias("grp")).select(
        *KEY, "grp", "auc", F.when(F.col("grp") == CONTROL, 0.0).otherwise(F.col("m")).alias("final_od"), "tv", "last_od")


def mean_curves(curves: DataFrame) -> DataFrame:
    return curves.groupBy("study", "grp", "t_index").agg(F.avg("od").alias("od"), (F.first("t_sec") / 3600).alias("hours"))


def mad_outliers(feats: DataFrame, limit: float = 3.0) -> DataFrame:
    """Flags wells whose log AUC, last value or total variation lies beyond limit * MAD + 1e-6 of the group's median; wells without a group are one."""
    grp, of, feats = ("study", "plate", "grp"), ("log_auc", "last_od", "tv"), feats.withColumn("log_auc", F.log(F.col("auc")))
    mid = feats.groupBy(*grp).agg(*(F.median(c).alias(f"{c}_mid") for c in of))
    dev = _beside(feats, mid, grp).withColumns({f"{c}_dev": F.abs(F.col(c) - F.col(f"{c}_mid")) for c in of})
    mad = dev.groupBy(*grp).agg(*(F.median(f"{c}_dev").alias(f"{c}_mad") for c in of))
    out = _beside(dev, mad, grp).withColumns({f"{c}_out": F.coalesce(F.col(f"{c}_dev") > limit * F.col(f"{c}_mad") + 1e-6, F.lit(False)) for c in of})
    out = out.withColumn("outlier", F.col("log_auc_out") | F.col("last_od_out") | F.col("tv_out"))
    return out.drop(*(f"{c}_{k}" for c in of for k in ("mid", "dev", "mad")))


def without_controls(wells: DataFrame) -> DataFrame:
    """Before modelling: no media controls; wells without a group stay out too."""
    return wells.where(F.col("grp") != CONTROL)


def with_design(rows: DataFrame, design: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a layout, protocol or design table; rows without a match stay, exact repeats fall together."""
    return rows.join(design, on, "left").distinct()


def with_parameters(rows: DataFrame, parameters: DataFrame, on: list[str]) -> DataFrame:
    """Inner join to growth parameters: rows without a curve drop out."""
    return rows.join(parameters, on)


def nearest_blanks(wells: DataFrame, k: int = 5) -> DataFrame:
    """(well, blank): the k blanks of the plate with least distance; ties in plate order. `wells` has one row a well with row, col, grp."""
    blanks = wells.where(F.col("grp") == CONTROL).select("study", "plate", F.col("well").alias("blank"), F.col("row").alias("br"), F.col("col").alias("bc"))
    d = euclid(F.col("row"), F.col("col"), F.col("br"), F.col("bc"))
    near = Window.partitionBy(*KEY).orderBy("d", "br", "bc")
    return wells.join(blanks, ["study", "plate"]).withColumn("d", d).withColumn("k", F.row_number().over(near)).where(F.col("k") <= k).select(*KEY, "blank", "k", "d")


def subtract_blanks(curves: DataFrame, wells: DataFrame, k: int = 5, fill: float = 0.01) -> DataFrame:
    """Each reading less the mean of its nearest blanks at that time, clamped at `fill`; a plate without blanks passes unchanged."""
    near = nearest_blanks(wells, k)
    of = curves.select("study", "plate", F.col("well").alias("blank"), "t_index", F.col("od").alias("b"))
    mean = near.join(of, ["study", "plate", "blank"]).groupBy(*KEY, "t_index").agg(F.avg("b").alias("blank_od"))
    got = curves.join(mean, [*KEY, "t_index"], "left")
    return got.withColumn("od", clamp(F.col("od") - F.coalesce("blank_od", F.lit(0.0)), fill)).withColumn("blanked", F.col("blank_od").isNotNull()).drop("blank_od")


def clamp(od: Column, fill: float) -> Column:
    return F.when(od < 0, fill).otherwise(od)


def _local_line(pairs: DataFrame) -> DataFrame:
    """Weighted straight line through (j, y) with weights w, read at i."""
    s = pairs.groupBy(*KEY, "i").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("j")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"),
                                     F.sum(F.col("w") * F.col("j") * F.col("j")).alias("sxx"), F.sum(F.col("w") * F.col("j") * F.col("y")).alias("sxy"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    fit = F.when(F.abs(det) < 1e-12, F.col("sy") / F.col("sw")).otherwise((F.col("sy") - slope * F.col("sx")) / F.col("sw") + slope * F.col("i"))
    return s.select(*KEY, "i", fit.alias("fit"))


def loess(curves: DataFrame, frac: float = 0.2) -> DataFrame:
    """Local linear smoothing over the reading index: tricube weights on the ceil(frac n) nearest, one bisquare pass.

    Null readings take no part and stay null.
    """
    y = curves.where(F.col("od").isNotNull()).select(*KEY, F.col("t_index").alias("j"), F.col("od").alias("y"))
    whole = y.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("ys"))  # the readings of one curve
    n = F.size("ys")
    k = F.greatest(F.lit(2), F.ceil(n * frac)).cast("int")
    # the k nearest readings lie within k places of the reading itself
    at = whole.select(*KEY, k.alias("k"), "ys", F.posexplode("ys").alias("at", "own")).withColumn("i", F.col("own.j"))
    first = F.greatest(F.col("at") - F.col("k"), F.lit(0))
    around = F.slice("ys", first + 1, 2 * F.col("k") + 1)
    nearest = F.slice(F.array_sort(F.transform(around, lambda e: F.struct(F.abs(e["j"] - F.col("i")).alias("d"), e["j"].alias("j"), e["y"].alias("y")))), F.lit(1), F.col("k"))
    near = at.select(*KEY, "i", F.explode(F.array(nearest)).alias("e")).withColumn("h", F.element_at("e", -1)["d"]).select(*KEY, "i", "h", F.inline("e"))
    h = F.col("h")
    near = near.withColumn("tri", F.when(h == 0, 1.0).otherwise(F.pow(1 - F.pow(F.col("d") / (h * 1.0000001), 3), 3)))
    first = _local_line(near.withColumn("w", F.col("tri")))
    res = y.join(first.withColumnRenamed("i", "j"), [*KEY, "j"]).withColumn("r", F.abs(F.col("y") - F.col("fit")))
    s = res.groupBy(*KEY).agg(F.median("r").alias("s"))
    u = F.col("r") / (6 * F.col("s"))
    robust = res.join(s, list(KEY)).select(*KEY, "j", F.when(F.col("s") == 0, 1.0).when(u >= 1, 1e-9).otherwise(F.pow(1 - u * u, 2)).alias("b"))
    second = _local_line(near.join(robust, [*KEY, "j"]).withColumn("w", F.col("tri") * F.col("b")))
    return curves.join(second.withColumnRenamed("i", "t_index"), [*KEY, "t_index"], "left").withColumn("od", F.col("fit")).drop("fit")


def growth_rate(curves: DataFrame, skip: int = 18, width: int = 5) -> DataFrame:
    """(well, start, end, mu): the steepest log-linear stretch after the first `skip` readings; 0 where there is none."""
    late = curves.where((F.col("t_index") >= skip) & (F.col("od") > 0)).withColumn("h", F.col("t_sec") / 3600).withColumn("l", F.log("od"))
    w = _by().rowsBetween(-(width - 1), 0)
    fit = late.withColumn("mu", F.regr_slope("l", "h").over(w)).withColumn("k", F.count("*").over(w)).withColumn("start", F.min("h").over(w)).where(F.col("k") == width)
    best = fit.groupBy(*KEY).agg(F.max_by(F.struct("start", F.col("h").alias("end"), "mu"), F.struct("mu", -F.col("h"))).alias("p"))
    return curves.select(*KEY).distinct().join(best, list(KEY), "left").select(*KEY, "p.start", "p.end", F.coalesce("p.mu", F.lit(0.0)).alias("mu"))


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Columns named by seconds become rows (t_sec, od)."""
    times = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, times, "t_sec", "od").withColumn("t_sec", F.col("t_sec").cast("int"))
