"""Plates, dosing tables and run lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assaygrid.functions.scalars import unify_well, well_name
from assaygrid.operators.staging import written
from assaygrid.operators.texts import contained


def plate(spark: SparkSession, rows: int = 8, cols: int = 12) -> DataFrame:
    """(well, row, col, place) of a plate, in plate order."""
    n = spark.range(rows * cols)
    r, c = (F.col("id") / cols).cast("int") + 1, (F.col("id") % cols + 1).cast("int")
    return n.select(well_name(r, c).alias("well"), r.alias("row"), c.alias("col"), F.col("id").cast("int").alias("place"))


def fill_plates(used: DataFrame, placeholder: str) -> DataFrame:
    """Wells of each plate that are not used, with a placeholder label, beside the used ones."""
    wells = plate(used.sparkSession).select("well")
    every = used.select("plate").distinct().join(F.broadcast(wells))
    rest = every.join(used, ["plate", "well"], "left_anti").withColumn("label", F.lit(placeholder))
    return used.select("plate", "well", "label").unionByName(rest.select("plate", "well", "label"))


def closest_stock(doses: DataFrame, stocks: DataFrame, times: float = 5.0) -> DataFrame:
    """(dose_id, stock): the smallest stock at least `times` the dose, else the smallest of the compound."""
    got = doses.join(stocks, "compound").groupBy("dose_id").agg(F.min(F.when(F.col("stock") >= times * F.col("dose"), F.col("stock"))).alias("fit"), F.min("stock").alias("least"))
    return got.select("dose_id", F.coalesce("fit", "least").alias("stock"))


def highest_doses(experiments: DataFrame) -> DataFrame:
    """(study, role, name, dose): the compound with the highest dose of each role; ties by name."""
    return experiments.groupBy("study", "role").agg(F.max_by(F.struct("name", "dose"), F.struct("dose", "name")).alias("b")).select("study", "role", "b.name", "b.dose")


def wells_by_condition(layout: DataFrame) -> DataFrame:
    return layout.groupBy("summary").agg(F.array_join(F.array_sort(F.collect_list("well")), ",").alias("wells"))


def channel_bits(dispensing: DataFrame) -> DataFrame:
    """(plate, col, reagent, bits): one character for each well of a plate column in row order, 1 where something is dispensed."""
    bit = F.when(F.coalesce(F.col("volume"), F.lit(0.0)) != 0, "1").otherwise("0")
    pairs = F.array_sort(F.collect_list(F.struct("row", bit.alias("bit"))))
    return dispensing.groupBy("plate", "col", "reagent").agg(F.array_join(F.transform(pairs, lambda x: x["bit"]), "").alias("bits"))


def round_robin(samples: DataFrame, seed: int, by: str = "plate") -> DataFrame:
    """Order that takes one sample of each group a round; the order within rounds and groups comes from a hash."""
    h = F.xxhash64(F.lit(seed), "well")
    turn = F.row_number().over(Window.partitionBy(by, "grp").orderBy(h, "well"))
    return samples.withColumn("turn", turn).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("turn", h, "well")))


def run_list(ordered: DataFrame, n: int = 6, blanks: int = 4, by: str = "plate") -> DataFrame:
    """(by, run, name): 1 tune and 4 blanks, then blocks of 2 QC, n samples (the last may be short), 1 QC and the blanks."""
    s = ordered.select(by, ((F.col("place") - 1) / n).cast("int").alias("block"), (F.lit(10) + (F.col("place") - 1) % n).cast("int").alias("slot"), F.col("well").alias("name"))
    control = lambda name, at: F.struct(F.lit(at).alias("slot"), F.lit(name).alias("name"))
    around = F.array(control("QC", 0), control("QC", 1), control("QC", 1000), *(control("Blank", 1001 + k) for k in range(blanks)))
    controls = s.select(by, "block").distinct().select(by, "block", F.explode(around).alias("c")).select(by, "block", "c.*")
    start = F.array(control("Tune", 0), *(control("Blank", 1 + k) for k in range(4)))
    first = s.select(by).distinct().select(by, F.lit(-1).alias("block"), F.explode(start).alias("c")).select(by, "block", "c.*")
    return s.unionByName(controls).unionByName(first).withColumn("run", F.row_number().over(Window.partitionBy(by).orderBy("block", "slot"))).select(by, "run", "name")


def paired_timings(events: DataFrame, most: float = 0.6) -> DataFrame:
    """(file, well) of timing lines right after a well line, in time and not on the control row 1000. A timing line whose previous event is a timing line has no well left."""
    w = Window.partitionBy("file").orderBy("line")
    prev = events.withColumn("before", F.lag("kind").over(w)).withColumn("well", F.lag("well").over(w)).withColumn("row", F.lag("row").over(w))
    return prev.where((F.col("kind") == "time") & (F.col("before") == "well") & (F.col("row") != 1000) & (F.col("t") <= most)).select("file", "line", "well", "t")


def dispensing(doses: DataFrame, layout: DataFrame) -> DataFrame:
    """Each dose row with the wells of its summary (left: a summary without a well stays), wells spelled alike."""
    return doses.join(layout.select("summary", "well"), "summary", "left").withColumn("well", unify_well(F.col("well")))


def library_matches(wanted: DataFrame, library: DataFrame, key: str = "key") -> DataFrame:
    """(key, library columns): library rows that hold a wanted key in any column, whatever the case.

    A row comes once for each spelling of a key that it holds, and a repeated row as often as it is repeated. Null and empty keys are in no row.
    """
    names = [f"`{c}`" for c in library.columns]
    rows = written(library.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("at")))
    keys = wanted.select(F.col(key).cast("string").alias("key")).where("key <> ''").distinct().withColumn("needle", F.lower("key"))
    texts = F.array_distinct(F.array(*(F.lower(F.col(f"row.{c}").cast("string")) for c in names)))
    texts = rows.select("at", F.explode(texts).alias("line"))
    hits = contained(keys, texts).join(texts, "line").select("needle", "at").distinct()
    return hits.join(keys, "needle").join(rows, "at").select(F.col("key").alias(key), *(F.col(f"row.{c}") for c in names))


def record_of(records: DataFrame, column: str, value: str) -> DataFrame:
    """The one record whose column has the value: the first by all its fields where there are several."""
    return records.where(F.col(column) == value).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns)))).limit(1)
