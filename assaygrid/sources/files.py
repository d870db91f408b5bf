"""Scans of laboratory files and sinks for results. All read by glob, distributed; long output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def reader_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_time, well, od) of plate-reader files: header time, then `A01: 0.123` lines after `Measurement Data`."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="AUTOMATED*").select(F.input_file_name().alias("file"), "value")
    stamp = F.concat_ws(" ", F.regexp_extract("value", r"Date:\s*(\d{2}/\d{2}/\d{4})", 1), F.regexp_extract("value", r"Time:\s*(\d{2}:\d{2}:\d{2})", 1))
    body = F.regexp_extract("value", r"(?s)Measurement Data(.*)", 1)
    lines = raw.select("file", F.try_to_timestamp(stamp, F.lit("dd/MM/yyyy HH:mm:ss")).alias("file_time"), F.explode(F.split(body, r"\r?\n")).alias("line"))
    well, od = F.regexp_extract("line", r"^\s*([A-H](?:0[1-9]|1[0-2])):\s*(\S+)\s*$", 1), F.regexp_extract("line", r"^\s*([A-H](?:0[1-9]|1[0-2])):\s*(\S+)\s*$", 2).try_cast("double")
    return lines.select("file", "file_time", well.alias("well"), od.alias("od")).where((F.col("well") != "") & F.col("od").isNotNull())


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, orf) of a two-column map with a header; the organism's prefix is stripped. Small enough to broadcast behind a count."""
    return delimited(spark, path, "id string, orf string").select("id", F.regexp_replace("orf", "^sce:", "").alias("orf"))


def orf_names(spark: SparkSession, path: str) -> DataFrame:
    """(orf, name): second and fourth column of a table without a header."""
    return spark.read.csv(path, sep="\t", header=False, schema="a string, orf string, b string, name string").select("orf", "name")


PROTOCOL = ("logic_program string, experiments array<struct<experiment:int,baseline_media:string,media_supplementation:string,media_supplementation_doses:string,"
            "treatment:string,treatment_parameters:string,sampling_time:double,type:string,summary:string>>")


def protocols(spark: SparkSession, path: str) -> DataFrame:
    """One row for each experiment of each protocol."""
    return spark.read.json(path, schema=PROTOCOL, multiLine=True).select("logic_program", F.explode("experiments").alias("e")).select("logic_program", "e.*")


def hypotheses(spark: SparkSession, root: str) -> DataFrame:
    """Hypothesis records below a root, with the creation time out of the folder name (12 digits at its end).

    Folders without a record give no row; a folder named otherwise gives a null time.
    """
    from assaygrid.functions.scalars import folder_time

    kinds = "logic_program string, observable string, qualifier string, initial_prompt string, motivation string, coefficient double"
    rows = spark.read.json(root, schema=kinds, multiLine=True, recursiveFileLookup=True, pathGlobFilter="hypothesis_details.json")
    file = F.input_file_name()
    dated = F.regexp_extract(file, r"/[^/]*?(\d{12})(?=/)", 1)
    return rows.withColumn("file", file).withColumn("created", folder_time(dated))


def instrument_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, kind, row, well, t) of well starts and timings."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    r, c = F.regexp_extract("text", r"process_well\(\s*\)\s*\(\s*(\d+)", 1).try_cast("int"), F.regexp_extract("text", r"process_well\(\s*\)\s*\(\s*\d+\s*,\s*(\d+)", 1).try_cast("int")
    t = F.regexp_extract("text", r",\s*t\s*=\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    got = lines.select("file", "line", r.alias("row"), c.alias("col"), t.alias("t")).where("row is not null or t is not null")
    return got.select("file", "line", F.when(F.col("row").isNotNull(), "well").otherwise("time").alias("kind"), "row", F.concat(F.char(F.col("row") + 64), F.col("col").cast("string")).alias("well"), "t")


def facts(spark: SparkSession, path: str, predicate: str, names: list[str]) -> DataFrame:
    """Ground facts `predicate('a','b').`; comment lines start with %."""
    args = F.regexp_extract_all("value", F.lit(r"'((?:[^'\\]|\\.)*)'"), F.lit(1))
    rows = spark.read.text(path).where(~F.col("value").startswith("%") & F.col("value").startswith(predicate + "(")).select(args.alias("a"))
    return rows.where(F.size("a") == len(names)).select(*(F.col("a")[k].alias(n) for k, n in enumerate(names)))


def examples(spark: SparkSession, path: str, first: str | None = None) -> DataFrame:
    """Genes of `gene('X').` lines, a chosen one in front."""
    return facts(spark, path, "gene", ["gene"]).orderBy((F.col("gene") == F.lit(first)).desc(), "gene")


def write_examples(genes: DataFrame, path: str, first: str | None = None) -> None:
    """gene('X'). lines with a chosen gene in front, as one ordered list."""
    one = genes.select("gene").distinct().orderBy(F.coalesce(F.col("gene") == F.lit(first), F.lit(False)).desc(), "gene")
    one.select(F.concat(F.lit("gene('"), "gene", F.lit("').")).alias("value")).write.mode("overwrite").text(path)


def feature_matrix(spark: SparkSession, path: str, gene: str) -> DataFrame:
    """(row, pattern) of space-separated 0/1 rows, patterns named <gene>_ilp<i>."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("row", "line"))
    cells = lines.select("row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "v"))
    return cells.where("v = '1'").select("row", F.concat(F.lit(f"{gene}_ilp"), "i").alias("pattern"))


def explanations(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, clause, pos_cover) of `feature(N,(head:-body)).` lines with the support noted before them."""
    pieces = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(\[pos cover = \d+.*?feature\(\d+,\(.*?\)\)\.)"), F.lit(1))).alias("x"))
    return pieces.select("file", F.regexp_extract("x", r"feature\((\d+),", 1).cast("int").alias("id"), F.regexp_extract("x", r"(?s)feature\(\d+,\((.*)\)\)\.", 1).alias("clause"), F.regexp_extract("x", r"pos cover = (\d+)", 1).cast("int").alias("pos_cover"))


def coefficients(spark: SparkSession, path: str, n_folds: int) -> DataFrame:
    """(target, pattern_id, fold, coef) of one file a target, rows patterns and columns folds."""
    wide = spark.read.csv(path, header=True, schema="pattern_id string, " + ", ".join(f"f{k} double" for k in range(n_folds)))
    wide = wide.withColumn("target", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return wide.unpivot(["target", "pattern_id"], [f"f{k}" for k in range(n_folds)], "fold", "coef").withColumn("fold", F.substring("fold", 2, 9).cast("int"))


_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)'


_QUAD = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$"


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of lines that are no quad, no comment and not blank."""
    return spark.read.text(path).where(~F.col("value").rlike(_QUAD) & ~F.col("value").rlike(r"^\s*(?:#.*)?$")).select(F.input_file_name().alias("file"), "value")


def n_quads(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Quads of N-Quads files; blank nodes are named by file, which they are scoped to; the default graph is ''.

    A line that is no quad is an error; with `strict` false it is left out, and `unreadable` lists it.
    """
    rx = _QUAD
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    good = F.col("value").rlike(rx)
    lines = lines.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("no quad: "), "value")).cast("boolean"))) if strict else lines.where(good)
    rows = lines.withColumn("file", F.sha2(F.input_file_name(), 256))
    part = lambda k: F.regexp_extract("value", rx, k)
    plain = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:"), "file", F.lit("-"), F.substr(c, F.lit(3)))).when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1))
    o = part(3)
    return rows.select(plain(part(4)).alias("g"), plain(part(1)).alias("s"), plain(part(2)).alias("p"), plain(o).alias("o"), F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "blank").otherwise("literal").alias("o_kind"),
                       F.nullif(F.regexp_extract(o, r'\^\^<([^>]*)>$', 1), F.lit("")).alias("o_dtype"), F.nullif(F.regexp_extract(o, r'"@([\w-]+)$', 1), F.lit("")).alias("o_lang"))


def write_quads(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").partitionBy("g").parquet(path)


def write_n_quads(store: DataFrame, path: str) -> None:
    iri = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    literal = F.concat(F.lit('"'), "o", F.lit('"'), F.when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(""))
    store.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(iri("o")), F.when(F.col("g") != "", iri("g")), F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def write_stage(df: DataFrame, path: str, tsv: bool = False) -> None:
    """A stage's checkpoint: Parquet, or TSV with a header."""
    w = df.write.mode("overwrite")
    w.csv(path, sep="\t", header=True) if tsv else w.parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A query's result as TSV with a header; an ASK's answer is the one row of `graph.asked`."""
    write_stage(df, path, tsv=True)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def append_lines(lines: DataFrame, path: str, run: str | None = None) -> None:
    """Adds lines to a list. A run with a name replaces what a run of that name wrote before, so that it can be repeated; one without adds."""
    value = lines.select(F.col("line").alias("value"))
    if run is None:
        value.write.mode("append").text(path)
    else:  # only the folder of this run is overwritten; a run without lines leaves the list as it is
        value.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path)


def reference_library(flat: DataFrame) -> dict[str, DataFrame]:
    """A flat table of molecules, ions and values as three keyed tables; a missing column is an error."""
    need = {"molecule", "formula", "adduct", "precursor_mz", "ccs"}
    if gone := need - set(flat.columns):
        raise ValueError(f"columns are missing: {sorted(gone)}")
    key = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256)
    mol, ion = key("molecule", "formula"), key("molecule", "formula", "adduct")
    return {"molecules": flat.select(mol.alias("molecule_id"), "molecule", "formula").distinct(), "ions": flat.select(ion.alias("ion_id"), mol.alias("molecule_id"), "adduct", "precursor_mz").distinct(), "ccs_values": flat.select(ion.alias("ion_id"), "ccs")}
