"""The driver's tables in the roles of laboratory data: the same rows as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaygrid.functions.scalars import well_name

GROWTH_SQL = """
growth AS (SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS study, user_id // 96 AS plate, chr(CAST(65 + (user_id % 96) // 12 AS INTEGER)) || CAST((user_id % 96) % 12 + 1 AS VARCHAR) AS well,
  CAST((user_id % 96) // 12 + 1 AS INTEGER) AS row, CAST((user_id % 96) % 12 + 1 AS INTEGER) AS col, CAST(day(ts) - 1 AS INTEGER) AS t_index, CAST((day(ts) - 1) * 1200 AS INTEGER) AS t_sec,
  sum(CAST(round(value * 100) AS BIGINT)) / 10007.0::DOUBLE / count(*) AS od, CASE WHEN user_id % 8 = 7 THEN 'Media control' ELSE 'g' || CAST(user_id % 8 AS VARCHAR) END AS grp
  FROM events WHERE value IS NOT NULL GROUP BY user_id, day(ts))"""
PEAKS_SQL = """
peaks AS (SELECT 's' || CAST(o_custkey % 3 AS VARCHAR) AS study, 'x-y-' || CAST(o_custkey AS VARCHAR) AS sample, 'm' || CAST((l_partkey % 40) % 20 AS VARCHAR) AS molecule,
  'm' || CAST((l_partkey % 40) % 20 AS VARCHAR) || ' [a' || CAST((l_partkey % 40) // 20 AS VARCHAR) || ']' AS feature,
  CASE WHEN o_custkey % 10 = 0 THEN 'QC' WHEN o_custkey % 10 = 1 THEN 'Blank' ELSE 'g' || CAST(o_custkey % 4 AS VARCHAR) END AS kind,
  CASE WHEN count(*) % 7 = 0 THEN 0.0 WHEN (o_custkey + l_partkey % 40) % 11 = 0 THEN NULL ELSE sum(CAST(round(l_extendedprice) AS BIGINT)) / 100.0::DOUBLE END AS area
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey % 40)"""
FACTS_SQL = """
phenotypes AS (SELECT DISTINCT o_custkey AS gene, o_orderpriority AS state, l_partkey % 50 AS value, l_returnflag AS cond FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
targets AS (SELECT s_suppkey AS gene, s_suppkey % 50 AS value, 'a' || CAST(s_nationkey % 3 AS VARCHAR) AS action FROM supplier),
pathways AS (SELECT c_custkey AS gene, c_mktsegment AS metabolite FROM customer)"""
COEFS_SQL = """
coefs AS (SELECT 't' || CAST(l_suppkey % 10 AS VARCHAR) AS target, 'p' || CAST(l_partkey % 60 AS VARCHAR) AS pattern_id, CAST(l_linenumber AS INTEGER) AS fold,
  CASE WHEN (l_suppkey % 10 + l_partkey % 60) % 4 = 0 THEN 0.0 ELSE sum(CAST(round(l_discount * 100) AS BIGINT) - 5) / 100.0::DOUBLE END AS coef FROM lineitem GROUP BY l_suppkey % 10, l_partkey % 60, l_linenumber)"""
QUADS_SQL = """
quads AS (SELECT 'ontology' AS g, 'n' || CAST(n_nationkey AS VARCHAR) AS s, 'partOf' AS p, 'r' || CAST(n_regionkey AS VARCHAR) AS o FROM nation
  UNION ALL SELECT 'studies', 'st' || CAST(o_custkey AS VARCHAR), 'hasAssay', 'as' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'studies', 'as' || CAST(o_orderkey AS VARCHAR), 'hasSupplement', o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'
  UNION ALL SELECT 'studies', 'as' || CAST(o_orderkey AS VARCHAR), 'hasTreatment', o_orderstatus FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT 'hypotheses', 'h' || CAST(c_custkey AS VARCHAR), 'implies', c_mktsegment FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT 'studies', 'st' || CAST(c_custkey AS VARCHAR), 'supports', 'h' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'tests', 'st' || CAST(o_custkey AS VARCHAR), 'hasTest', 'te' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 250000
  UNION ALL SELECT 'tests', 'te' || CAST(o_orderkey AS VARCHAR), 'hasValue', o_orderstatus FROM orders WHERE o_totalprice > 400000)"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def growth(spark: SparkSession, d: str) -> DataFrame:
    place, day = F.col("user_id") % 96, F.dayofmonth("ts")
    row, col = (F.floor(place / 12) + 1).cast("int"), (place % 12 + 1).cast("int")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return _t(spark, d, "events").where("value is not null").groupBy("user_id", day.alias("day")).agg((cents / F.lit(10007.0) / F.count("*")).alias("od")).select(
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("study"), F.floor(F.col("user_id") / 96).alias("plate"), well_name(row, col).alias("well"), row.alias("row"), col.alias("col"),
        (F.col("day") - 1).cast("int").alias("t_index"), ((F.col("day") - 1) * 1200).cast("int").alias("t_sec"), "od",
        F.when(F.col("user_id") % 8 == 7, "Media control").otherwise(F.concat(F.lit("g"), F.col("user_id") % 8)).alias("grp"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("l_partkey") % 40
    s = lines(spark, d).groupBy("o_custkey", f.alias("f")).agg(F.count("*").alias("n"), (F.sum(F.round("l_extendedprice").cast("long")) / F.lit(100.0)).alias("a"))
    mol = F.concat(F.lit("m"), F.col("f") % 20)
    return s.select(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("study"), F.concat(F.lit("x-y-"), "o_custkey").alias("sample"), mol.alias("molecule"), F.concat(mol, F.lit(" [a"), F.floor(F.col("f") / 20), F.lit("]")).alias("feature"),
                    F.when(F.col("o_custkey") % 10 == 0, "QC").when(F.col("o_custkey") % 10 == 1, "Blank").otherwise(F.concat(F.lit("g"), F.col("o_custkey") % 4)).alias("kind"),
                    F.when(F.col("n") % 7 == 0, 0.0).when((F.col("o_custkey") + F.col("f")) % 11 == 0, None).otherwise(F.col("a")).alias("area"))


def phenotypes(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("state"), (F.col("l_partkey") % 50).alias("value"), F.col("l_returnflag").alias("cond")).distinct()


def targets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("gene"), (F.col("s_suppkey") % 50).alias("value"), F.concat(F.lit("a"), F.col("s_nationkey") % 3).alias("action"))


def pathways(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("gene"), F.col("c_mktsegment").alias("metabolite"))


def coefs(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("l_suppkey") % 10, F.col("l_partkey") % 60
    got = _t(spark, d, "lineitem").groupBy(s.alias("s"), p.alias("p"), "l_linenumber").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long") - 5) / F.lit(100.0)).alias("c"))
    return got.select(F.concat(F.lit("t"), "s").alias("target"), F.concat(F.lit("p"), "p").alias("pattern_id"), F.col("l_linenumber").cast("int").alias("fold"), F.when((F.col("s") + F.col("p")) % 4 == 0, 0.0).otherwise(F.col("c")).alias("coef"))


def quads(spark: SparkSession, d: str) -> DataFrame:
    t = lambda k: F.concat(F.lit(k[0]), F.col(k[1])) if isinstance(k, tuple) else F.col(k)
    rows = [("nation", None, "ontology", ("n", "n_nationkey"), "partOf", ("r", "n_regionkey")), ("orders", None, "studies", ("st", "o_custkey"), "hasAssay", ("as", "o_orderkey")),
            ("orders", "o_orderpriority <> '3-MEDIUM'", "studies", ("as", "o_orderkey"), "hasSupplement", "o_orderpriority"), ("orders", "o_orderstatus <> 'O'", "studies", ("as", "o_orderkey"), "hasTreatment", "o_orderstatus"),
            ("customer", "c_acctbal > 0", "hypotheses", ("h", "c_custkey"), "implies", "c_mktsegment"), ("customer", "c_mktsegment <> 'BUILDING'", "studies", ("st", "c_custkey"), "supports", ("h", "c_custkey")),
            ("orders", "o_totalprice > 250000", "tests", ("st", "o_custkey"), "hasTest", ("te", "o_orderkey")), ("orders", "o_totalprice > 400000", "tests", ("te", "o_orderkey"), "hasValue", "o_orderstatus")]
    out = None
    for name, cond, g, s, p, o in rows:
        df = _t(spark, d, name)
        one = (df if cond is None else df.where(cond)).select(F.lit(g).alias("g"), t(s).alias("s"), F.lit(p).alias("p"), t(o).alias("o"))
        out = one if out is None else out.unionByName(one)
    return out
