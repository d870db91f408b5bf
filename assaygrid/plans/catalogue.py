"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from assaygrid.functions import scalars as sc
from assaygrid.operators import dosing, graph, growth, labels, metabolomics as mb, patterns as pt, stats
from assaygrid.plans import standins as st
from assaygrid.plans.registry import query

G, P, K, C, Q = (f"WITH {x}" for x in (st.GROWTH_SQL, st.PEAKS_SQL, st.FACTS_SQL, st.COEFS_SQL, st.QUADS_SQL))
KEY = "study, plate, well"


# ---- growth curves
@query("W01_rolling_median", G + f"SELECT {KEY}, t_index, round(median(od) OVER (PARTITION BY {KEY} ORDER BY t_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS od FROM growth")
def _(s, d):
    return growth.rolling_median(st.growth(s, d)).select("study", "plate", "well", "t_index", "od")


FEATS = f""", steps AS (SELECT *, (od + lag(od) OVER w) / 2 * (t_sec - lag(t_sec) OVER w) AS area, abs(od - lag(od) OVER w) AS dd FROM growth WINDOW w AS (PARTITION BY {KEY} ORDER BY t_index)),
feats AS (SELECT {KEY}, min(grp) AS grp, sum(area) AS auc, CASE WHEN min(grp) = 'Media control' THEN 0.0 ELSE max(od) END AS final_od, sum(dd) AS tv, arg_max(od, t_index) AS last_od FROM steps GROUP BY {KEY}) """


@query("A01_A02_A05_W02_J04_growth_features", G + FEATS + f"SELECT {KEY}, grp, round(auc, 6) AS auc, round(final_od, 6) AS final_od, round(tv, 6) AS tv, round(last_od, 6) AS last_od FROM feats")
def flagship(s, d):
    return growth.features(st.growth(s, d))


@query("A03_mean_curves", G + "SELECT study, grp, t_index, round(avg(od), 6) AS od, round(min(t_sec) / 3600.0::DOUBLE, 6) AS hours FROM growth GROUP BY study, grp, t_index")
def _(s, d):
    return growth.mean_curves(st.growth(s, d))


def _mad(c):
    return f"coalesce(abs({c} - m_{c}) > 3 * (SELECT median(abs(b.{c} - m.m_{c})) FROM l b WHERE b.study = m.study AND b.plate = m.plate AND b.grp = m.grp) + 1e-6, false)"


@query("A04_mad_outliers", G + FEATS + f""", l AS (SELECT *, ln(auc) AS log_auc FROM feats),
m AS (SELECT l.*, median(log_auc) OVER g AS m_log_auc, median(last_od) OVER g AS m_last_od, median(tv) OVER g AS m_tv FROM l WINDOW g AS (PARTITION BY study, plate, grp)),
dv AS (SELECT *, abs(log_auc - m_log_auc) AS d1, abs(last_od - m_last_od) AS d2, abs(tv - m_tv) AS d3 FROM m),
o AS (SELECT *, median(d1) OVER g AS a1, median(d2) OVER g AS a2, median(d3) OVER g AS a3 FROM dv WINDOW g AS (PARTITION BY study, plate, grp))
SELECT {KEY}, coalesce(d1 > 3 * a1 + 1e-6, false) OR coalesce(d2 > 3 * a2 + 1e-6, false) OR coalesce(d3 > 3 * a3 + 1e-6, false) AS outlier FROM o""")
def _(s, d):
    return growth.mad_outliers(growth.features(st.growth(s, d))).select("study", "plate", "well", "outlier")


BLANKS = f""", wells AS (SELECT DISTINCT {KEY}, row, col, grp FROM growth),
near AS (SELECT w.study, w.plate, w.well, b.well AS blank, row_number() OVER (PARTITION BY w.study, w.plate, w.well ORDER BY sqrt((w.row - b.row) ** 2 + (w.col - b.col) ** 2), b.row, b.col) AS k FROM wells w JOIN wells b ON w.study = b.study AND w.plate = b.plate AND b.grp = 'Media control'),
mean AS (SELECT n.study, n.plate, n.well, g.t_index, avg(g.od) AS b FROM near n JOIN growth g ON g.study = n.study AND g.plate = n.plate AND g.well = n.blank WHERE k <= 5 GROUP BY ALL) """


@query("J07_W09_F13_P11_nearest_blanks", G + BLANKS + f"SELECT g.study, g.plate, g.well, g.t_index, round(CASE WHEN g.od - coalesce(b, 0) < 0 THEN 0.01 ELSE g.od - coalesce(b, 0) END, 6) AS od, b IS NOT NULL AS blanked FROM growth g LEFT JOIN mean m ON m.study = g.study AND m.plate = g.plate AND m.well = g.well AND m.t_index = g.t_index")
def _(s, d):
    g = st.growth(s, d)
    return growth.subtract_blanks(g, g.select("study", "plate", "well", "row", "col", "grp").distinct()).select("study", "plate", "well", "t_index", "od", "blanked")


def _line(weight):
    """Weighted straight lines through (j, y) of `near`, read at i, for each curve and i."""
    s = f"SELECT {KEY}, i, sum({weight}) AS sw, sum({weight} * j) AS sx, sum({weight} * y) AS sy, sum({weight} * j * j) AS sxx, sum({weight} * j * y) AS sxy FROM near GROUP BY {KEY}, i"
    return f"SELECT {KEY}, i, CASE WHEN abs(sw * sxx - sx * sx) < 1e-12 THEN sy / sw ELSE (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw + (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * i END AS fit FROM ({s})"


LOESS = f""", y AS (SELECT {KEY}, t_index AS j, od AS y, count(*) OVER (PARTITION BY {KEY}) AS n FROM growth),
p AS (SELECT a.study, a.plate, a.well, a.j AS i, a.n, b.j, b.y, abs(a.j - b.j) AS d, row_number() OVER (PARTITION BY a.study, a.plate, a.well, a.j ORDER BY abs(a.j - b.j), b.j) AS k FROM y a JOIN y b ON a.study = b.study AND a.plate = b.plate AND a.well = b.well),
q AS (SELECT *, max(d) OVER (PARTITION BY {KEY}, i) AS h FROM p WHERE k <= greatest(2, ceil(n * 0.2::DOUBLE))), near0 AS (SELECT *, CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE pow(1 - pow(d / (h * 1.0000001::DOUBLE), 3), 3) END AS tri FROM q),
f1 AS ({_line("tri").replace("FROM near ", "FROM near0 ")}), r AS (SELECT y.*, abs(y.y - fit) AS r FROM y JOIN f1 ON f1.study = y.study AND f1.plate = y.plate AND f1.well = y.well AND f1.i = y.j), s AS (SELECT {KEY}, median(r) AS s FROM r GROUP BY {KEY}),
b AS (SELECT r.study, r.plate, r.well, r.j, CASE WHEN s = 0 THEN 1.0::DOUBLE WHEN r.r / (6 * s) >= 1 THEN 1e-9 ELSE pow(1 - pow(r.r / (6 * s), 2), 2) END AS b FROM r JOIN s ON s.study = r.study AND s.plate = r.plate AND s.well = r.well),
near AS (SELECT n.*, tri * b AS w FROM near0 n JOIN b ON b.study = n.study AND b.plate = n.plate AND b.well = n.well AND b.j = n.j), f2 AS ({_line("w")}) """


@query("W03_loess", G + LOESS + f"SELECT {KEY}, i AS t_index, round(fit, 6) AS od FROM f2")
def _(s, d):
    return growth.loess(st.growth(s, d)).select("study", "plate", "well", "t_index", "od")


@query("W04_growth_rate", G + f""", l AS (SELECT *, t_sec / 3600.0::DOUBLE AS h, ln(od) AS l FROM growth WHERE t_index >= 18 AND od > 0),
f AS (SELECT {KEY}, h, regr_slope(l, h) OVER w AS mu, count(*) OVER w AS k, min(h) OVER w AS s FROM l WINDOW w AS (PARTITION BY {KEY} ORDER BY t_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY mu DESC, h) AS r FROM f WHERE k = 5)
SELECT w.study, w.plate, w.well, round(s, 6) AS start, round(h, 6) AS "end", round(coalesce(mu, 0), 6) AS mu FROM (SELECT DISTINCT {KEY} FROM growth) w LEFT JOIN b ON b.study = w.study AND b.plate = w.plate AND b.well = w.well AND r = 1""")
def _(s, d):
    return growth.growth_rate(st.growth(s, d))


@query("S02_time_axis", "SELECT event_id, CAST(user_id % 3 AS BIGINT) AS plate, CAST((dense_rank() OVER (PARTITION BY user_id % 3 ORDER BY ts) - 1) * 1200 AS INTEGER) AS t_sec FROM events")
def _(s, d):
    e = st._t(s, d, "events").select("event_id", F.lit("s").alias("study"), (F.col("user_id") % 3).alias("plate"), F.col("ts").alias("file_time"))
    return growth.time_axis(e).select("event_id", "plate", "t_sec")


@query("A11_unpivot", "SELECT l_orderkey, l_linenumber, CAST(t AS INTEGER) AS t_sec, round(od, 6) AS od FROM (SELECT l_orderkey, l_linenumber, unnest([0, 1200]) AS t, unnest([l_quantity, l_tax]) AS od FROM lineitem)")
def _(s, d):
    wide = st._t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("0"), F.col("l_tax").alias("1200"))
    return growth.to_long(wide, ["l_orderkey", "l_linenumber"])


@query("P01_P02_wells", "SELECT o_orderkey, chr(CAST(65 + o_orderkey % 8 AS INTEGER)) || CAST(o_orderkey % 12 + 1 AS VARCHAR) AS well, CAST(o_orderkey % 8 + 1 AS INTEGER) AS row, CAST(o_orderkey % 12 + 1 AS INTEGER) AS col FROM orders")
def _(s, d):
    raw = F.format_string("%s%02d", F.char(65 + F.col("o_orderkey") % 8), F.col("o_orderkey") % 12 + 1)
    w = sc.unify_well(F.col("w"))
    return st._t(s, d, "orders").select("o_orderkey", raw.alias("w")).select("o_orderkey", w.alias("well"), sc.well_row(w).alias("row"), sc.well_col(w).alias("col"))


# ---- statistics
@query("M01_ols_two_factors", "WITH x AS (SELECT l_returnflag AS study, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS t, l_quantity AS q FROM lineitem) SELECT study, 'x0' AS term, round(avg(q) FILTER (t = 0), 6) AS estimate FROM x GROUP BY study UNION ALL SELECT study, 'x1', round(avg(q) FILTER (t = 1) - avg(q) FILTER (t = 0), 6) FROM x GROUP BY study")
def _(s, d):
    x = st._t(s, d, "lineitem").select(F.col("l_returnflag").alias("study"), F.lit(1.0).alias("x0"), (F.col("l_linestatus") == "F").cast("double").alias("x1"), F.col("l_quantity").alias("y"))
    return stats.ols(x, "study", k=2)


@query("M02_A21_F15_bootstrap")
def _(s, d):
    g = growth.features(st.growth(s, d)).where(F.col("grp") != growth.CONTROL)
    k = F.substring("grp", 2, 1).cast("int")
    x = stats.design(g.select("study", F.concat_ws("-", "plate", "well").alias("row_id"), (k % 2).alias("treated"), (k / 2).cast("int").cast("double").alias("dose"), (k == 4).cast("int").alias("neg"), sc.log_response(F.col("auc")).alias("y")))
    return stats.bootstrap_summary(stats.bootstrap(x, "study"), stats.ols(x, "study"), "study")


TAIL = "exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))"
MW = """WITH v AS (SELECT 'f' || CAST(l_partkey % 25 AS VARCHAR) AS feature, l_linestatus = 'F' AS a, l_quantity AS v FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rnk, count(*) OVER (PARTITION BY feature, v) AS t FROM v),
s AS (SELECT feature, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(rnk) FILTER (a) AS r1, sum(t * t - 1)::DOUBLE AS ties, median(v) FILTER (a) AS ma, median(v) FILTER (NOT a) AS mb FROM r GROUP BY feature),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n2 AS n FROM s), w AS (SELECT *, greatest(0, (abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)::DOUBLE)))) AS z FROM u), q AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM w) """


@query("M03_W05_mann_whitney_u", MW + f"SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 6) AS u, round(ma, 6) AS median_a, round(mb, 6) AS median_b, round(least(1.0, 2 * {TAIL}), 6) AS p FROM q")
def _(s, d):
    x = st._t(s, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey") % 25).alias("feature"), (F.col("l_linestatus") == "F").alias("is_a"), F.col("l_quantity").alias("value"))
    return stats.mann_whitney(x, "feature")


@query("W06_benjamini_hochberg", "WITH t AS (SELECT c_custkey, c_mktsegment, (c_custkey * 7919 % 1009) / 1009.0::DOUBLE AS p FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS m, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_custkey) AS k FROM t) SELECT c_custkey, c_mktsegment, round(least(1.0, min(p * m / k) OVER (PARTITION BY c_mktsegment ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM r")
def _(s, d):
    t = st._t(s, d, "customer").select("c_custkey", "c_mktsegment", ((F.col("c_custkey") * 7919 % 1009) / 1009).alias("p"))
    return stats.benjamini_hochberg(t, "p", "c_mktsegment").select("c_custkey", "c_mktsegment", "p_adj")


@query("M11_folds")
def _(s, d):
    return stats.folds(st._t(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), 10, 7, "c_mktsegment")


@query("A24_regression_scores", "WITH x AS (SELECT l_returnflag AS target, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT *, avg(y) OVER (PARTITION BY target) AS mean FROM x) SELECT target, round(1 - sum((y - p) ** 2) / sum((y - mean) ** 2), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM m GROUP BY target")
def _(s, d):
    x = st._t(s, d, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return stats.regression_scores(x, "target").select("target", "r2", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("A22_A23_class_f1", "WITH x AS (SELECT l_linenumber % 3 AS r, l_returnflag AS y, CASE WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'N' ELSE 'R' END AS p FROM lineitem), c AS (SELECT r, y AS cls, count(*) AS t, 0 AS q, count(*) FILTER (y = p) AS tp FROM x GROUP BY r, y UNION ALL SELECT r, p, 0, count(*), 0 FROM x GROUP BY r, p) SELECT CAST(r AS INTEGER) AS r, cls, round(coalesce(2 * sum(tp) / nullif(sum(t) + sum(q), 0)::DOUBLE, 0), 6) AS f1 FROM c GROUP BY r, cls")
def _(s, d):
    k = F.col("l_partkey") % 3
    x = st._t(s, d, "lineitem").select((F.col("l_linenumber") % 3).alias("r"), F.col("l_returnflag").alias("y"), F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("p"))
    return stats.class_f1(x, "r")


@query("M04_standardise", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def _(s, d):
    return stats.standardise(st._t(s, d, "customer"), "c_acctbal", "c_mktsegment").select("c_custkey", "z")


@query("A20_min_max", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(s, d):
    return stats.min_max(st._t(s, d, "customer"), "c_acctbal", "c_nationkey").select("c_custkey", "scaled")


@query("A07_A25_coefficient_summary", C + ", m AS (SELECT target, pattern_id, avg(coef) AS mean, stddev_samp(coef) AS sd FROM coefs GROUP BY ALL) SELECT target, pattern_id, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / nullif(max(abs(mean)) OVER (PARTITION BY target), 0), 6) AS scaled FROM m")
def _(s, d):
    return stats.coefficient_summary(st.coefs(s, d))


@query("A29_M13_dose_levels", "WITH x AS (SELECT o_orderkey, o_custkey % 20 AS study, o_orderkey % 3 AS sd, o_orderkey % 2 AS nd, o_orderkey % 5 AS td FROM orders) SELECT o_orderkey, CASE WHEN nd = max(nd) OVER w AND nd > 0 THEN 'NegHigh' ELSE ['None', 'PosLow', 'PosHigh'][least(3, dense_rank() OVER (PARTITION BY study ORDER BY sd))] END AS supplement_level, CASE WHEN td > 0 AND td = max(td) OVER w THEN 'Yes' ELSE 'No' END AS treated FROM x WINDOW w AS (PARTITION BY study)")
def _(s, d):
    k = F.col("o_orderkey")
    x = st._t(s, d, "orders").select(k, (F.col("o_custkey") % 20).alias("study"), (k % 3).alias("supplement_dose"), (k % 2).alias("negative_dose"), (k % 5).alias("treatment_dose"))
    return stats.dose_levels(x).select("o_orderkey", "supplement_level", "treated")


# ---- metabolomics
def _peak_filter(name, sql, f):
    @query(name, P + sql)
    def _(s, d):
        return f(st.peaks(s, d))


KEEP = "SELECT study, feature, count(*) AS n, round(sum(area), 4) AS total FROM peaks p WHERE {} GROUP BY study, feature"


def _totals(p):
    return p.groupBy("study", "feature").agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("total"))


_peak_filter("P08_drop_empty", KEEP.format("(study, feature) IN (SELECT (study, feature) FROM peaks GROUP BY study, feature HAVING count(area) > 0)"), lambda p: _totals(mb.drop_empty(p)))
_peak_filter("A12_missing_share", KEEP.format("(study, feature) NOT IN (SELECT (study, feature) FROM peaks WHERE kind = 'QC' GROUP BY study, feature HAVING avg(CASE WHEN coalesce(area, 0) = 0 THEN 1.0 ELSE 0.0 END) > 0.1)"), lambda p: _totals(mb.missing_share(p, 0.1, F.col("kind") == "QC")))
_peak_filter("A13_blank_filter", KEEP.format("(study, feature) NOT IN (SELECT (study, feature) FROM peaks GROUP BY study, feature HAVING avg(coalesce(area, 0)) FILTER (kind NOT IN ('QC', 'Blank')) < avg(coalesce(area, 0)) FILTER (kind = 'Blank'))"), lambda p: _totals(mb.blank_filter(p)))
_peak_filter("A14_half_minimum", "SELECT study, sample, feature, round(CASE WHEN area = 0 THEN min(nullif(area, 0)) OVER (PARTITION BY study, feature) / 2 ELSE area END, 6) AS area FROM peaks", lambda p: mb.half_minimum(p).select("study", "sample", "feature", "area"))
_peak_filter("A15_O07_best_adducts", ", q AS (SELECT study, molecule, feature, stddev_samp(area) / avg(area) * 100 AS rsd, avg(CASE WHEN area IS NULL THEN 0.0 ELSE 1.0 END) AS seen FROM peaks WHERE kind = 'QC' GROUP BY ALL) SELECT study, molecule, feature, round(rsd, 6) AS rsd FROM q WHERE seen >= 0.5 AND rsd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study, molecule ORDER BY rsd, feature) = 1", mb.best_adducts)
_peak_filter("P19_sample_filter", "SELECT study, sample, count(*) AS n FROM peaks GROUP BY study, sample HAVING avg(CASE WHEN area IS NULL THEN 1.0 ELSE 0.0 END) <= 0.1", lambda p: mb.sample_filter(p, 0.1).groupBy("study", "sample").agg(F.count("*").alias("n")))
PQN = """, t AS (SELECT study, sample, sum(area) AS total FROM peaks WHERE kind = 'QC' GROUP BY ALL), dv AS (SELECT *, abs(total - median(total) OVER (PARTITION BY study)) AS dev FROM t),
good AS (SELECT study, sample FROM (SELECT *, median(dev) OVER (PARTITION BY study) AS mad FROM dv) WHERE mad = 0 OR dev / mad < 3),
ref AS (SELECT study, feature, median(area) AS ref FROM peaks JOIN good USING (study, sample) GROUP BY ALL HAVING avg(CASE WHEN area IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5),
bio AS (SELECT p.*, ref FROM peaks p JOIN ref USING (study, feature) WHERE kind NOT IN ('QC', 'Blank')), f AS (SELECT study, sample, median(area / nullif(ref, 0)) AS f FROM bio GROUP BY ALL)
SELECT study, sample, kind, feature, round(area / CASE WHEN coalesce(f, 0) = 0 THEN 1.0 ELSE f END, 6) AS area FROM bio JOIN f USING (study, sample)"""
_peak_filter("A17_pqn", PQN, mb.pqn)
_peak_filter("J13_agreeing_pairs", ", q AS (SELECT study, sample, feature, floor(area % 5) AS v FROM peaks WHERE area IS NOT NULL) SELECT a.study, a.feature AS f1, b.feature AS f2, round(count(*) / max(n)::DOUBLE, 6) AS share FROM q a JOIN q b ON a.study = b.study AND a.sample = b.sample AND a.v = b.v AND a.feature < b.feature JOIN (SELECT study, count(DISTINCT sample) AS n FROM peaks GROUP BY study) s ON s.study = a.study GROUP BY a.study, a.feature, b.feature HAVING count(*) / max(n)::DOUBLE   >= 0.1",
             lambda p: mb.agreeing_pairs(p.withColumn("area", F.floor(F.col("area") % 5)), 0.1))


@query("A10_A16_preprocess_chain")
def _(s, d):
    return mb.preprocess(st.peaks(s, d))


@query("P03_P04_P05_names", "SELECT o_orderkey, 'm' || CAST(o_orderkey % 9 AS VARCHAR) AS molecule, 'A' || CAST(o_orderkey % 12 + 1 AS VARCHAR) AS well, CASE o_orderstatus WHEN 'F' THEN 'Blank' WHEN 'O' THEN 'QC' ELSE 'P' END AS kind FROM orders")
def _(s, d):
    o = st._t(s, d, "orders")
    k = F.col("o_orderkey")
    rep = F.concat(F.lit("x-y-A"), k % 12 + 1, F.lit("_2.d"))
    label = F.when(F.col("o_orderstatus") == "F", "MAT1").when(F.col("o_orderstatus") == "O", "MAT2").otherwise(F.col("o_orderstatus"))
    return o.select(k, sc.molecule_of(sc.feature_name(F.concat(F.lit("m"), k % 9), F.lit("M+H"))).alias("molecule"), sc.well_of_replicate(rep).alias("well"), sc.sample_type(label).alias("kind"))


# ---- patterns and ranking
COVER = """, cover AS (SELECT DISTINCT * FROM (SELECT 'state|' || state AS pattern_id, gene FROM phenotypes UNION ALL SELECT 'state_cond|' || state || '|' || cond, gene FROM phenotypes
  UNION ALL SELECT 'state_value|' || state || '|' || value, gene FROM phenotypes UNION ALL SELECT 'state_value_cond|' || state || '|' || value || '|' || cond, gene FROM phenotypes
  UNION ALL SELECT 'pathway|' || metabolite, gene FROM pathways UNION ALL SELECT 'target|' || t.gene || '|' || action, p.gene FROM phenotypes p JOIN targets t USING (value)
  UNION ALL SELECT 'state_pathway|' || state || '|' || metabolite, p.gene FROM phenotypes p JOIN pathways w ON w.gene = p.gene)) """


def _cover(s, d):
    return pt.shared_coverage(st.phenotypes(s, d), st.targets(s, d), st.pathways(s, d))


@query("J15_A18_pattern_mining", K + COVER + "SELECT pattern_id, count(DISTINCT gene) AS support FROM cover GROUP BY pattern_id HAVING count(DISTINCT gene) >= 0.001 * (SELECT count(DISTINCT gene) FROM phenotypes) ORDER BY support DESC, pattern_id LIMIT 4097")
def _(s, d):
    return pt.frequent_shared(*_cover(s, d), st.phenotypes(s, d).agg(F.count_distinct("gene")).first()[0])


@query("A19_identical_features", K + COVER + ", l AS (SELECT pattern_id, list(gene ORDER BY gene) AS genes FROM cover GROUP BY pattern_id), x AS (SELECT list(pattern_id ORDER BY pattern_id) AS a FROM l GROUP BY genes) SELECT a[1] AS pattern_id, array_to_string(a[2:], ',') AS duplicates FROM x")
def _(s, d):
    patterns, rows = _cover(s, d)
    return pt.identical_groups(rows, patterns)


@query("A08_profiles", K + "SELECT gene, count(DISTINCT state || '_' || value || '_' || cond) AS n FROM phenotypes GROUP BY gene")
def _(s, d):
    return pt.profiles(st.phenotypes(s, d)).groupBy("gene").agg(F.count("profile").alias("n"))


@query("O03_U04_greedy_cover")
def _(s, d):
    return pt.greedy_cover(pt.profiles(st.phenotypes(s, d)), 5)


@query("J05_features_of_targets", K + COVER + "SELECT c_custkey AS gene, pattern_id FROM customer LEFT JOIN cover ON gene = c_custkey")
def _(s, d):
    return pt.features_of_shared(st._t(s, d, "customer").select(F.col("c_custkey").alias("gene")), *_cover(s, d))


@query("P13_F11_O01_rank", C + ", m AS (SELECT target, pattern_id, avg(coef) AS coef FROM coefs GROUP BY ALL), t AS (SELECT pattern_id, coalesce(max(coef) FILTER (target = 't3'), 0) AS t, coalesce(sum(abs(coef)) FILTER (target <> 't3'), 0) AS o FROM m GROUP BY pattern_id) SELECT pattern_id, round(ln(1 + abs(t)) / ln(1 + abs(t) + pow(o, 0.5)), 6) AS score, CASE WHEN t > 0 THEN 'higher' ELSE 'lower' END AS direction FROM t WHERE t <> 0")
def _(s, d):
    return pt.ranked(st.coefs(s, d).groupBy("target", "pattern_id").agg(F.avg("coef").alias("coef")), "t3", 0.5)


@query("P14_good_targets", C + "SELECT target, round(avg(coef), 6) AS r2 FROM coefs GROUP BY target HAVING avg(coef) > 0")
def _(s, d):
    return pt.good_targets(st.coefs(s, d).withColumnRenamed("coef", "r2"))


@query("P15_negative_controls", C + "SELECT pattern_id, array_to_string(list_sort(list(DISTINCT target)), ',') AS controls FROM coefs WHERE coef = 0 GROUP BY pattern_id")
def _(s, d):
    return pt.negative_controls(st.coefs(s, d)).withColumn("controls", F.array_join("controls", ","))


@query("P16_exclusion", "SELECT CAST(c_custkey AS VARCHAR) AS target, c_mktsegment AS clause FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains('x' || CAST(n_nationkey * 40 AS VARCHAR) || ':' || 'BUILDINGX', CAST(c_custkey AS VARCHAR) || ':' || c_mktsegment))")
def _(s, d):
    listed = st._t(s, d, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey") * 40, F.lit(":BUILDINGX")).alias("line"))
    return pt.not_listed(st._t(s, d, "customer").select(F.col("c_custkey").cast("string").alias("target"), F.col("c_mktsegment").alias("clause")), listed)


@query("F09_F10_relevance", "SELECT p_partkey, round(2.0 * (length(p_name) - length(replace(lower(p_name), 'r', ''))) + 0.5 * (length(p_name) - length(replace(lower(p_name), 'ed', ''))) / 2, 6) AS score, round((CASE WHEN contains(lower(p_name), 'r') THEN 2.0 ELSE 0 END) + (CASE WHEN contains(lower(p_name), 'ed') THEN 0.5 ELSE 0 END), 6) AS present FROM part")
def _(s, d):
    return pt.relevance(st._t(s, d, "part").select("p_partkey", F.col("p_name").alias("clause")), {"r": 2.0, "ed": 0.5}).drop("clause")


@query("F08_P20_A30_clauses", "SELECT o_orderkey, 'gene(A)' AS head, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS phenotypes, o_orderkey % 2 = 1 AS usable FROM orders")
def _(s, d):
    one = F.concat(F.lit("exhibits_phenotype(A,'x, ("), "o_orderpriority", F.lit("',b)"))
    text = F.concat(F.lit("gene(A):-"), one, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", "), one)).otherwise(""), F.lit("."))
    p = pt.parse_clauses(st._t(s, d, "orders").select("o_orderkey", text.alias("clause")))
    return p.select("o_orderkey", "parsed.head", pt.atom_count(F.col("parsed"), "exhibits_phenotype").alias("phenotypes"), pt.usable(F.col("parsed")).alias("usable"))


@query("J14_best_clause", C + ", dd AS (SELECT pattern_id, 'p' || CAST((CAST(pattern_id[2:] AS INTEGER) + k) % 60 AS VARCHAR) AS clause, k FROM (SELECT DISTINCT pattern_id FROM coefs), (SELECT unnest([1, 2, 3]) AS k)), sc AS (SELECT pattern_id AS clause, round(avg(coef), 6) AS score FROM coefs WHERE CAST(pattern_id[2:] AS INTEGER) % 5 <> 0 GROUP BY pattern_id), r AS (SELECT dd.pattern_id, dd.clause, row_number() OVER (PARTITION BY dd.pattern_id ORDER BY score DESC, k) AS n FROM dd JOIN sc USING (clause)) SELECT p.pattern_id, coalesce(clause, p.pattern_id) AS best FROM (SELECT DISTINCT pattern_id FROM coefs) p LEFT JOIN r ON r.pattern_id = p.pattern_id AND n = 1")
def _(s, d):
    c = st.coefs(s, d)
    k = F.substring("pattern_id", 2, 9).cast("int")
    dups = c.select("pattern_id").distinct().withColumn("duplicates", F.array(*(F.concat(F.lit("p"), (k + i) % 60) for i in (1, 2, 3))))
    return pt.best_clauses(dups, c.where(k % 5 != 0).groupBy(F.col("pattern_id").alias("clause")).agg(F.round(F.avg("coef"), 6).alias("score")))


# ---- graph
@query("U01_U06_merged_quads", Q + "SELECT DISTINCT g, s, p, o FROM quads WHERE g <> 'ontology'")
def _(s, d):
    q = st.quads(s, d)
    return graph.exported(graph.merged(q, q))


@query("J16_J17_J19_G08_support", Q + ", a AS (SELECT s AS study, o AS assay FROM quads WHERE p = 'hasAssay') SELECT study, assay FROM a WHERE EXISTS (SELECT 1 FROM quads WHERE p = 'hasSupplement' AND s = assay AND o = '1-URGENT') AND EXISTS (SELECT 1 FROM quads WHERE p = 'hasTreatment' AND s = assay AND o = 'F') AND study IN (SELECT study FROM a b WHERE b.assay NOT IN (SELECT s FROM quads WHERE p = 'hasSupplement') AND b.assay NOT IN (SELECT s FROM quads WHERE p = 'hasTreatment'))")
def _(s, d):
    return graph.support_query(st.quads(s, d), "1-URGENT", "F")


@query("A27_G09_G12_ask", Q + "SELECT count(*) > 0 AS answer FROM quads WHERE p = 'hasTreatment' AND o = 'F'")
def _(s, d):
    return graph.pattern(st.quads(s, d), "hasTreatment", "assay", "c").where("c = 'F'").limit(1).agg((F.count("*") > 0).alias("answer"))


@query("J18_J20_G10_G11_hypotheses", Q + ", t AS (SELECT a.s AS study, a.o AS test, v.o AS value FROM quads a LEFT JOIN quads v ON v.s = a.o AND v.p = 'hasValue' WHERE a.p = 'hasTest') SELECT h.s AS hypothesis, h.o AS state, u.s AS study, test, value FROM quads h LEFT JOIN (SELECT s, o FROM quads WHERE p = 'supports') u ON u.o = h.s LEFT JOIN t ON t.study = u.s WHERE h.p = 'implies'")
def _(s, d):
    return graph.hypotheses_with_support(st.quads(s, d))


EDGES = "e AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS child, 'n' || CAST(c_nationkey AS VARCHAR) AS parent FROM customer UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)"


@query("J21_closure", f"WITH RECURSIVE {EDGES}, c AS (SELECT child, child AS parent FROM e UNION SELECT parent, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent) SELECT DISTINCT child, parent FROM c")
def _(s, d):
    e = st._t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return graph.closure(e.union(st._t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).distinct())


@query("G01_J22_J23_restrictions", "SELECT 'states' AS g, c_name AS subject, 'hasSegment' AS prop, c_mktsegment AS filler FROM customer")
def _(s, d):
    c = st._t(s, d, "customer")
    q = graph.restrictions(c, F.lit("states"), F.col("c_name"), F.lit("hasSegment"), F.col("c_mktsegment"))
    return graph.restriction_view(graph.merged(q, q))


@query("J10_label_lookup", "WITH l AS (SELECT n_name AS label, 'plain' AS kind, 'T' || CAST(n_nationkey AS VARCHAR) AS term FROM nation UNION ALL SELECT lower(n_name), 'en', 'E' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0) SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'T' || CAST(c_nationkey AS VARCHAR) END AS term FROM customer")
def _(s, d):
    n = st._t(s, d, "nation")
    labels = n.select(F.col("n_name").alias("label"), F.lit("plain").alias("kind"), F.concat(F.lit("T"), "n_nationkey").alias("term")).union(n.where("n_nationkey % 2 = 0").select(F.lower("n_name"), F.lit("en"), F.concat(F.lit("E"), "n_nationkey")))
    c = st._t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("?"), "n_name")).otherwise(F.col("n_name")).alias("name"))
    terms = graph.resolve_labels(c.select("name").distinct(), labels)
    return c.join(terms, "name").select("c_custkey", "term")


@query("G05_F19_P18_templates", "SELECT 'm' AS g, 'http://x/' || CAST(o_orderkey AS VARCHAR) AS s, 'created' AS p, CAST(o_custkey AS VARCHAR) AS o FROM orders UNION ALL SELECT 'm', 'http://x/' || CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def _(s, d):
    o = st._t(s, d, "orders")
    subject = sc.iri("http://x/", F.col("o_orderkey"))
    return graph.quads(o, (F.lit("m"), subject, F.lit("created"), F.col("o_custkey")), (F.lit("m"), subject, F.lit("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))))


# ---- dosing and run lists
@query("F01_F02_F03_concentrations", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS value, CASE p_partkey % 4 WHEN 0 THEN 'mM' WHEN 3 THEN 'g/L' ELSE '%' END AS unit, CASE p_partkey % 4 WHEN 1 THEN 'w/v' WHEN 2 THEN 'v/v' ELSE 'molar' END AS kind FROM part")
def _(s, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, "none").when(k == 1, F.concat(n, F.lit("%"))).when(k == 2, F.concat(n, F.lit("% (v/v)"))).otherwise(F.concat(n, F.lit(" g/L")))
    return st._t(s, d, "part").select("p_partkey", sc.concentration(text).alias("c")).select("p_partkey", "c.*")


@query("F04_F05_F06_F07_volumes", "SELECT p_partkey, round(p_size * 1000.0::DOUBLE / p_retailprice, 6) AS mm, round(p_size * 270.0::DOUBLE / p_retailprice, 6) AS taken, round(270 - 18 - p_size * 270.0::DOUBLE / p_retailprice, 6) AS water, 270 - 18 - p_size * 270.0::DOUBLE / p_retailprice > 0 AS ok FROM part")
def _(s, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    v = sc.dilution_volume(price, size, F.lit(270.0))
    b = sc.volume_balance(F.lit(270.0), F.lit(18.0), [v])
    return st._t(s, d, "part").select("p_partkey", sc.to_millimolar(size, F.lit("g/L"), price).alias("mm"), v.alias("taken"), b["water"].alias("water"), b["ok"].alias("ok"))


@query("J09_U03_O05_missing_wells", "WITH w AS (SELECT chr(CAST(65 + i // 12 AS INTEGER)) || CAST(i % 12 + 1 AS VARCHAR) AS well FROM range(96) t(i)), u AS (SELECT DISTINCT user_id // 96 AS plate, chr(CAST(65 + (user_id % 96) // 12 AS INTEGER)) || CAST((user_id % 96) % 12 + 1 AS VARCHAR) AS well FROM events) SELECT plate, well, 'used' AS label FROM u UNION ALL SELECT p.plate, w.well, 'empty' FROM (SELECT DISTINCT plate FROM u) p, w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.plate = p.plate AND u.well = w.well)")
def _(s, d):
    e = st._t(s, d, "events")
    k = F.col("user_id") % 96
    used = e.select(F.floor(F.col("user_id") / 96).alias("plate"), sc.well_name((F.floor(k / 12) + 1).cast("int"), (k % 12 + 1).cast("int")).alias("well"), F.lit("used").alias("label")).distinct()
    return dosing.fill_plates(used, "empty")


@query("J12_closest_stock", "WITH x AS (SELECT p_partkey, p_size AS dose, p_brand FROM part), s AS (SELECT DISTINCT p_brand, p_size * 3 AS stock FROM part) SELECT p_partkey AS dose_id, coalesce(min(stock) FILTER (stock >= 5 * dose), min(stock)) AS stock FROM x JOIN s USING (p_brand) GROUP BY p_partkey")
def _(s, d):
    p = st._t(s, d, "part")
    return dosing.closest_stock(p.select(F.col("p_partkey").alias("dose_id"), F.col("p_brand").alias("compound"), F.col("p_size").alias("dose")), p.select(F.col("p_brand").alias("compound"), (F.col("p_size") * 3).alias("stock")).distinct())


@query("A26_highest_doses", "SELECT study, role, arg_max(name, (dose, name)) AS name, max(dose) AS dose FROM (SELECT p_brand AS study, p_type AS role, p_name AS name, p_size AS dose FROM part) GROUP BY study, role")
def _(s, d):
    return dosing.highest_doses(st._t(s, d, "part").select(F.col("p_brand").alias("study"), F.col("p_type").alias("role"), F.col("p_name").alias("name"), F.col("p_size").alias("dose")))


@query("A09_wells_by_condition", G + "SELECT grp AS summary, array_to_string(list_sort(list(DISTINCT well)), ',') AS wells FROM growth GROUP BY grp")
def _(s, d):
    return dosing.wells_by_condition(st.growth(s, d).select(F.col("grp").alias("summary"), "well").distinct())


@query("W12_O04_channel_bits", G + ", w AS (SELECT DISTINCT study, plate, row, col FROM growth WHERE grp <> 'Media control'), a AS (SELECT DISTINCT study, plate, row, col FROM growth) SELECT a.study || a.plate AS plate, a.col, 'x' AS reagent, string_agg(CASE WHEN w.row IS NULL THEN '0' ELSE '1' END, '' ORDER BY a.row) AS bits FROM a LEFT JOIN w ON w.study = a.study AND w.plate = a.plate AND w.row = a.row AND w.col = a.col GROUP BY a.study, a.plate, a.col")
def _(s, d):
    g = st.growth(s, d).select(F.concat("study", "plate").alias("plate"), "row", "col", F.lit("x").alias("reagent"), (F.col("grp") != growth.CONTROL).cast("double").alias("volume")).distinct()
    return dosing.channel_bits(g)


@query("W07_W08_run_list")
def _(s, d):
    g = st.growth(s, d).select(F.concat("study", "plate").alias("plate"), "well", "grp").distinct()
    return dosing.run_list(dosing.round_robin(g, 3))


@query("W10_paired_timings", "WITH e AS (SELECT 'f' || CAST(user_id % 5 AS VARCHAR) AS file, event_id AS line, CASE WHEN event_type IN ('error', 'click') THEN 'well' ELSE 'time' END AS kind, 'w' || CAST(user_id AS VARCHAR) AS well, CASE WHEN user_id % 10 = 0 THEN 1000 ELSE 1 END AS row, value / 100 AS t FROM events), p AS (SELECT *, lag(kind) OVER w AS b, lag(well) OVER w AS bw, lag(row) OVER w AS br FROM e WINDOW w AS (PARTITION BY file ORDER BY line)) SELECT file, line, bw AS well, round(t, 6) AS t FROM p WHERE kind = 'time' AND b = 'well' AND br <> 1000 AND t <= 0.6")
def _(s, d):
    u = F.col("user_id")
    e = st._t(s, d, "events").select(F.concat(F.lit("f"), u % 5).alias("file"), F.col("event_id").alias("line"), F.when(F.col("event_type").isin("error", "click"), "well").otherwise("time").alias("kind"), F.concat(F.lit("w"), u).alias("well"), F.when(u % 10 == 0, 1000).otherwise(1).alias("row"), (F.col("value") / 100).alias("t"))
    return dosing.paired_timings(e)


@query("F27_F20_condition_key", "SELECT o_orderkey, o_orderpriority || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN '5 mM' ELSE '0 mM' END || ' & ' || o_orderstatus || ': 0 mM' AS name FROM orders")
def _(s, d):
    return st._t(s, d, "orders").select("o_orderkey", sc.condition_key(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "5 mM"), F.col("o_orderstatus"), F.lit(None).cast("string")).alias("name"))


# ---- labels and texts
@query("F18_named_terms", "SELECT o_orderkey, 'x ' || coalesce(a.c_name, 'CHEBI:' || CAST(o_custkey AS VARCHAR)) || ' and ' || coalesce(b.c_name, 'CHEBI:' || CAST(o_orderkey % 50 AS VARCHAR)) || ', not CHEBI:' || CAST(o_custkey AS VARCHAR) || 'a' AS note FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_custkey % 3 > 0 LEFT JOIN customer b ON b.c_custkey = o_orderkey % 50 AND b.c_custkey % 3 > 0")
def _(s, d):
    first, second = F.concat(F.lit("CHEBI:"), "o_custkey"), F.concat(F.lit("CHEBI:"), F.col("o_orderkey") % 50)
    notes = st._t(s, d, "orders").select("o_orderkey", F.concat(F.lit("x "), first, F.lit(" and "), second, F.lit(", not "), first, F.lit("a")).alias("note"))
    names = st._t(s, d, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("CHEBI:"), "c_custkey").alias("term"), F.col("c_name").alias("name"))
    return labels.named_terms(notes, names, "o_orderkey", "note")


@query("O08_ranked_texts", "WITH x AS (SELECT p_partkey, p_size, p_brand || ' ' || p_name AS n FROM part), r AS (SELECT p_partkey, p_size, 4 * CAST(contains(n, '3') AS INTEGER) + 3 * CAST(contains(n, 'a') AS INTEGER) + 2 * CAST(contains(n, '1') AS INTEGER) + CAST(contains(n, '4') AS INTEGER) AS score FROM x) SELECT *, CAST(row_number() OVER (PARTITION BY p_size ORDER BY score DESC, p_partkey) AS INTEGER) AS place FROM r")
def _(s, d):
    scored = st._t(s, d, "part").select("p_partkey", "p_size", labels.relevance(F.concat_ws(" ", "p_brand", "p_name"), ["3", "a", "1", "4"]).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("score"), "p_partkey")))


@query("F21_first_clause", "SELECT p_partkey, nullif(regexp_extract(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Cell(A):-exhibits_phenotype(A,' || chr(10) || p_brand || '). Then' ELSE ' no clause.' END || ' Cell(A):-exhibits_phenotype.'[1:CAST(p_partkey % 3 * 15 AS INTEGER)], 'Cell\\(A\\):-exhibits_phenotype.*?\\.', 0, 's'), '') AS clause FROM part")
def _(s, d):
    k = F.col("p_partkey")
    tail = F.substring(F.lit(" Cell(A):-exhibits_phenotype."), F.lit(1), (k % 3 * 15).cast("int"))
    text = F.concat("p_name", F.when(k % 2 == 0, F.concat(F.lit(" Cell(A):-exhibits_phenotype(A,\n"), "p_brand", F.lit("). Then"))).otherwise(" no clause."), tail)
    return st._t(s, d, "part").select("p_partkey", labels.first_clause(text).alias("clause"))


@query("F26_fifth_line", "SELECT doc_id, rtrim(string_split_regex(text, '\r\n|\n|\r')[5], ' ' || chr(9) || chr(11) || chr(12)) AS line FROM documents")
def _(s, d):
    return st._t(s, d, "documents").select("doc_id", labels.line_at(F.col("text"), 4).alias("line"))


ASSAY_SQL = "CASE a WHEN 3 THEN 'None' WHEN 7 THEN 'No' ELSE 'Yes' END"


@query("F28_F29_comparisons", f"WITH x AS (SELECT l_orderkey, l_linenumber, [NULL, 4, NULL, 3, NULL, 6, 7, 8][l_partkey % 8 + 1] AS a FROM lineitem), y AS (SELECT *, {ASSAY_SQL} AS t, CASE WHEN a = 4 THEN 'None' WHEN a < 7 THEN 'PosHigh' ELSE 'NegHigh' END AS s FROM x) SELECT l_orderkey, l_linenumber, CAST(a AS INTEGER) AS assay, CASE WHEN a IS NOT NULL THEN t END AS treatment, CASE WHEN a IS NOT NULL THEN s END AS supplement, CASE WHEN a IS NOT NULL THEN 'Treatment=' || t || ', Supplement=' || s END AS link FROM y")
def _(s, d):
    rows = st._t(s, d, "lineitem").select("l_orderkey", "l_linenumber", labels.forest_assay(F.col("l_partkey") % 8).alias("assay"))
    return rows.select("*", labels.comparison(F.col("assay")).alias("c")).select("l_orderkey", "l_linenumber", "assay", "c.*")


@query("F16_equimolar", "WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'dose' WHEN 1 THEN 'treated:dose' ELSE 'treated' END AS term, p_retailprice AS e FROM part) SELECT p_partkey, term, round(e, 6) AS estimate, round(e - 1, 6) AS ci_lo, round(e + 1, 6) AS ci_hi, 0 AS place FROM t UNION ALL SELECT p_partkey, term || ' x 5', round(e * 5, 6), round((e - 1) * 5, 6), round((e + 1) * 5, 6), 1 FROM t WHERE term <> 'treated'")
def _(s, d):
    term = F.when(F.col("p_partkey") % 3 == 0, "dose").when(F.col("p_partkey") % 3 == 1, "treated:dose").otherwise("treated")
    e = F.col("p_retailprice")
    return stats.equimolar(st._t(s, d, "part").select("p_partkey", term.alias("term"), e.alias("estimate"), (e - 1).alias("ci_lo"), (e + 1).alias("ci_hi")), 5.0)


@query("F30_flattened", "SELECT p_partkey, array_to_string(flatten([[p_name, p_brand], [CAST(p_size AS VARCHAR)]]), '|') AS parts FROM part")
def _(s, d):
    nested = F.array(F.array("p_name", "p_brand"), F.array(F.col("p_size").cast("string")))
    return st._t(s, d, "part").select("p_partkey", F.array_join(F.flatten(nested), "|").alias("parts"))
