"""Registered queries: joins and filters of a study, multivariate models, clause mining, and the hypothesis store."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from assaygrid.functions import scalars as sc
from assaygrid.operators import dosing, forests, graph, growth, metabolomics as mb, models, patterns as pt, stats
from assaygrid.operators.staging import written
from assaygrid.plans import standins as st
from assaygrid.plans.registry import query

K, P, Q, C = (f"WITH {x}" for x in (st.FACTS_SQL, st.PEAKS_SQL, st.QUADS_SQL, st.COEFS_SQL))


# ---- joins and filters
@query("P06_P07_injections", "SELECT o_orderkey, o_orderstatus AS kind FROM orders WHERE o_orderstatus IS NOT NULL AND nullif(o_orderpriority, '5-LOW') IS NOT NULL AND (o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def _(s, d):
    rows = st._t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "MAT1").otherwise(F.concat(F.lit("w"), "o_custkey")).alias("well"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("grp"), F.col("o_orderstatus").alias("kind"))
    valid = st._t(s, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("w"), "c_custkey").alias("well"))
    return mb.with_group(mb.injected(rows, valid), "grp").select("o_orderkey", "kind")


@query("P09_measurable", K + "SELECT * FROM phenotypes WHERE state <> '5-LOW' AND NOT (state = '1-URGENT' AND value IN (3, 7))")
def _(s, d):
    return pt.measurable(st.phenotypes(s, d), ["5-LOW"], ["3", "7"], "1-URGENT")


@query("P10_controls", f"WITH {st.GROWTH_SQL} SELECT study, grp, count(*) AS n FROM growth WHERE grp <> 'Media control' GROUP BY study, grp")
def _(s, d):
    return growth.without_controls(st.growth(s, d)).groupBy("study", "grp").agg(F.count("*").alias("n"))


@query("J02_J03_A28_design", "SELECT DISTINCT l_orderkey, l_partkey, p_brand, o_totalprice FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 10) ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def _(s, d):
    design = st._t(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    parameters = st._t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return growth.with_parameters(growth.with_design(st._t(s, d, "lineitem").select("l_orderkey", "l_partkey"), design, ["l_partkey"]), parameters, ["l_orderkey"]).select("l_orderkey", "l_partkey", "p_brand", "o_totalprice")


@query("J08_dispensing", "SELECT p_partkey, p_brand AS summary, 'S' || CAST(s_nationkey + 1 AS VARCHAR) AS well FROM part LEFT JOIN supplier ON 'Brand#' || CAST(s_suppkey AS VARCHAR) = p_brand")
def _(s, d):
    layout = st._t(s, d, "supplier").select(F.concat(F.lit("Brand#"), "s_suppkey").alias("summary"), F.format_string("S%02d", F.col("s_nationkey") + 1).alias("well"))
    return dosing.dispensing(st._t(s, d, "part").select("p_partkey", F.col("p_brand").alias("summary")), layout).select("p_partkey", "summary", "well")


@query("J11_P25_library", "SELECT n_name AS key, c_custkey, c_name, c_mktsegment FROM customer JOIN (SELECT DISTINCT substr(n_name, 1, 3) AS n_name FROM nation) ON contains(lower(c_name), lower(n_name)) OR contains(lower(c_mktsegment), lower(n_name))")
def _(s, d):
    return dosing.library_matches(st._t(s, d, "nation").select(F.substring("n_name", 1, 3).alias("key")), st._t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).select("key", "c_custkey", "c_name", "c_mktsegment")


@query("P23_record", "SELECT p_partkey, p_brand FROM part WHERE p_brand = (SELECT max(p_brand) FROM part) ORDER BY CAST(p_partkey AS VARCHAR) || ',' LIMIT 1")
def _(s, d):
    p = st._t(s, d, "part").select("p_partkey", "p_brand")
    return dosing.record_of(p.select("p_partkey", "p_brand"), "p_brand", p.agg(F.max("p_brand")).first()[0])


@query("P17_P22_F12_F25_texts", "SELECT p_partkey, contains(lower(p_name), lower(replace(p_type, 'STEEL', 'green'))) AS found, p_size > 25 AS treated, CASE WHEN p_size > 25 THEN 'decreased' ELSE 'increased' END AS word, replace(replace(p_name || ',' || p_type, ',', '_'), 'STEEL', 'Steel') AS name FROM part")
def _(s, d):
    p, big = st._t(s, d, "part"), F.col("p_size") > 25
    return p.select("p_partkey", sc.mentions(F.col("p_name"), F.col("p_type"), {"STEEL": "green"}).alias("found"), sc.is_treated(F.when(big, "Yes").otherwise("None")).alias("treated"),
                    sc.changed(F.when(big, "lower").otherwise("higher")).alias("word"), sc.clean_name(F.concat("p_name", F.lit(","), "p_type"), {"STEEL": "Steel"}).alias("name"))


@query("F05_F12_percent_volumes", "SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE ELSE (p_size % 7) * 270.0::DOUBLE / p_size END, 6) AS taken, CASE WHEN p_retailprice > 1000 THEN 'higher' WHEN p_retailprice < 1000 THEN 'lower' END AS direction, round(ln(p_size + 0.01::DOUBLE), 6) AS log_size FROM part")
def _(s, d):
    percent = (F.col("p_size") % 7).cast("double")
    return st._t(s, d, "part").select("p_partkey", sc.percent_volume(percent, F.lit(270.0), F.col("p_size").cast("double")).alias("taken"), sc.direction(F.col("p_retailprice") - 1000).alias("direction"), sc.log_response(F.col("p_size")).alias("log_size"))


@query("F23_chosen_option", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS INTEGER) END AS choice FROM orders")
def _(s, d):
    text = F.concat(F.lit("We take "), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("HYPOTHESIS NUMBER #"), "o_custkey")).otherwise(F.concat(F.lit("number "), "o_custkey")), F.lit(", as said."))
    return st._t(s, d, "orders").select("o_orderkey", sc.chosen_option(text).alias("choice"))


@query("F32_readable_clauses", "SELECT p_brand || '_ilp' || CAST(p_partkey AS VARCHAR) AS pattern_id, 'Cell(A):-' || p_type AS clause FROM part WHERE p_size > 5")
def _(s, d):
    p = st._t(s, d, "part")
    features = p.where("p_size > 5").select(F.col("p_brand").alias("example"), F.col("p_partkey").cast("int").alias("id"), F.concat(F.lit("gene(A):-"), "p_type").alias("clause"))
    return pt.readable_clauses(features, p.select(F.concat("p_brand", F.lit("_ilp"), "p_partkey").alias("pattern_id")))


@query("W11_usable_lines", "WITH l AS (SELECT o_custkey AS file, o_orderkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT file, 2 * k AS line, NULL::INTEGER AS feature FROM l UNION ALL SELECT file, 2 * k + 1, CAST(k AS INTEGER) FROM l")
def _(s, d):
    flag, k = F.col("o_orderstatus"), F.col("o_orderkey")
    bad = F.when(flag == "F", "compound_modulates_target(B,x,D)").otherwise("exhibits_phenotype(A,p,B,C),exhibits_phenotype(A,q,B,C)")
    feature = F.concat(F.lit("feature("), k, F.lit(",(gene(A):-"), F.when(flag == "P", "exhibits_phenotype(A,p,B,C)").otherwise(bad), F.lit("))."))
    pairs = F.array(F.struct((2 * k).alias("line"), F.lit("[pos cover = 3]").alias("text")), F.struct((2 * k + 1).alias("line"), feature.alias("text")))
    return pt.usable_lines(st._t(s, d, "orders").select(F.col("o_custkey").alias("file"), F.inline(pairs))).select("file", "line", "feature")


@query("P21_J06_features", C + ", k AS (SELECT pattern_id FROM coefs GROUP BY pattern_id HAVING count(DISTINCT target) = (SELECT count(DISTINCT target) FROM coefs)) SELECT target, pattern_id, fold, round(coef, 6) AS coef FROM coefs WHERE pattern_id IN (SELECT pattern_id FROM k) AND pattern_id IN (SELECT 'p' || CAST(p_size AS VARCHAR) FROM part)")
def _(s, d):
    kept = st._t(s, d, "part").select(F.concat(F.lit("p"), "p_size").alias("pattern_id"))
    return pt.kept_features(pt.in_all_targets(st.coefs(s, d)), kept).select("target", "pattern_id", "fold", "coef")


@query("U05_O02_O06_candidates", "SELECT CAST(c_custkey AS VARCHAR) AS target, c_mktsegment AS clause FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(n_name || ':x', CAST(c_custkey AS VARCHAR) || ':' || c_mktsegment)) AND NOT EXISTS (SELECT 1 FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR) || ':BUILDING', CAST(c_custkey AS VARCHAR) || ':' || c_mktsegment)) ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def _(s, d):
    listed = pt.listed_lines(st._t(s, d, "nation").select(F.concat("n_name", F.lit(":x ")).alias("line")), st._t(s, d, "supplier").select(F.concat("s_suppkey", F.lit(":BUILDING")).alias("line")))
    c = st._t(s, d, "customer").select(F.col("c_custkey").cast("string").alias("target"), F.col("c_mktsegment").alias("clause"), "c_acctbal", "c_custkey")
    return pt.first_n(pt.not_listed(c, listed), 50, F.desc("c_acctbal"), "c_custkey").select("target", "clause")


@query("U02_bag_union", "SELECT s_suppkey AS id, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def _(s, d):
    c = st._t(s, d, "customer")
    return graph.either(st._t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))


@query("A06_replicate_means", "SELECT o_custkey, o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY o_custkey, o_orderpriority")
def _(s, d):
    return stats.replicate_means(st._t(s, d, "orders"), ["o_totalprice"], "o_custkey", "o_orderpriority").withColumn("o_totalprice", F.round("o_totalprice", 4))


# ---- tests and scores
CONTRASTS = "ct AS (SELECT * FROM (VALUES (1, 'A', 'F', 'R', 'F'), (2, NULL, 'F', 'A', 'F'), (3, NULL, 'O', NULL, 'F')) t(contrast, a_treatment, a_supplement, b_treatment, b_supplement))"
TAIL = "exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))"


@query("M03_P12_contrasts", f"""WITH {CONTRASTS}, v AS (SELECT 'f' || CAST(l_partkey % 25 AS VARCHAR) AS feature, nullif(l_returnflag, 'N') AS tr, l_linestatus AS su, l_quantity AS v FROM lineitem),
x AS (SELECT contrast, feature, true AS a, v FROM v JOIN ct ON tr IS NOT DISTINCT FROM a_treatment AND su IS NOT DISTINCT FROM a_supplement UNION ALL SELECT contrast, feature, false, v FROM v JOIN ct ON tr IS NOT DISTINCT FROM b_treatment AND su IS NOT DISTINCT FROM b_supplement),
r AS (SELECT *, rank() OVER (PARTITION BY contrast, feature ORDER BY v) + (count(*) OVER (PARTITION BY contrast, feature, v) - 1) / 2.0::DOUBLE AS rnk, count(*) OVER (PARTITION BY contrast, feature, v) AS t FROM x),
s AS (SELECT contrast, feature, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(rnk) FILTER (a) AS r1, sum(t * t - 1)::DOUBLE AS ties, median(v) FILTER (a) AS ma, median(v) FILTER (NOT a) AS mb FROM r GROUP BY contrast, feature HAVING count(*) FILTER (a) > 0 AND count(*) FILTER (NOT a) > 0),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n2 AS n FROM s), w AS (SELECT *, greatest(0, (abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)::DOUBLE)))) AS z FROM u), q AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM w)
SELECT CAST(contrast AS INTEGER) AS contrast, feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 6) AS u, round(ma, 6) AS median_a, round(mb, 6) AS median_b, round(least(1.0, 2 * {TAIL}), 6) AS p FROM q""")
def _(s, d):
    pairs = s.createDataFrame([(1, "A", "F", "R", "F"), (2, None, "F", "A", "F"), (3, None, "O", None, "F")], "contrast int, a_treatment string, a_supplement string, b_treatment string, b_supplement string")
    rows = st._t(s, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey") % 25).alias("feature"), F.nullif("l_returnflag", F.lit("N")).alias("treatment"), F.col("l_linestatus").alias("supplement"), F.col("l_quantity").alias("value"))
    return stats.mann_whitney(stats.contrasts(rows, pairs), "contrast", "feature")


@query("W06_all_tests", "WITH t AS (SELECT c_custkey, (c_custkey * 7919 % 1009) / 1009.0::DOUBLE AS p FROM customer), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, c_custkey) AS k FROM t) SELECT c_custkey, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM r")
def _(s, d):
    t = st._t(s, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 1009) / 1009).alias("p"))
    return stats.benjamini_hochberg(t, "p").select("c_custkey", "p_adj")


@query("M11_fold_sizes", "WITH f AS (SELECT c_mktsegment, ntile(10) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS fold FROM customer) SELECT c_mktsegment, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM f GROUP BY c_mktsegment, fold")
def _(s, d):
    return stats.folds(st._t(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), 10, 7, "c_mktsegment").groupBy("c_mktsegment", "fold").agg(F.count("*").alias("n"))


F1 = """x AS (SELECT l_suppkey % 4 AS study, l_linenumber % 3 AS r, l_returnflag AS y, CASE WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'N' ELSE 'R' END AS p FROM lineitem),
c AS (SELECT study, r, y AS cls, count(*) AS t, 0 AS q, count(*) FILTER (y = p) AS tp FROM x GROUP BY ALL UNION ALL SELECT study, r, p, 0, count(*), 0 FROM x GROUP BY ALL), f AS (SELECT study, r, cls, coalesce(2 * sum(tp) / nullif(sum(t) + sum(q), 0)::DOUBLE, 0) AS f1 FROM c GROUP BY ALL)"""


def _calls(s, d):
    k = F.col("l_partkey") % 3
    return st._t(s, d, "lineitem").select((F.col("l_suppkey") % 4).alias("study"), (F.col("l_linenumber") % 3).alias("r"), F.col("l_returnflag").alias("y"), F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("p"))


@query("A22_macro_f1", f"WITH {F1} SELECT study, CAST(r AS INTEGER) AS r, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY study, r")
def _(s, d):
    return stats.macro_f1(_calls(s, d), "study", "r")


@query("A23_f1_spread", f"WITH {F1} SELECT study, cls, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS sd FROM f GROUP BY study, cls")
def _(s, d):
    return stats.f1_spread(_calls(s, d), ["r"], "study")


@query("M01_six_terms", "WITH x AS (SELECT l_returnflag AS study, l_linestatus = 'F' AS t, l_linenumber % 3 AS k, l_quantity AS y FROM lineitem), m AS (SELECT study, t, k, avg(y) AS m FROM x GROUP BY ALL), w AS (SELECT study, max(m) FILTER (NOT t AND k = 0) AS a, max(m) FILTER (t AND k = 0) AS b, max(m) FILTER (NOT t AND k = 1) AS c, max(m) FILTER (NOT t AND k = 2) AS d, max(m) FILTER (t AND k = 1) AS e, max(m) FILTER (t AND k = 2) AS f FROM m GROUP BY study) SELECT study, unnest(['Intercept', 'treated', 'dose', 'neg', 'treated:dose', 'treated:neg']) AS term, round(unnest([a, b - a, c - a, d - a, e - b - c + a, f - b - d + a]), 6) AS estimate FROM w")
def _(s, d):
    k = F.col("l_linenumber") % 3
    x = st._t(s, d, "lineitem").select(F.col("l_returnflag").alias("study"), (F.col("l_linestatus") == "F").alias("treated"), (k == 1).cast("double").alias("dose"), (k == 2).alias("neg"), F.col("l_quantity").alias("y"))
    return stats.ols(stats.design(x), "study")


# ---- multivariate models over samples of the peak table
def samples(s, d):
    """(study, id, x, y, label): a sample's features, its customer's balance, and its kind."""
    p = st.peaks(s, d)
    x = models.vectors(p, "study", "sample", "feature", "area")
    y = st._t(s, d, "customer").select(F.concat(F.lit("x-y-"), "c_custkey").alias("sample"), (F.col("c_acctbal") / 1000).alias("y"))
    return x.join(y, "sample").join(p.select("sample", F.col("kind").alias("label")).distinct(), "sample").select("study", F.col("sample").alias("id"), F.transform("x", lambda v: F.log1p(v)).alias("x"), "y", "label")


VECTORS = """, s AS (SELECT DISTINCT study, sample FROM peaks), f AS (SELECT study, feature, coalesce(avg(area), 0) AS mean FROM peaks GROUP BY study, feature),
x AS (SELECT s.study, s.sample, f.feature, ln(1 + coalesce(p.area, f.mean)) AS v FROM s JOIN f ON f.study = s.study LEFT JOIN peaks p ON p.study = s.study AND p.sample = s.sample AND p.feature = f.feature JOIN customer ON 'x-y-' || CAST(c_custkey AS VARCHAR) = s.sample) """


@query("M05_M10_moments", P + VECTORS + "SELECT a.study, a.feature AS f1, b.feature AS f2, round(corr(a.v, b.v), 6) AS r FROM x a JOIN x b ON a.study = b.study AND a.sample = b.sample AND a.feature < b.feature GROUP BY ALL")
def _(s, d):
    names = st.peaks(s, d).groupBy("study").agg(F.sort_array(F.collect_set("feature")).alias("names"))
    cells = models.cells_of(models.moments(samples(s, d), ["study"], []), ["study"])
    total = cells.where("i = 0").select("study", "j", F.col("v").alias("t"))
    n = total.where("j = 0").select("study", F.col("t").alias("n"))
    c = cells.join(total.toDF("study", "i", "ti"), ["study", "i"]).join(total.toDF("study", "j", "tj"), ["study", "j"]).join(n, "study").withColumn("c", F.col("v") - F.col("ti") * F.col("tj") / F.col("n"))
    sd = c.where("i = j").select("study", "i", F.col("c").alias("s"))
    r = c.where("0 < i and i < j").join(sd.toDF("study", "i", "si"), ["study", "i"]).join(sd.toDF("study", "j", "sj"), ["study", "j"]).join(names, "study")
    return r.select("study", F.element_at("names", F.col("i")).alias("f1"), F.element_at("names", F.col("j")).alias("f2"), (F.col("c") / F.sqrt(F.col("si") * F.col("sj"))).alias("r"))


def gappy(s, d):
    """(study, id, x) of the peak table with the values that were not measured left null."""
    x = models.vectors(st.peaks(s, d), "study", "sample", "feature", "area", fill=False)
    return x.select("study", F.col("sample").alias("id"), F.transform("x", lambda v: F.log1p(v)).alias("x"))


@query("M06_forest_imputation")
def _(s, d):
    return forests.impute(gappy(s, d), "study")


@query("M05_pca_outliers")
def _(s, d):
    return models.pca_outliers(forests.impute(gappy(s, d), "study"), "study")


def _scores(s, d, outer, repeats, **more):
    rows = models.staged(samples(s, d))
    fits = models.staged(models.elastic_net(rows, "study", ["y"], outer, repeats=repeats, **more))
    held = models.held_out(rows, fits, "study", outer, repeats).join(rows.select("study", "id", "y"), ["study", "id"])
    return stats.regression_scores(held, "study", "rep", "fold")


@query("M07_repeated_nested_cv")
def _(s, d):
    return _scores(s, d, 3, 10, inner=5)


@query("M08_single_nested_cv")
def _(s, d):
    return _scores(s, d, 3, 1, inner=10, ratios=models.RATIOS_SINGLE)


@query("M09_pattern_weights")
def _(s, d):
    """Per target, ten-fold weights of patterns, for 19 targets: a gene's patterns are its phenotype states with a condition."""
    p = st.phenotypes(s, d).select("gene", F.concat_ws("|", "state", "cond").alias("pattern")).distinct()
    rows = models.vectors(p.select(F.lit("all").alias("study"), "gene", "pattern", F.lit(1.0).alias("one")).join(p.select("pattern").distinct(), "pattern"), "study", "gene", "pattern", "one")
    names = p.select("pattern").distinct().groupBy().agg(F.sort_array(F.collect_list("pattern")).alias("names"))
    own = p.groupBy("gene").agg(F.collect_set("pattern").alias("own"))
    x = rows.select("study", "gene").join(own, "gene").join(F.broadcast(names)).select("study", F.col("gene").alias("id"), F.transform("names", lambda n: F.array_contains("own", n).cast("double")).alias("x"))
    price, parts = F.col("o_totalprice") / 1e5, [F.lit(True), *(F.col("o_orderpriority").startswith(str(k)) for k in range(1, 6)), *(F.col("o_orderstatus") == k for k in "FOP")]
    means = [F.coalesce(F.avg(F.when(own, price)), F.lit(0.0)) for own in parts]
    counts = [F.count(F.when(own, 1)).cast("double") for own in parts]
    ts = [f"t{k + 1}" for k in range(2 * len(parts) + 1)]
    size = st._t(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(*(c.alias(t) for c, t in zip([means[0], counts[0], *means[1:], *counts[1:], F.max(price)], ts)))
    got = models.elastic_net(x.join(size, "id"), "study", ts, 10, 10, ratios=(0.5,), alphas=models.TRIED, scaled=False, by_r2=True)
    return models.coefficient_spread(got, "study")


@query("M10_pls_da")
def _(s, d):
    rows = models.staged(samples(s, d))
    fits = models.staged(models.pls_da(rows, "study", "label", 5, outer=3, repeats=10))
    return stats.f1_spread(models.pls_classes(rows, fits, "study", "label", 3, 10), ["rep", "fold"], "study", y="label")


@query("M10_pls_scores")
def _(s, d):
    rows = models.staged(samples(s, d))
    return models.pls_scores(rows, models.pls_da(rows, "study", "label", 5), "study").select("study", "id", *(F.get("scores", F.lit(k)).alias(f"pls{k + 1}") for k in range(5)))


# ---- clause mining over all bodies of up to three literals
KB = st.FACTS_SQL + """, nm AS (SELECT p_size AS value, p_brand AS name FROM (SELECT p_size, min(p_brand) AS p_brand FROM part GROUP BY p_size)),
cd AS (SELECT * FROM (VALUES ('A', 'aerobic'), ('R', 'rich medium'), ('N', 'rich medium')) t(cond, text)), ph AS (SELECT DISTINCT * FROM phenotypes),
tl AS (SELECT value, 'name,' || name AS a FROM nm UNION SELECT value, 'target,' || action FROM targets), cl AS (SELECT cond, 'condition,' || text AS a FROM cd),
ch AS (SELECT DISTINCT t.value, 'target,' || action || ',pathway,m,' || metabolite AS a FROM targets t JOIN pathways w ON w.gene = t.gene),
ta AS (SELECT ph.*, a FROM ph JOIN tl USING (value) UNION SELECT ph.*, a FROM ph JOIN cl USING (cond)),
f1 AS (SELECT DISTINCT state AS item, gene FROM ph), f2 AS (SELECT DISTINCT state || ',' || a AS item, gene FROM ta),
f3 AS (SELECT DISTINCT x.state || ',' || x.a || ',' || y.a AS item, x.gene FROM ta x JOIN ta y ON x.gene = y.gene AND x.state = y.state AND x.value = y.value AND x.cond = y.cond AND x.a < y.a UNION SELECT DISTINCT state || ',' || a, gene FROM ph JOIN ch USING (value)),
g2 AS (SELECT x.item || '&' || y.item AS item, x.gene FROM f1 x JOIN f1 y ON x.gene = y.gene AND x.item < y.item),
g3 AS (SELECT x.item || '&' || y.item AS item, x.gene FROM f2 x JOIN f1 y ON x.gene = y.gene UNION ALL SELECT x.item || '&' || y.item || '&' || z.item, x.gene FROM f1 x JOIN f1 y ON x.gene = y.gene AND x.item < y.item JOIN f1 z ON z.gene = x.gene AND y.item < z.item),
al AS (SELECT * FROM f1 UNION SELECT * FROM f2 UNION SELECT * FROM f3 UNION SELECT * FROM g2 UNION SELECT * FROM g3) """


def clause_support(s, d):
    part = st._t(s, d, "part")
    names = part.groupBy(F.col("p_size").alias("value")).agg(F.min("p_brand").alias("name"))
    conditions = s.createDataFrame([("A", "aerobic"), ("R", "rich medium"), ("N", "rich medium")], "cond string, text string")
    pathways = st.pathways(s, d).withColumn("kind", F.lit("m"))
    return pt.clause_support(st.phenotypes(s, d), names, conditions, st.targets(s, d).withColumnRenamed("gene", "through"), pathways)


@query("M12_clause_mining", "WITH " + KB + "SELECT item AS pattern_id, count(DISTINCT gene) AS support FROM al GROUP BY item HAVING count(DISTINCT gene) >= 0.001 * (SELECT count(DISTINCT gene) FROM ph) ORDER BY support DESC, pattern_id LIMIT 4097")
def _(s, d):
    return pt.first_n(clause_support(s, d), 4097, F.desc("support"), "pattern_id")


# ---- the hypothesis store
def nid(*parts):
    return "'n:' || sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), chr(30))" for p in parts) + "))"


def restr(source, g, s, role, filler):
    b = f"'_:' || sha256(concat_ws(chr(31), {s}, {role}, {filler}))"
    rows = ((s, "'rdfs:subClassOf'", b), (b, "'rdf:type'", "'owl:Restriction'"), (b, "'owl:onProperty'", role), (b, "'owl:someValuesFrom'", filler))
    return " UNION ".join(f"SELECT {g} AS g, {a} AS s, {p} AS p, {o} AS o FROM {source}" for a, p, o in rows)


HYPO = f"""h AS (SELECT 'hyp-' || CAST(c_custkey AS VARCHAR) AS hypothesis, 'T' || CAST(c_custkey AS VARCHAR) AS aa, CASE WHEN c_acctbal < 0 THEN 'decreasedComparedTo' ELSE 'increasedComparedTo' END AS rel, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'K' || c_mktsegment END AS supp, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Genesis' ELSE 'lab' END AS creator FROM customer),
p0 AS (SELECT hypothesis, 1 AS side, 'obo:APO_0000095' AS class, ':accumulationOfChemical' AS role, aa AS chemical, rel AS relation FROM h UNION ALL SELECT hypothesis, 2, 'obo:APO_0000087', CASE WHEN supp IS NOT NULL THEN ':resistanceToChemical' END, supp, 'increasedComparedTo' FROM h),
p1 AS (SELECT *, {nid("'P-REF'", "':reference-state'", "class", "role", "chemical")} AS ref FROM p0), p2 AS (SELECT *, {nid("'P'", "class", "role", "chemical", "relation", "ref")} AS phenotype FROM p1), p3 AS (SELECT *, {nid("'S'", "phenotype")} AS state FROM p2),
two AS (SELECT a.hypothesis, a.state AS s1, b.state AS s2 FROM p3 a JOIN p3 b ON a.hypothesis = b.hypothesis AND a.side = 1 AND b.side = 2), sm AS (SELECT * FROM p3 WHERE chemical IS NOT NULL)"""


def hypotheses(s, d):
    """(hypotheses, parts): each customer's record, with a clause in text form that is parsed for its phenotypes."""
    c = st._t(s, d, "customer")
    clause = F.concat(F.lit("gene(A):-exhibits_phenotype(A,'increased resistance to chemicals','v1',C),compound_name('v1','"), "c_mktsegment", F.lit("')"))
    hyps = c.select(F.concat(F.lit("hyp-"), "c_custkey").alias("hypothesis"), F.col("c_name").alias("observable"), F.when(F.col("c_acctbal") < 0, "lower").otherwise("higher").alias("qualifier"), F.lit("2025-01-01").alias("created"), F.when(F.col("c_mktsegment") != "BUILDING", "lab").alias("creator"), clause.alias("text"))
    terms = c.select(F.col("c_name").alias("name"), F.concat(F.lit("T"), "c_custkey").alias("term")).unionByName(c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("K"), "c_mktsegment").alias("term")).distinct())
    parsed = pt.parse_clauses(hyps.select(F.col("hypothesis").alias("key"), F.col("text").alias("clause"))).drop("clause").withColumnRenamed("key", "clause")
    states = graph.clause_states(parsed).withColumnRenamed("clause", "hypothesis")
    classes = s.createDataFrame([("resistance to chemicals", graph.RESISTANCE)], "phenotype string, class string")
    return hyps, graph.target_parts(hyps, terms).unionByName(graph.clause_parts(states, classes, terms))


@query("G02_G03_states", f"WITH {HYPO} SELECT hypothesis, CAST(side AS INTEGER) AS side, state FROM p3")
def _(s, d):
    return graph.hypothesis_states(hypotheses(s, d)[1])


@query("G04_G05_hypothesis_quads", f"WITH {HYPO} " + " UNION ".join((
    restr("p3", "'states'", "':reference-state'", "':stateHasObservable'", "ref"), "SELECT 'states', state, 'rdfs:subClassOf', ':organismState' FROM p3", restr("p3", "'states'", "state", "':stateHasObservable'", "phenotype"),
    "SELECT 'phenotypes', ref, 'rdfs:subClassOf', class FROM p3", "SELECT 'phenotypes', phenotype, 'rdfs:subClassOf', class FROM p3", restr("sm", "'phenotypes'", "ref", "role", "chemical"), restr("sm", "'phenotypes'", "phenotype", "role", "chemical"),
    restr("p3", "'phenotypes'", "phenotype", "relation", "ref"), restr("two", "hypothesis", "s1", "':implies'", "s2"), "SELECT 'hypothesis-metadata', hypothesis, 'dcterms:created', '2025-01-01' FROM h", "SELECT 'hypothesis-metadata', hypothesis, 'dcterms:creator', creator FROM h")))
def _(s, d):
    return graph.hypothesis_quads(*hypotheses(s, d))


EXPERIMENTS = """e AS (SELECT CAST(o_custkey AS VARCHAR) AS study, 'study ' || CAST(o_custkey AS VARCHAR) AS hypothesis_text, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS experiment, 'experiment' AS type, 'o' || CAST(o_orderkey AS VARCHAR) AS summary, o_orderpriority AS media_description,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Rich' ELSE 'Minimal media without amino acids' END AS baseline_media, CASE WHEN o_orderstatus <> 'O' THEN 'T' || CAST(o_custkey AS VARCHAR) END AS sup_chemical, CASE WHEN o_orderstatus <> 'O' THEN '5' END AS sup_value, 'mM' AS sup_unit,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'K' || c_mktsegment END AS treat_chemical, NULL AS treat_value, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'mM' END AS treat_unit, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS estimate, CAST(o_orderkey AS VARCHAR) AS pv
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def experiments(s, d):
    o = st._t(s, d, "orders").join(st._t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    given, treated = F.col("o_orderstatus") != "O", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.select(F.col("o_custkey").cast("string").alias("study"), F.concat(F.lit("study "), "o_custkey").alias("hypothesis_text"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("experiment"), F.lit("experiment").alias("type"), F.concat(F.lit("o"), "o_orderkey").alias("summary"), F.col("o_orderpriority").alias("media_description"),
                    F.when(F.col("o_orderpriority") == "5-LOW", "Rich").otherwise("Minimal media without amino acids").alias("baseline_media"), F.when(given, F.concat(F.lit("T"), "o_custkey")).alias("sup_chemical"), F.when(given, "5").alias("sup_value"), F.lit("mM").alias("sup_unit"),
                    F.when(treated, F.concat(F.lit("K"), "c_mktsegment")).alias("treat_chemical"), F.lit(None).cast("string").alias("treat_value"), F.when(treated, "mM").alias("treat_unit"), F.round("o_totalprice").cast("bigint").cast("string").alias("estimate"), F.col("o_orderkey").cast("string").alias("p"))


def _union(rows, source):
    return " UNION ".join(f"SELECT {', '.join(f'{v} AS {k}' for k, v in zip('gspo', r))} FROM {source} WHERE {r[3]} IS NOT NULL" for r in rows)


_S, _A = "'STUDY-' || study", "'EXP-' || study || '-' || CAST(experiment AS VARCHAR)"
_M, _U, _T, _P = f"{_A} || '-medium'", f"{_A} || '-cellculture'", f"{_A} || '-treatment'", "':saccaharomyces-cerevisiae-population'"
_RDF = [(_S, "rdf:type", "'obo:OBI_0500000'"), (_S, "rdfs:label", "hypothesis_text"), (_S, "obo:BFO_0000051", _A), (_A, "rdf:type", "'obo:OBI_0000070'"), (_A, "rdfs:label", "type || ': ' || summary"), *((_A, "obo:OBI_0000293", x) for x in (_U, _M, _T)),
        (_U, "rdf:type", "'obo:OBI_0001876'"), (_U, "obo:BFO_0000051", _P), (_U, "obo:BFO_0000051", _M), (_P, "rdf:type", "'obo:NCBITaxon_4932'"), (_M, "rdf:type", "'obo:OBI_0000079'"), (_M, "rdfs:label", "media_description"), (_M, ":baselineMedia", "baseline_media"), (_M, ":mediaSupplementation", "sup_chemical"),
        (_M, ":mediaSupplementationDosesValue", "sup_value"), (_M, ":mediaSupplementationDosesUnit", "sup_unit"), (_T, "rdf:type", "':treatment'"), (_T, ":treatmentWithChemical", "treat_chemical"), (_T, ":treatmentParametersValue", "CAST(treat_value AS VARCHAR)"), (_T, ":treatmentParametersUnit", "treat_unit")]


@query("G06_protocol_quads", f"WITH {EXPERIMENTS} " + _union([("'experiments'", x, f"'{p}'", o) for x, p, o in _RDF], "e"))
def _(s, d):
    return graph.protocol_quads(experiments(s, d))


_G = "'GROWTH-' || study || '-auc-forest-' || CAST(experiment AS VARCHAR)"
_R, _N = f"{_G} || '-reference-condition'", f"{_G} || '-test-condition'"
_TESTS = [(_G, "rdf:type", "':AUCForestComparativeTest'"), (_G, ":referenceCondition", _R), (_G, ":testCondition", _N), (_G, ":GLMCoefficient", "estimate"), (_G, ":pValue", "pv"), (_R, ":growthDataFromAssay", "'EXP-' || study || '-1'"), (_R, "rdfs:label", "'Treatment=None, Supplement=None'"), (_N, ":growthDataFromAssay", _A), (_N, "rdfs:label", "summary"),
          *((x, "rdf:type", "':growthDataTestCondition'") for x in (_R, _N)), *((x, f":testConditionHas{k}", v) for x in (_R, _N) for k, v in (("Treatment", "treat_unit"), ("Supplement", "sup_unit")))]


def tests(e):
    return e.select("study", F.col("experiment").alias("i"), F.col("experiment").alias("assay"), "estimate", "p", F.col("treat_unit").alias("treatment"), F.col("sup_unit").alias("supplement"), F.col("summary").alias("link"))


@query("G07_growth_test_quads", f"WITH {EXPERIMENTS} " + _union([("'growth-data'", x, f"'{p}'", o) for x, p, o in _TESTS], "e"))
def _(s, d):
    return graph.growth_test_quads(tests(experiments(s, d)))


def whole_store(s, d):
    e = written(experiments(s, d))
    terms = s.createDataFrame([("ontology", f"{k}ComparedTo", "rdfs:subPropertyOf", ":differsFrom") for k in ("increased", "decreased")] + [("ontology", "obo:APO_0000001", "rdfs:subClassOf", graph.RESISTANCE)], "g string, s string, p string, o string")
    return terms.unionByName(graph.hypothesis_quads(*hypotheses(s, d))).unionByName(graph.protocol_quads(e)).unionByName(graph.growth_test_quads(tests(e)))  # sets whose graphs differ


@query("G11_J17_hypotheses_with_tests", f"""WITH {EXPERIMENTS}, c AS (SELECT 'hyp-' || CAST(c_custkey AS VARCHAR) AS h, CASE WHEN c_acctbal < 0 THEN 'decreasedComparedTo' ELSE 'increasedComparedTo' END AS ql1, 'T' || CAST(c_custkey AS VARCHAR) AS hypo_aa, 'increasedComparedTo' AS ql2, 'K' || c_mktsegment AS hypo_supp, c_mktsegment <> 'MACHINERY' AS ok FROM customer),
a AS (SELECT * FROM e WHERE baseline_media LIKE 'Minimal%'), b AS (SELECT study, hypothesis_text FROM a WHERE experiment = 1 AND sup_chemical IS NULL AND treat_chemical IS NULL),
t AS (SELECT 'STUDY-' || b.study AS study, b.hypothesis_text AS label, x.sup_chemical AS aa, y.treat_chemical AS su, x.estimate AS coef_aa, x.pv AS p_aa, y.estimate AS coef_aa_supp, y.pv AS p_aa_supp FROM b JOIN a x ON x.study = b.study AND x.sup_chemical IS NOT NULL AND x.treat_chemical IS NULL JOIN a y ON y.study = b.study AND y.sup_chemical = x.sup_chemical AND y.treat_chemical IS NOT NULL)
SELECT h, CASE WHEN ok THEN ql1 END AS ql1, CASE WHEN ok THEN hypo_aa END AS hypo_aa, CASE WHEN ok THEN ql2 END AS ql2, CASE WHEN ok THEN hypo_supp END AS hypo_supp, study, label, coef_aa, p_aa, coef_aa_supp, p_aa_supp FROM c LEFT JOIN t ON ok AND t.aa = hypo_aa AND t.su = hypo_supp""")
def _(s, d):
    return graph.hypotheses_with_tests(whole_store(s, d))


@query("U06_exported", f"WITH {HYPO}, e AS (SELECT 'hypothesis-metadata' AS g, hypothesis AS s FROM h WHERE supp IS NOT NULL) SELECT s, count(*) AS n FROM e GROUP BY s")
def _(s, d):
    hyps, parts = hypotheses(s, d)
    parts = written(parts)
    without = hyps.select("hypothesis").join(parts.where("side = 2 and chemical is null").select("hypothesis"), "hypothesis", "left_semi")
    full = parts.join(without, "hypothesis", "left_anti")
    store = graph.exported(graph.hypothesis_quads(hyps.withColumn("created", F.lit(None).cast("string")), full))
    return store.where(F.col("g") == graph.METADATA).groupBy("s").agg(F.count("*").alias("n"))


@query("U06_exported_quads", f"WITH {HYPO}, k AS (SELECT * FROM p3 WHERE hypothesis IN (SELECT hypothesis FROM h WHERE supp IS NOT NULL)), kt AS (SELECT * FROM two WHERE hypothesis IN (SELECT hypothesis FROM k)) " + " UNION ".join((
    restr("k", "'states'", "':reference-state'", "':stateHasObservable'", "ref"), "SELECT 'states', state, 'rdfs:subClassOf', ':organismState' FROM k", restr("k", "'states'", "state", "':stateHasObservable'", "phenotype"),
    "SELECT 'phenotypes', ref, 'rdfs:subClassOf', class FROM k", "SELECT 'phenotypes', phenotype, 'rdfs:subClassOf', class FROM k", restr("k", "'phenotypes'", "ref", "role", "chemical"), restr("k", "'phenotypes'", "phenotype", "role", "chemical"),
    restr("k", "'phenotypes'", "phenotype", "relation", "ref"), restr("kt", "hypothesis", "s1", "':implies'", "s2"), "SELECT 'hypothesis-metadata', hypothesis, 'dcterms:creator', creator FROM h WHERE supp IS NOT NULL")))
def _(s, d):
    """All graphs of the export but the ontology's; hypotheses whose compound has no term have no graph, so no metadata either."""
    hyps, parts = hypotheses(s, d)
    parts = written(parts)
    without = parts.where("side = 2 and chemical is null").select("hypothesis")
    ontology = s.createDataFrame([("ontology", "increasedComparedTo", "rdfs:subPropertyOf", ":differsFrom")], "g string, s string, p string, o string")
    made = graph.hypothesis_quads(hyps.withColumn("created", F.lit(None).cast("string")), parts.join(without, "hypothesis", "left_anti"))
    return graph.exported(made.unionByName(ontology)).select("g", "s", "p", "o")


@query("J21_seeded_paths", "WITH RECURSIVE e AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS child, 'c' || CAST(o_custkey AS VARCHAR) AS parent FROM orders UNION SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation UNION SELECT 'c' || CAST(o_custkey AS VARCHAR), 'p' || o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL), seeds AS (SELECT parent FROM (VALUES ('r1'), ('r3'), ('n3'), ('p1-URGENT'), ('none')) AS v(parent)), c AS (SELECT parent AS child, parent FROM seeds UNION SELECT e.child, c.parent FROM c JOIN e ON e.parent = c.child) SELECT child, parent FROM c")
def _(s, d):
    """Orders, customers, nations and regions as a graph: what leads to five seeds, two of which hang together and one of which no edge names."""
    name = lambda k, c: F.concat(F.lit(k), c)
    o, c, n = (st._t(s, d, t) for t in ("orders", "customer", "nation"))
    edges = o.select(name("o", "o_orderkey").alias("child"), name("c", "o_custkey").alias("parent")).union(c.select(name("c", "c_custkey"), name("n", "c_nationkey"))).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(o.select(name("c", "o_custkey"), name("p", "o_orderpriority")))
    return graph.reaching(edges, s.createDataFrame([(x,) for x in ("r1", "r3", "n3", "p1-URGENT", "none")], "parent string"))


@query("J11_P25_library_brands", "SELECT DISTINCT 'BRAND#' || CAST(s_suppkey AS VARCHAR) AS key, p_partkey, p_name, p_brand FROM part JOIN supplier ON contains(lower(p_brand), 'brand#' || CAST(s_suppkey AS VARCHAR)) OR contains(lower(p_name), 'brand#' || CAST(s_suppkey AS VARCHAR))")
def _(s, d):
    return dosing.library_matches(st._t(s, d, "supplier").select(F.concat(F.lit("BRAND#"), "s_suppkey").alias("key")), st._t(s, d, "part").select("p_partkey", "p_name", "p_brand")).select("key", "p_partkey", "p_name", "p_brand")


SUPPORT = ", a AS (SELECT s AS study, o AS assay FROM quads WHERE p = 'hasAssay'), found AS (SELECT study, assay FROM a WHERE EXISTS (SELECT 1 FROM quads WHERE p = 'hasSupplement' AND s = assay AND o = '1-URGENT') AND EXISTS (SELECT 1 FROM quads WHERE p = 'hasTreatment' AND s = assay AND o = 'F') AND study IN (SELECT study FROM a b WHERE b.assay NOT IN (SELECT s FROM quads WHERE p = 'hasSupplement') AND b.assay NOT IN (SELECT s FROM quads WHERE p = 'hasTreatment')))"


@query("G09_study_exists", Q + SUPPORT + " SELECT count(*) > 0 AS answer FROM found")
def _(s, d):
    return graph.study_exists(st.quads(s, d), "1-URGENT", "F")


@query("G12_S18_ask_then_select", Q + SUPPORT + " SELECT study, assay FROM found WHERE EXISTS (SELECT 1 FROM found)")
def _(s, d):
    q = graph.staged(st.quads(s, d))
    return graph.select_if(graph.study_exists(q, "1-URGENT", "F"), graph.support_query(q, "1-URGENT", "F"))


@query("G13_adhoc_sql", Q + "SELECT a.o AS value, count(DISTINCT b.s) AS studies FROM quads a JOIN quads b ON b.o = a.s AND b.p = 'hasAssay' WHERE a.p = 'hasSupplement' GROUP BY a.o")
def _(s, d):
    return graph.queried(s, st.quads(s, d), "SELECT a.o AS value, count(DISTINCT b.s) AS studies FROM {quads} a JOIN {quads} b ON b.o = a.s AND b.p = 'hasAssay' WHERE a.p = 'hasSupplement' GROUP BY a.o")
