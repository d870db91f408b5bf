import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import scalars as sc
from assaygrid.operators import dosing, growth, metabolomics, patterns, stats
from assaygrid.operators.metabolomics import greedy_groups


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def curve(spark, od, well="A1"):
    return spark.createDataFrame([("s", "p", well, i, i * 1200, float(v), "g") for i, v in enumerate(od)], "study string, plate string, well string, t_index int, t_sec int, od double, grp string")


def test_scalars(spark):
    assert one(spark, sc.unify_well(F.lit("A01")), sc.unify_well(F.lit("H12")), sc.first_number(F.lit("x 2.5 mM")), sc.first_number(F.lit("none"))) == ("A1", "H12", 2.5, 0.0)
    assert tuple(one(spark, sc.concentration(F.lit("10% (v/v)")))[0]) == (10.0, "%", "v/v")
    assert one(spark, sc.json_body(F.lit('```json\n{"a": 1}\n```')), sc.json_body(F.lit("no"))) == ('{"a": 1}', None)
    assert one(spark, sc.specificity(F.lit(0.5), F.lit(0.0), 0))[0] < 1 and one(spark, sc.specificity(F.lit(0.5), F.lit(0.0), 1))[0] == 1
    assert one(spark, sc.statements(F.lit("1. a b\nx\n2) c")))[0] == ["a b", "c"]
    assert one(spark, sc.inner_predicates(F.lit("f(1,(g(A):-p(A,b),q(c)))")))[0] == ["g(A)", "p(A,b)", "q(c)"]


def test_loess_keeps_lines(spark):
    got = growth.loess(curve(spark, [1 + 0.5 * i for i in range(20)])).orderBy("t_index").collect()
    assert all(abs(r.od - (1 + 0.5 * r.t_index)) < 1e-6 for r in got)


def test_growth_rate(spark):
    got = growth.growth_rate(curve(spark, [0.1] * 20 + [0.1 * 2.718281828 ** (i / 3 * 0.4) for i in range(12)])).first()
    assert abs(got.mu - 0.4) < 1e-6
    assert growth.growth_rate(curve(spark, [0.1])).first().mu == 0.0


def test_auc_adds_up(spark):
    c = curve(spark, [0, 1, 4, 2, 3])
    auc = lambda df: growth.features(df).first().auc
    assert auc(c) == auc(c.where("t_index <= 2")) + auc(c.where("t_index >= 2")) == 10200.0


def test_bootstrap(spark):
    rows = [("s", i, i % 2, float(i % 3), i % 5 == 0 and 1 or 0, 1.0 + 2.0 * (i % 2) - (i % 3) + 0.01 * (i % 7)) for i in range(60)]
    x = stats.design(spark.createDataFrame(rows, "study string, row_id int, treated int, dose double, neg int, y double"))
    s = {r.term: r for r in stats.bootstrap_summary(stats.bootstrap(x, "study", draws=100), stats.ols(x, "study"), "study").collect()}
    assert abs(s["treated"].estimate - 2) < 0.05 and s["treated"].ci_lo < 2.05 and abs(s["treated"].p_emp - 1 / 101) < 1e-9
    assert s["Intercept"].pct_change is None
    eq = stats.equimolar(stats.ols(x, "study").withColumns({"ci_lo": F.lit(0.0), "ci_hi": F.lit(1.0)}), 5).collect()
    assert len(eq) == 8


def test_mann_whitney_and_bh(spark):
    df = spark.createDataFrame([("f", True, 1.0), ("f", True, 2.0), ("f", False, 2.0), ("f", False, 5.0), ("f", False, None)], "f string, is_a boolean, value double")
    r = stats.mann_whitney(df, "f").first()
    assert (r.u, r.n1, r.n2) == (0.5, 2, 2) and 0 < r.p <= 1
    p = spark.createDataFrame([(0.01,), (0.02,), (0.04,)], "p double")
    assert [round(r.p_adj, 9) for r in stats.benjamini_hochberg(p).orderBy("p").collect()] == [0.03, 0.03, 0.04]


def test_greedy_groups(spark):
    pairs = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "d")], "study string, f1 string, f2 string")
    assert {r.feature: r.seed for r in greedy_groups(pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_clauses():
    assert patterns.parse_clause("h(A):-p(A,'x, (y'),q(b,f(c,d)).") == ("h(A)", [("p", ["A", "x, (y"]), ("q", ["b", "f(c,d)"])])
    assert patterns.parse_clause("h(A):-p(A") is None and patterns.parse_clause(None) is None
    assert patterns.parse_clause("p(A,'b'),q(C)") == (None, [("p", ["A", "b"]), ("q", ["C"])])
    assert patterns.parse_clause("h(A):-p(A,\"it's :- x\")") == ("h(A)", [("p", ["A", "it's :- x"])])
    assert patterns.parse_clause("h(A):-p(A,'d\\'e')") == ("h(A)", [("p", ["A", "d'e"])])


def test_clauses_in_catalyst_and_python_agree(spark):
    texts = ["gene(A):-p(A, x,B),q(B,c)", "gene(A):-p(A,'x, y',B).", "p(A,b)", "x", "", None, "h(A):-p(A),f(g(B))"]
    got = patterns.parse_clauses(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, clause string")).orderBy("k").collect()
    for t, r in zip(texts, got):
        want = patterns.parse_clause(t)
        assert (None if r.parsed is None else (r.parsed.head, [(a.name, list(a.args)) for a in r.parsed.atoms])) == want


def test_greedy_cover_fills_up(spark):
    sets = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "gene string, profile string")
    assert [tuple(r) for r in patterns.greedy_cover(sets, 5).orderBy("step").collect()] == [(1, "a", 1), (2, "c", 1), (3, "b", 0)]

    def plain(sets, n):
        own, seen, out = {}, set(), []
        for g, p in sets:
            own.setdefault(g, set()).add(p)
        while own and len(out) < n:
            g = min(own, key=lambda g: (-len(own[g] - seen), g))
            out.append((len(out) + 1, g, len(own[g] - seen)))
            seen |= own.pop(g)
        return out

    rows = [(f"g{i % 13:02d}", f"p{i * i % 17}") for i in range(60)]
    assert [tuple(r) for r in patterns.greedy_cover(spark.createDataFrame(rows, "gene string, profile string"), 12).orderBy("step").collect()] == plain(rows, 12)


def test_volumes_with_a_negative_part_are_not_ok(spark):
    v = one(spark, sc.volume_balance(F.lit(270.0), F.lit(18.0), [F.lit(-50.0)]))[0]
    assert (v.water, v.ok) == (302.0, False)


def test_matrix_keeps_studies_apart(spark):
    peaks = spark.createDataFrame([("s", "a", "f", 1.0), ("t", "a", "f", 2.0), ("t", "a", "g", 3.0)], "study string, sample string, feature string, area double")
    assert sorted(map(tuple, metabolomics.to_matrix(peaks).select("study", "sample", "f", "g").collect())) == [("s", "a", 1.0, None), ("t", "a", 2.0, 3.0)]


def test_exact_u_test(spark):
    from itertools import combinations

    a, b = [1.0, 4.0, 9.0], [2.0, 3.0, 5.0, 7.0]
    df = spark.createDataFrame([("f", True, v) for v in a] + [("f", False, v) for v in b], "f string, is_a boolean, value double")
    r = stats.mann_whitney(df, "f").first()
    every = [sum(k + 1 for k in c) - 6 for c in combinations(range(7), 3)]
    far = max(r.u, 12 - r.u)
    assert abs(r.p - min(1.0, 2 * sum(u >= far for u in every) / len(every))) < 1e-12


def test_folds_and_ranks_over_the_whole_table(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 2).alias("c"))
    sizes = sorted(r["count"] for r in stats.folds(df, 10, 1).groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3
    p = spark.createDataFrame([(float(x),) for x in (0.04, 0.01, 0.02, 0.02)] + [(None,)], "p double")
    assert sorted((r.p is None, r.p, round(r.p_adj, 9) if r.p_adj is not None else None) for r in stats.benjamini_hochberg(p).collect() if r.p is not None) == [(False, 0.01, 0.026666667), (False, 0.02, 0.026666667), (False, 0.02, 0.026666667), (False, 0.04, 0.04)]


def test_run_list(spark):
    s = spark.createDataFrame([("p", f"w{k}", "g", k) for k in range(1, 9)], "plate string, well string, grp string, place int")
    names = [r.name for r in dosing.run_list(s).orderBy("run").collect()]
    assert names[:5] == ["Tune"] + ["Blank"] * 4 and names[5:7] == ["QC", "QC"] and names[-5:] == ["QC"] + ["Blank"] * 4 and len(names) == 5 + 2 * 7 + 8


def test_bootstrap_draws_exactly_n_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "PART", 32)  # several parts
    rng = np.random.default_rng(5)
    rows = [(g, None if i < 3 else i % 90, 1.0, float(v), float(3 + 2 * v + e)) for g, n in (("s", 200), (None, 40), ("tiny", 1)) for i, (v, e) in enumerate(rng.normal(size=(n, 2)))] + [("s", 7, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "study string, row_id int, x0 double, x1 double, y double")
    seen, solved = {}, stats._solved

    def spy(grams, by, k):
        seen["grams"] = grams
        return solved(grams, by, k)

    monkeypatch.setattr(stats, "_solved", spy)
    boot = stats.bootstrap(df, "study", draws=600, k=2)
    drawn = {(r.study, r.b): r.g0_0 for r in seen["grams"].collect()}
    assert len(drawn) == 1800 and all(n == {"s": 200, None: 40, "tiny": 1}[g] for (g, _), n in drawn.items())
    assert sorted(map(tuple, boot.collect()), key=str) == sorted(map(tuple, stats.bootstrap(df, "study", draws=600, k=2).repartition(3).collect()), key=str)
    x, y = (np.array([r[c] for r in rows if r[0] == "s" and r[4] is not None]) for c in (3, 4))
    slopes = np.array([r.estimate for r in boot.where("study = 's' and term = 'x1'").collect()])
    plain = [np.polyfit(x[k], y[k], 1)[0] for k in (rng.integers(0, 200, 200) for _ in range(600))]
    assert abs(slopes.mean() - np.mean(plain)) < 0.02 and 0.85 < slopes.std() / np.std(plain) < 1.18


def test_part_counts_add_up_and_follow_sizes():
    sizes = [5, 0, 100, 1, 30, 64]
    counts = np.array([stats.part_counts(sizes, p, 2000, 3) for p in range(6)])
    assert (counts.sum(0) == 200).all() and np.allclose(counts.mean(1), sizes, atol=0.5) and (counts[1] == 0).all()


def test_regression_scores_of_constant_and_missing_values(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, 3.0), (None, 1.0, 1.0), (None, 3.0, 2.0), ("b", None, 1.0), ("b", 1.0, None)], "target string, y double, p double")
    got = {r.target: (r.r2, r.mae, r.rmse) for r in stats.regression_scores(df, "target").collect()}
    assert got == {"a": (None, 1.0, 1.0), None: (0.5, 0.5, 0.5 ** 0.5)}


def test_loess_leaves_missing_readings_out(spark):
    c = curve(spark, [1 + 0.5 * i + 0.1 * (i * 7 % 5) for i in range(20)]).withColumn("od", F.when(~F.col("t_index").isin(0, 7), F.col("od")))
    got, without = ({r.t_index: r.od and round(r.od, 9) for r in growth.loess(x).collect()} for x in (c, c.where("od is not null")))
    assert got == {0: None, 7: None, **without} and all(abs(v - (1.2 + 0.5 * t)) < 0.3 for t, v in without.items())
    assert [r.od for r in growth.loess(c.withColumn("od", F.lit(None).cast("double"))).collect()] == [None] * 20


def test_outliers_of_wells_without_a_group(spark):
    feats = spark.createDataFrame([("s", 1, f"w{k}", g, 10.0 + k % 3 + 1000.0 * (k == 5), 1.0, 1.0) for k in range(12) for g in [None if k < 6 else "g"]], "study string, plate int, well string, grp string, auc double, last_od double, tv double")
    assert {r.well: r.outlier for r in growth.mad_outliers(feats).collect()} == {f"w{k}": k == 5 for k in range(12)}


def test_volumes_of_an_empty_stock(spark):
    assert one(spark, sc.dilution_volume(F.lit(0.0), F.lit(1.0), F.lit(2.0)))[0] is None and one(spark, sc.percent_volume(F.lit(5.0), F.lit(270.0), F.lit(0.0)))[0] is None
    assert one(spark, sc.dilution_volume(F.lit(0), F.lit(0), F.lit(2)))[0] == 0


def test_clause_arguments_keep_lists_whole(spark):
    text = ["g(A):-p(A,[x,y])", "g(A):-p(A,f(b,[c,d])),q({e,f},'[')", "g(A):-p(A,b)", "g(A):-p(A,[x)"]
    got = patterns.parse_clauses(spark.createDataFrame([(t,) for t in text], "clause string")).collect()
    assert [[(a.name, a.args) for a in r.parsed.atoms] if r.parsed else None for r in got] == [[("p", ["A", "[x,y]"])], [("p", ["A", "f(b,[c,d])"]), ("q", ["{e,f}", "["])], [("p", ["A", "b"])], None]


def test_identical_groups_on_bitmaps(spark):
    """More genes than one bucket holds, repeated rows, a null gene, patterns that differ in one gene of one bucket."""
    genes = spark.range(70_000).select(F.col("id").cast("string").alias("gene"))
    named = lambda p, rows: rows.select(F.lit(p).alias("pattern_id"), "gene")
    none = spark.createDataFrame([(None,)], "gene string")
    cover = named("b", genes).union(named("a", genes)).union(named("a", genes)).union(named("c", genes.where("gene <> '69999'"))).union(named("d", none)).union(named("e", none)).union(named("f", none.union(genes.limit(1))))
    assert sorted(map(tuple, patterns.identical_groups(cover).collect())) == [("a", "b"), ("c", ""), ("d", "e"), ("f", "")]
    assert patterns.bitmaps(cover).groupBy("pattern_id").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("pattern_id = 'a'").first().n == 70_000
    assert patterns.identical_groups(cover.limit(0)).count() == 0


def test_time_axis_beyond_an_int(spark):
    rows = [("a", k) for k in range(4)] + [("b", 1), ("b", 1), ("b", None)]
    readings = spark.createDataFrame([("s", *r) for r in rows], "study string, plate string, file_time int")
    got = growth.time_axis(readings, 1_000_000_000)
    assert dict(got.dtypes)["t_sec"] == "bigint" and dict(growth.time_axis(readings).dtypes)["t_sec"] == "int"
    assert sorted((r.plate, r.file_time or 0, r.t_index, r.t_sec) for r in got.collect()) == [("a", k, k, k * 10**9) for k in range(4)] + [("b", 0, 0, 0), ("b", 1, 1, 10**9), ("b", 1, 1, 10**9)]


def test_patterns_that_share_a_cover(spark):
    """Targets with the same values are one cover: its rows do not multiply with them; the listed patterns are those of a plain search."""
    facts = [(g, f"s{g % 2}", v, c) for g in range(6) for v in range(g % 4) for c in ("A", "N")] + [(7, None, 1, "A"), (None, "s0", 2, None)] * 2
    phenotypes = spark.createDataFrame(facts, "gene long, state string, value int, cond string")
    given = [(100 + k, k % 2, f"a{k % 3}") for k in range(60)] + [(100, 2, "a0"), (7, 9, "a1"), (8, None, "a1"), (9, 1, None), (None, 1, "a1"), (None, 2, "a1")]
    targets = spark.createDataFrame(given, "gene long, value int, action string")
    pathways = spark.createDataFrame([(g, m) for g in range(8) for m in ("x", "y")[: g % 3]], "gene long, metabolite string")
    text = lambda *xs: "|".join(str(x) for x in xs if x is not None)
    want = {(text("target", g, a), f[0]) for g, v, a in given for f in facts if v is not None and f[2] == v}
    want |= {(text(n, *x), g) for g, s, v, c in facts for n, x in (("state", (s,)), ("state_cond", (s, c)), ("state_value", (s, v)), ("state_value_cond", (s, v, c)))}
    ways = [tuple(r) for r in pathways.collect()]
    want |= {(text("pathway", m), g) for g, m in ways} | {(text("state_pathway", f[1], m), g) for g, m in ways for f in facts if f[0] == g}
    got, rows = patterns.shared_coverage(phenotypes, targets, pathways)
    assert got.where("pattern_id like 'target|%'").count() == 63 and rows.where("cover like 'values|%'").select("cover").distinct().count() == 4
    cover = [tuple(r) for r in patterns.coverage(phenotypes, targets, pathways).collect()]
    assert len(cover) == len(set(cover)) and set(cover) == want
    genes = {}
    for p, g in want:
        genes.setdefault(p, set()).add(g)
    support = sorted(((p, len(x - {None})) for p, x in genes.items() if len(x - {None}) >= 2), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in patterns.frequent_shared(got, rows, 2, 1.0, 30).collect()] == support[:30]
    same = {}
    for p, x in genes.items():
        same.setdefault(frozenset(x), []).append(p)
    assert sorted(map(tuple, patterns.identical_groups(rows, got).collect())) == sorted((sorted(x)[0], ",".join(sorted(x)[1:])) for x in same.values())
    wanted = spark.createDataFrame([(g,) for g in (1, 3, 99, None)], "gene long")
    found = sorted(((r.gene, r.pattern_id) for r in patterns.features_of_shared(wanted, got, rows).collect()), key=str)
    assert found == sorted([(g, p) for p, g in want if g in (1, 3)] + [(99, None), (None, None)], key=str)


def test_features_of_targets_repeat_lists_of_genes(spark, tmp_path):
    """2.5 million rows of 100 genes and 25,000 patterns take under a byte a row; a target given twice has its rows twice."""
    patterns_ = spark.range(25_000).select(F.concat(F.lit("target|"), "id", F.lit("|a0")).alias("pattern_id"), F.when(F.col("id") < 24_990, "u").otherwise("v").alias("cover"))
    rows = spark.range(100).select(F.lit("u").alias("cover"), F.col("id").alias("gene")).union(spark.createDataFrame([("v", 7), ("none", 7), ("v", None)], "cover string, gene long"))
    targets = spark.range(101).select(F.col("id").alias("gene"), F.lit("x").alias("kind")).union(spark.createDataFrame([(7, "y")], "gene long, kind string"))
    patterns.features_of_shared(targets, patterns_, rows).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    each = {(r.gene, r.kind): (r.n, r.k) for r in got.groupBy("gene", "kind").agg(F.count("*").alias("n"), F.count("pattern_id").alias("k")).collect()}
    assert got.columns == ["gene", "kind", "pattern_id"]
    assert each == {(g, "x"): (24_990, 24_990) for g in range(100)} | {(7, k): (25_001, 25_000) for k in "xy"} | {(100, "x"): (1, 0)}
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2_000_000


@pytest.mark.parametrize("share", (0.01, 0.4))
def test_clause_bodies_against_plain_search(spark, monkeypatch, share):
    """Nulls, repeated facts and texts that two shapes share; of genes only facts and numbers are exchanged, no (body, gene) row is written."""
    facts = [(g, f"s{(g + k) % 3}", (g * k) % 4 if k < 5 else None, "AN"[k % 2] if k else None) for g in range(9) for k in range(g % 7)] + [(None, "s0", 1, "A"), (3, None, 1, "A")] + [(4, "s1,name,n1", 2, "N")] * (share < 0.1)
    names, conditions = [(0, "n0"), (1, "n1"), (2, "n1"), (2, "n2")], [("A", "warm"), ("N", "cold,x")]
    given, ways = [(1, "a0", 50), (2, "a0", 51), (2, "a1", 50), (None, "a1", 51)], [(50, "m", "q"), (50, "m", "r"), (51, "m", "q")]
    frames = [spark.createDataFrame(facts * 2, "gene long, state string, value int, cond string"), spark.createDataFrame(names, "value int, name string"), spark.createDataFrame(conditions, "cond string, text string"),
              spark.createDataFrame(given, "value int, action string, through long"), spark.createDataFrame(ways, "gene long, kind string, metabolite string")]
    tails = lambda v, c: {f"name,{n}" for x, n in names if x == v} | {f"target,{a}" for x, a, _ in given if x == v and v is not None} | {f"condition,{t}" for x, t in conditions if x == c}
    real = [f for f in facts if f[1] is not None]
    one, two, found = {(s, g) for g, s, _, _ in real}, {(f"{s},{a}", g) for g, s, v, c in real for a in tails(v, c)}, set()
    found |= one | two | {(f"{s},target,{a},pathway,{k},{m}", g) for g, s, v, _ in real for x, a, t in given for h, k, m in ways if v is not None and x == v and h == t}
    found |= {(f"{s},{a},{b}", g) for g, s, v, c in real if None not in (g, v, c) for a in tails(v, c) for b in tails(v, c) if a < b}
    found |= {(f"{x}&{y}", g) for x, g in one for y, h in one if g is not None and g == h and x < y} | {(f"{x}&{y}", g) for x, g in two for y, h in one if g is not None and g == h}
    found |= {(f"{x}&{y}&{z}", g) for x, g in one for y, h in one for z, i in one if g is not None and g == h == i and x < y < z}
    genes = {}
    for item, g in found:
        genes.setdefault(item, set()).add(g)
    wrote, keep = [], patterns.written
    monkeypatch.setattr(patterns, "written", lambda df: wrote.append(df.columns) or keep(df))
    want = {item: len(x - {None}) for item, x in genes.items() if len(x - {None}) >= share * len({f[0] for f in facts} - {None})}
    got = [tuple(r) for r in patterns.clause_support(*frames, share).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
    cover = [tuple(r) for r in patterns.clause_cover(*frames, share).collect()]
    assert len(cover) == len(set(cover)) and set(cover) == {(i, g) for i in want for g in genes[i]}
    assert [c for c in wrote if "gene" in c] == 2 * [["gene", "state", "value", "cond"]]
