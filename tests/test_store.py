import random

import pytest
from pyspark.sql import functions as F

from assaygrid.operators import graph, patterns, staging, store
from assaygrid.operators.store import labelled
from assaygrid.plans import studies


def plain_reach(edges, seeds):
    down = {}
    for c, p in edges:
        down.setdefault(p, set()).add(c)
    got = set()
    for seed in seeds:
        todo, seen = [seed], {seed}
        while todo:
            for c in down.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        got |= {(x, seed) for x in seen}
    return got


def reached(spark, edges, seeds):
    got = graph.reaching(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([(x,) for x in seeds], "parent string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_reaching_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"x{rng.randrange(40)}", f"x{rng.randrange(40)}") for _ in range((25, 45, 70)[seed])]
    seeds = [f"x{rng.randrange(45)}" for _ in range(4)]
    assert reached(spark, edges + edges[:5], seeds + seeds[:1]) == plain_reach(edges, seeds)


def test_reaching_cycles_nulls_and_empty(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", None), (None, "s"), ("g", "s"), ("h", "g")]
    assert reached(spark, edges, ["s", None]) == {("s", "s"), ("g", "s"), ("h", "s")}
    assert reached(spark, edges, ["b"]) == {(x, "b") for x in "abcd"}
    assert reached(spark, [], ["s"]) == {("s", "s")} and reached(spark, edges, []) == set()


def test_reaching_a_long_chain(spark):
    n = 10_000
    edges = spark.range(n).select(F.concat(F.lit("t"), "id").alias("child"), F.concat(F.lit("t"), F.col("id") + 1).alias("parent"))
    got = graph.reaching(edges, spark.createDataFrame([(f"t{n}",), ("t5000",)], "parent string"))
    assert {r.parent: r["count"] for r in got.groupBy("parent").count().collect()} == {f"t{n}": n + 1, "t5000": 5001}


def test_labelled_rows_and_hot_keys(spark):
    rows = [("p", "k", i) for i in range(5)] + [("q", f"k{i}", i) for i in range(5)] + [("q", None, 9), (None, "k", 1), ("", "k", 2)]
    df = spark.createDataFrame(rows, "label string, key string, v int")
    got = labelled(df, "label", "key", 4, most=2)
    assert got.hot == {"p"} and sorted(r.v for r in got.of("p").collect()) == [0, 1, 2, 3, 4] and sorted(r.v for r in got.of("q").collect()) == [0, 1, 2, 3, 4, 9]
    assert got.all().count() == 11 and got.of("none").count() == 0 and got.all().columns == df.columns
    cool = labelled(df, "label", "key", 4)
    assert not cool.hot and cool.all().count() == 11
    assert labelled(df.limit(0), "label", "key").all().count() == 0


def test_subject_joins_need_no_exchange(spark):
    rows = [("g", f"s{i}", p, f"o{i % 7}") for i in range(200) for p in ("a", "b", "c")]
    store = graph.stored(spark.createDataFrame(rows, "g string, s string, p string, o string"), 4).quads
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = lambda p: graph.pattern(store, p, "s", p).drop("g")
        got = one("a").join(one("b"), "s").join(one("c"), "s")
        assert got.count() == 200 and "Exchange" not in got._jdf.queryExecution().sparkPlan().toString() and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clauses_with_quotes(spark):
    texts = ["h(A):-p(A,'x, (y'),q(b,\"c:-d\").", "h(A):-p(A,,b),q()", " h(A) :- p( 'a b' , \"it's\" ) , r(x) .", "h(A):-p('a' 'b')", "h(A):-p(A,'d\\'e')", "h(A):-p(f(x),'y')", "h(A):-p(A,'open)", "h(A):-p(a:-b)",
             "h(A):-p('')", "h(A):-p(A),", "h('q'):-p(A)", "h(A):-P(A)", "h(A):-p(A,[x,y])", "", None, "h(A):-p(A,'" + "z" * 5000 + "')", "h(A):-" + ",".join(f"p(A,'v{i}')" for i in range(300))]
    got = patterns.parse_clauses(spark.createDataFrame(list(enumerate(texts)), "k int, clause string")).orderBy("k").collect()
    for t, r in zip(texts, got):
        want = patterns.parse_clause(t)
        assert (None if r.parsed is None else (r.parsed.head, [(a.name, list(a.args)) for a in r.parsed.atoms])) == want, t


def test_protocol_and_growth_quads_are_sets(spark):
    """Repeated and contradicting experiments, and studies whose names end like experiments; quads of experiments that stand once are not exchanged."""
    rows = [("a", "t", 1, "x"), ("a", "t", 1, "x"), ("a", "t", 1, "y"), ("a", "u", 2, None), ("a-1", "t", 2, "x"), ("a-", None, 1, "x"), ("a", None, -1, "x"), (None, "t", 1, "x"), ("b", "t", None, "x")]
    e = spark.createDataFrame(rows, "study string, hypothesis_text string, experiment int, summary string")
    e = e.select("*", F.lit("k").alias("type"), F.lit("m").alias("media_description"), F.lit("b").alias("baseline_media"), *(F.col("summary").alias(f"{s}_{c}") for s in ("sup", "treat") for c in ("chemical", "value", "unit")))
    got = [tuple(r) for r in graph.protocol_quads(e).collect()]
    assert len(got) == len(set(got)) and ("experiments", "EXP-a-1", "rdfs:label", "k: y") in got and ("experiments", "STUDY-b", "rdf:type", "obo:OBI_0500000") in got
    assert sum(q[2] == "obo:BFO_0000051" and q[1].startswith("STUDY") for q in got) == 5 and sum(q[3] == "obo:NCBITaxon_4932" for q in got) == 1
    t = e.select("study", F.col("experiment").alias("i"), F.col("experiment").alias("assay"), F.lit("1").alias("estimate"), F.lit("2").alias("p"), F.col("summary").alias("treatment"), F.lit(None).cast("string").alias("supplement"), F.col("summary").alias("link"))
    made = graph.growth_test_quads(t)
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) and sum(q[3] == ":AUCForestComparativeTest" for q in got) == 5 and ("growth-data", "GROWTH-a-auc-forest-1-test-condition", "rdfs:label", "y") in got
    assert "Union" in made._jdf.queryExecution().sparkPlan().toString() and graph.protocol_quads(e.limit(0)).count() == graph.growth_test_quads(t.limit(0)).count() == 0


def test_hypothesis_quads_are_sets(spark):
    """Shared and repeated parts, a hypothesis named as a graph, a separator in a text: always the set that the templates make."""
    for names, chemical in ((("h1", "h2", "h2"), "x"), (("states", "h2", "h2"), "x"), (("h1", "h2", "h2"), "x\x1fy")):
        hyps = spark.createDataFrame([(h, "now", None if k else "lab") for k, h in enumerate(names)], "hypothesis string, created string, creator string")
        rows = [(h, side, "c", "r" if side == 1 else None, chemical if side == 1 else None, "more") for h in names for side in (1, 2)]
        parts = graph.phenotype_parts(spark.createDataFrame(rows, "hypothesis string, side int, class string, role string, chemical string, relation string"))
        made = graph.hypothesis_quads(hyps, parts)
        got = [tuple(r) for r in made.collect()]
        assert len(got) == len(set(got)) and sum(q[0] == graph.METADATA for q in got) == 4
        assert sum(q[0] == "h2" for q in got) == 4 and sum(q[2] == "rdfs:subClassOf" and q[3] == "c" for q in got) == 4
        assert ("Union" == made._jdf.queryExecution().optimizedPlan().nodeName()) == (names[0] == "h1" and chemical == "x")


def test_restrictions_of_a_set_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, f string")
    made = graph.restrictions(rows, F.lit("g"), F.col("s"), F.lit("role"), F.col("f"))
    view = graph.restriction_view(graph.merged(made, made))
    assert "Broadcast" not in view._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, view.collect())) == [("g", "a", "role", "x"), ("g", "b", "role", "y")]


def test_hypotheses_store_only_quads_they_read(spark, monkeypatch):
    """Quads that no pattern can match are not written, the others once; a store that holds all gives the same rows."""
    quads = staging.staged(studies.whole_store(spark, "/root/testdata/sf0.001"))
    other = F.col("g").isin("experiments", "growth-data", graph.METADATA)
    quads = quads.union(quads.where(other).select(F.lit("elsewhere"), "s", "p", "o")).union(quads.select("g", "s", F.concat("p", F.lit("-not")), "o")).toDF("g", "s", "p", "o")
    want, sizes = sorted(graph.hypotheses_with_tests(graph.stored(quads, 2)).collect(), key=str), []
    monkeypatch.setattr(store, "written", lambda df, *a, to=store.written: (sizes.append((df.columns, (out := to(df, *a)).count())), out)[1])
    assert sorted(graph.hypotheses_with_tests(quads).collect(), key=str) == want and any(r.coef_aa for r in want)
    stored = [n for columns, n in sizes if columns == ["g", "s", "p", "o"]]
    assert len(stored) == 1 and stored[0] < quads.count() / 2
