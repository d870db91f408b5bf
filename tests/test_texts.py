import random

from pyspark.sql import functions as F

from assaygrid.functions.scalars import any_column_contains
from assaygrid.operators import dosing, patterns
from assaygrid.operators.texts import contained


def both(spark, needles, lines):
    got = contained(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    rows = [tuple(r) for r in got]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_contained_against_a_plain_loop(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab\nü😀.") for _ in range(n))
    lines = [word(rng.randrange(60)) for _ in range(80)] + [None, "", "aaaa" * 20, "aaaa" * 20]
    needles = [word(rng.randrange(1, 8)) for _ in range(60)] + [x[3:3 + n] for x in lines if x for n in (9, 17, 40)] + [None, "", "zz", "a" * 81]
    want = {(n, x) for n in needles if n for x in lines if x and n in x}
    assert both(spark, needles, lines) == want and len(want) > 300
    assert both(spark, [], lines) == set() == both(spark, ["a"], []) and both(spark, [None, ""], lines) == set()


def test_not_listed(spark):
    c = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a"), ("t2", "a"), (None, "a"), ("t3", None)], "target string, clause string")
    listed = spark.createDataFrame([("xt1:ab",), (None,), ("t2:",)], "line string")
    assert sorted(map(str, patterns.not_listed(c, listed).collect())) == sorted(map(str, c.where("not (target <=> 't1' and clause <=> 'a')").collect()))
    assert patterns.not_listed(c, listed.limit(0)).count() == 6


def test_library_rows_by_any_column(spark):
    library = spark.createDataFrame([("Glucose x", 12, None), ("Glucose x", 12, None), ("b", 3, "GLUC")], "name string, `n 1` int, needle string")
    keys = spark.createDataFrame([("gluc",), ("GLUC",), ("12",), ("gluc",), (None,), ("",), ("none",)], "key string")
    got = sorted(map(str, dosing.library_matches(keys, library).select("key", "name").collect()))
    want = [(k, n) for k, n in (("gluc", "Glucose x"), ("GLUC", "Glucose x"), ("12", "Glucose x")) for _ in range(2)] + [("gluc", "b"), ("GLUC", "b")]
    assert got == sorted(f"Row(key={k!r}, name={n!r})" for k, n in want)


def test_any_column_contains(spark):
    got = spark.createDataFrame([("Ab", None, "b"), ("x", 12, "AB"), (None, 1, "ab"), ("x", None, "ab")], "a string, n int, k string")
    assert [r.held for r in got.select(any_column_contains([F.col("a"), F.col("n")], F.col("k")).alias("held")).collect()] == [True, False, False, False]


def test_contained_has_no_nested_loop(spark):
    needles, lines = spark.range(50).select(F.col("id").cast("string").alias("needle")), spark.range(5000).select(F.col("id").cast("string").alias("line"))
    plan = contained(needles, lines)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
