import random

import xxhash
from pyspark.sql import functions as F

from assaygrid.llm import simhash


def brute_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}É" for i in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 1, 3])):
            other = list(words)
            other[rng.randrange(len(words))] = "X"
            rows.append((len(rows), "\t ".join(other).upper() if rng.random() < 0.3 else " ".join(other)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n "), (len(rows) + 3, "one two"), (len(rows) + 4, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    for dense in (simhash.DENSE, 1):
        got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df, dense=dense).collect()}
        prints = {i: brute_print(t) for i, t in rows}
        assert {i: p for i, (p, _) in got.items()} == prints
        assert {i: c for i, (_, c) in got.items()} == brute_components(prints)


def test_dense_bucket_chain(spark):
    chain = [0]
    for b in range(60):
        chain.append(chain[-1] ^ (1 << b))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in chain], "fp long")
    for dense in (2, 1000):
        roots = simhash.components(simhash.links(df, dense))
        assert {r.root for r in roots.collect()} == {0} and roots.count() == len(chain)


def test_keys_are_not_broadcast_by_the_size_of_their_fingerprints(spark, monkeypatch):
    seen, rng = [], random.Random(5)
    monkeypatch.setattr(simhash, "cut", lambda df, cut=simhash.cut: (seen.append(df), cut(df))[1])
    df = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)] + [(0,), (3,)], "fp long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # over 2,002 fingerprints, under their 128,128 keys
    try:
        assert (0, 3) in {(r.a, r.b) for r in simhash.links(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p.split("== Initial Plan ==")[0] for p in plans)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e"), (None, "zz yy xx ww"), (3, None)], "doc_id long, text string")
    assert sorted(r.component_id or -1 for r in simhash.near_duplicates(df).collect()) == [-1, 3, 7, 7, 7]
    clashing = df.withColumn("__gone", F.lit(7)).withColumn("id", F.lit(7)).withColumn("row", F.lit(7)).withColumn("component_id", F.lit(7))
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 7]
