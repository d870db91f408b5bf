import random

import corpus_pipeline
from pyspark.sql import functions as F

from assaygrid.llm import near_copies as nc


def brute(rows):
    sets, root = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}É" for i in range(500)]
    rows = []
    for _ in range(50):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 30, 60, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 1, 4])):
            other = list(words)
            for _ in range(rng.choice([0, 1, max(1, len(words) // 45), len(words) // 30])):
                other[rng.randrange(len(words))] = "X"
            rows.append((len(rows), "\t\n".join(other).upper()))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One  two"), (905, rows[0][1])]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash")).withColumn("first", F.lit(0)).withColumn("__gone", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(3))
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in nc.near_duplicates(df).collect()} == want
    kept = nc.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c}
    monkeypatch.setattr(nc, "BROADCAST", 0)
    whole = nc.class_of
    monkeypatch.setattr(nc, "class_of", lambda tokens: (whole(tokens)[0] % 3, whole(tokens)[1]))  # different sets share half a hash
    assert {r.component_id for r in nc.near_duplicates(df).collect()} == set(want.values())
    monkeypatch.setattr(nc, "BUCKETS", 16)
    monkeypatch.setattr(nc, "FULL", 0.5)
    assert {r.doc_id: r.component_id for r in nc.near_duplicates(df).collect()} == want


def test_stage_drops_copies_beyond_two_bits(spark):
    words = [f"w{i}" for i in range(300)]
    other = [w if i not in (60, 150, 240) else "x" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (None, " ".join(words)), (None, None)], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.without_near_copies(spark, df, "").collect()) == [-1, -1, 1]
    assert corpus_pipeline.without_near_copies(spark, df.where("false"), "").count() == 0


def test_simhash_brings_candidates_that_whole_sets_decide(spark, monkeypatch):
    words, fp = [f"w{i}" for i in range(400)], lambda w: nc.print_of(nc.tokens_of(" ".join(w)))
    by_bits = {}
    for other in ([*words[:-1], f"x{k}"] for k in range(200)):  # one shingle of 396 differs
        by_bits.setdefault(bin((fp(words) ^ fp(other)) & (1 << 64) - 1).count("1"), other)
    rows = [(1, words), (2, by_bits[0]), (3, by_bits.get(1) or by_bits[2]), (4, [f"v{i}" for i in range(400)])]
    seen, matching = [], nc._matching
    monkeypatch.setattr(nc, "_matching", lambda near, *more: seen.append((near.count(), matching(near, *more))) or seen[-1][1])
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nc.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [(n, m.count()) for n, m in seen] == [(2, 2), (0, 0), (0, 0)]  # SimHash settles them, nothing is left for the exact way


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**9)}"
    passage, rows = [word() for _ in range(60)], []
    for d in range(60):
        rows.append((d, " ".join([*passage, *(word() for _ in range(60))])))
    rows.append((60, rows[7][1] + " end"))
    seen, matching = [], nc._matching
    monkeypatch.setattr(nc, "_matching", lambda near, *more: seen.append(near.count()) or matching(near, *more))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nc.near_duplicates(df).collect()} == brute(rows)
    assert sum(seen) < 60  # 1,770 pairs share the passage
