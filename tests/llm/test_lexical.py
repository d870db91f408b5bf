import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from assaygrid.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k):
    docs = [(d, Counter(words(t))) for d, t in docs]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c, n in docs:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda f: f[:2] + (f[2] or 0,))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(80)] + ["Ñandú", "ñandú", "42", "中文"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocab[: rng.choice([8, 84])]).upper() if rng.random() < 0.3 else rng.choice(vocab) for _ in range(n))
    docs = [(k, text(rng.choice([1, 3, 20, 60, 400]))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(None, docs[7][1]), (None, "w1 w2"), (17, docs[8][1]), (400, None), (401, ""), (402, "!!"), (403, "w3 " * 30_000)]
    items = [(k, text(rng.choice([1, 5, 25]))) for k in range(20)] + [(30, docs[5][1]), (31, None), (32, "?"), (33, "nowhere"), (1, "w1 w2 w3"), (None, "w4 w5"), (2, "w9"), (2, "w9")]
    return docs, items


def run(spark, docs, items, k, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("score", F.lit(0)).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    found = lexical.search(d, i, k, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    assert run(spark, docs, items, 50) == brute(docs, items, 50)
    assert run(spark, docs, items, 3, block=60) == brute(docs, items, 3)  # several blocks
    monkeypatch.setattr(lexical, "BATCH", 2)
    monkeypatch.setattr(lexical, "CELLS", 1)  # trees of 64 documents
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = corpus()
    assert run(spark, docs[:0], items, 50) == run(spark, docs[:9], items[:0], 50) == run(spark, [(1, None)], items, 50) == []


def test_bounds_hold_and_leaves_are_exact():
    rng = random.Random(1)
    docs = []
    for k in range(200):
        terms = sorted(rng.sample(range(30), rng.randrange(1, 12)))
        docs.append((lexical.np.array(terms), lexical.np.array([rng.randrange(1, 9) for _ in terms]), rng.randrange(50, 200), k))
    tree, weights = lexical.Tree(docs, 30), lexical.np.arange(1, 31)
    bound = tree.bounds(lexical.np.arange(len(tree.m)), lexical.np.arange(30), weights)
    for node in range(len(tree.m)):
        for child in range(tree.at[node], tree.at[node] + tree.many[node]):
            assert bound[child] <= bound[node] and tree.m[child] >= tree.m[node]
    exact = {i: sum(int(w) * (10**9 * int(f) // (1000 * int(f) + 20 * m)) for w, f in zip(weights[t], tf)) for t, tf, m, i in docs}
    assert {i: int(bound[n]) for n, ids in tree.ids.items() for i in ids.tolist()} == exact
    none = lexical.np.zeros(0, lexical.np.int64), lexical.np.zeros(0, lexical.np.int64)
    scores, ids = tree.search(lexical.np.arange(30), weights, none, 10)
    assert list(zip((-scores).tolist(), ids.tolist())) == sorted((-s, i) for i, s in exact.items())[:10]
