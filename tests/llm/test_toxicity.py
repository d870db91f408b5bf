import random

import numpy as np
from pyspark.sql import functions as F

from assaygrid.llm import toxicity as tx


def corpus(n=600):
    rng = random.Random(4)
    vocab = ["".join(rng.choice(["an", "er", "th", "ou", "st", "le", "mi"]) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words, bad = [rng.choice(vocab) for _ in range(rng.choice([5, 80, 300]))], i % 5 == 0
        if bad:
            for _ in range(rng.choice([2, 5])):
                words.insert(rng.randrange(len(words)), rng.choice(["Blagger", "zorrix"]) if i % 2 else "krumpel" + rng.choice(vocab))
                words.append("krumpelan" if i % 2 == 0 else "zorrix")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit(0))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = tx.fit(docs, lab.where("doc_id < 300"))
    assert {"w:zorrix"} <= set(chain.terms)
    got = {r.doc_id: r.s for r in docs.select("doc_id", tx.score(F.col("text"), chain).alias("s")).collect()}
    wrong = sum((got[i].toxic >= 0.5) != bool(y) for i, y in labels if i >= 300)
    assert wrong <= 6
    kept = tx.keep_clean(docs, lab)
    assert kept.columns == docs.columns and abs(kept.count() - 480) < 12


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "zorrix " * 50_000), (2, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert tx.keep_clean(docs, lab).count() == 4
    assert tx.keep_clean(docs.where("false"), lab.where("false")).count() == 0
    rows, labels = corpus(200)
    chain = tx.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + labels, "doc_id long, toxic int"))
    got = [r.s.toxic for r in docs.select(tx.score(F.col("text"), chain).alias("s")).collect()]
    assert got[0] < 0.5 and got[1] == got[0] and got[2] > 0.5


def plain_logistic(x, y, v, ridge=1.0):
    """Gradient of the penalised likelihood vanishes at the solution."""
    w, b = tx.logistic(x, y, ridge, weight=v)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (v * (p - y)) + ridge * w).max() < 1e-4 and abs((v * (p - y)).sum()) < 1e-3
    return w, b


def test_chain_against_plain_computation(spark):
    rows, labels = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    # terms: by how many toxic and other documents hold a term, once or often
    texts, y = [t for _, t in rows], np.array([t for _, t in labels], float)
    counts = [tx.term_counts(t)[1] for t in texts]
    pos, neg = int(y.sum()), int((1 - y).sum())

    def gain(a, b):
        part = lambda k, n: k * np.log((k + 1e-9) / n)
        return 2 * (part(a, pos) + part(b, neg) + part(pos - a, pos) + part(neg - b, neg) - part(a + b, pos + neg) - part(pos + neg - a - b, pos + neg)) if a * neg > b * pos else 0.0

    score = {}
    for term in {t for c in counts for t in c}:
        held = [(sum(c[term] >= k for c, l in zip(counts, y) if l), sum(c[term] >= k for c, l in zip(counts, y) if not l)) for k in (1, tx.OFTEN)]
        if held[0][0] and max(gain(*h) for h in held) > 0:
            score[term] = max(gain(*h) for h in held)
    assert list(chain.terms) == sorted(score, key=lambda t: (-round(score[t], 9), t))[: tx.TERMS]
    # links: each is the penalised optimum on terms and out-of-fold predictions of the links before
    x = np.array([tx.vector(t, chain.terms, chain.whole, chain.stems) for t in texts])
    n = np.expm1(x[:, : len(chain.terms)])
    word = np.array([t[0] == "w" for t in chain.terms])
    fold = np.array([r.h % tx.FOLDS for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("doc_id").collect()])
    for target, (w, b) in zip((y * (n[:, word] > 0.5).any(1), y * (n[:, ~word] > tx.OFTEN - 0.5).any(1), y), chain.links):
        want, c = plain_logistic(x, target, np.ones(len(x)))
        assert np.allclose(w, want, atol=1e-4) and abs(b - c) < 1e-3
        held = np.zeros(len(x))
        for f in set(fold):
            v, c = plain_logistic(x[fold != f], target[fold != f], np.ones((fold != f).sum()))
            held[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ v + c)))
        x = np.column_stack((x, held))
    got = docs.select("doc_id", tx.score(F.col("text"), chain).alias("s")).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        v = tx.vector(t, chain.terms, chain.whole, chain.stems)
        for name, (w, b) in zip(tx.CATEGORIES, chain.links):
            p = 1 / (1 + np.exp(-(v @ w + b)))
            assert abs(r.s[name] - p) < 1e-9
            v = np.append(v, p)


def test_odd_labels_and_repeated_documents(spark):
    rows, labels = corpus(100)
    docs = spark.createDataFrame(rows + [(0, "zz")] * 50, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(3, 7), (4, -1)], "doc_id long, toxic int")
    sample = tx.sample_of(docs, lab, "toxic", 60, "doc_id", "text").collect()
    assert len(sample) == 60 and {r.y for r in sample} == {0, 1}
    assert tx.fit(docs, lab).links


def test_few_toxic_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {i for i, y in labels if y}
    few = sorted(few)[:8]
    lab = spark.createDataFrame([(i, y) for i, y in labels if i < 90 and (not y or i in few)], "doc_id long, toxic int")
    chain = tx.fit(docs, lab)
    assert {"w:zorrix"} <= set(chain.terms)
    got = {r.doc_id: r.s.toxic for r in docs.where("doc_id >= 90").select("doc_id", tx.score(F.col("text"), chain).alias("s")).collect()}
    assert sum(p >= 0.5 for i, p in got.items() if i % 5 == 0) >= 50  # of 102
    assert sum(p >= 0.5 for i, p in got.items() if i % 5) <= 4


def test_sample_is_filled_by_class(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(1000)], "doc_id long, text string")
    of = lambda toxic, bound: {r.y: (r.n, r.all) for r in tx.sample_of(docs, docs.select("doc_id", (F.col("doc_id") < toxic).cast("int").alias("toxic")), "toxic", bound, "doc_id", "text").groupBy("y").agg(F.count("*").alias("n"), F.max("all").alias("all")).collect()}
    assert of(20, 100) == {0: (80, 980), 1: (20, 20)}
    assert of(300, 100) == {0: (50, 700), 1: (50, 300)}
    assert of(970, 100) == {0: (30, 30), 1: (70, 970)}
    assert of(300, 5000) == {0: (700, 700), 1: (300, 300)}
