import random

import numpy as np
from pyspark.sql import functions as F

from assaygrid.llm import language as lg


def plain_bits(text, grams):
    """The same code length by the definition, one byte at a time."""
    counts = {}
    for g, n in grams.items():
        for k in range(4):
            counts.setdefault(g[3 - k : 3], {}).setdefault(g[3:], 0)
            counts[g[3 - k : 3]][g[3:]] += n
    data, bits = b"   " + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            after = counts.get(data[i - k : i])
            if after is None:
                continue
            t, q = sum(after.values()), len(after)
            if data[i : i + 1] in after:
                bits += np.log2((t + q) / after[data[i : i + 1]])
                break
            bits += np.log2((t + q) / q)
        else:
            bits += 8
    return bits


def test_code_length():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé ") for _ in range(80)) for _ in range(5)]
    grams, n = np.unique(lg.codes(texts)[0], return_counts=True)
    tree = {"x": lg.Tree(grams, n)}
    by = {int(g).to_bytes(4, "big"): int(c) for g, c in zip(grams, n)}
    for t in [*texts, "zzz abé", "", "Q"]:
        assert abs(lg.charge([t, "ab"], tree)[0, 0] - plain_bits(t, by)) < 1e-6


def test_held_out(spark):
    rng = random.Random(3)
    parts = {"en": ["th", "ing", "er", "on"], "fr": ["eau", "é", "ou", "tion"], "de": ["sch", "ü", "ung", "ein"]}
    rows = [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(3)) for _ in range(rng.choice([3, 50]))), g) for i in range(300) for g in [rng.choice(list(parts))]]
    rows += [(900, None, "en"), (901, "123 --", "en"), (902, "", None), (None, "thinger", "en"), (903, "schung " * 40_000, None)]
    rows += [(910 + k, t, "en") for k, t in enumerate(["² ½ ³", "①", "Ⅷ", "\u0301", "12 ४५"])] + [(920, "ª", None), (921, "ж", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    for bound in (1200, 40):
        trees = spark.sparkContext.broadcast(lg.learn(docs.where("doc_id % 3 != 0"), bound))
        got = {r.doc_id: r.p for r in docs.select("doc_id", lg.identify(F.col("text"), trees).alias("p")).collect()}
        assert [got[k].lang for k in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
        assert {got[k] for k in range(910, 915)} == {("und", 0.0)} and "und" not in (got[920].lang, got[921].lang)
        assert sum(got[i].lang == g for i, _, g in rows[:300] if i % 3 == 0) >= 98
    assert lg.learn(docs.where("false")) == {}
