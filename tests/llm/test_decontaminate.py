import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaygrid.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for i, bt in items:
            b = words(bt)
            for p in [b[k : k + 10] for k in range(max(1, len(b) - 9))] if b else []:
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= set(range(k, k + len(p)))
                        got.add(i)
        out[d] = (len(w), len(hit), sorted(str(i) for i in got if i is not None), None in got)
    return out


def test_fm_index():
    rng = np.random.default_rng(2)
    for n, sigma in ((1, 1), (50, 2), (400, 3), (700, 90)):
        text = rng.integers(0, sigma, n)
        index = dc.FmIndex(text, 2 * sigma + 3, 4)
        for m in (1, 2, 5):
            patterns = np.array([[2 * sigma + 3] * m] + [text[k : k + m] for k in rng.integers(0, max(1, n - m + 1), 20)] + [rng.integers(0, sigma, m) for _ in range(9)]) if n >= m else np.zeros((0, m), int)
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [k for k in range(n - m + 1) if (text[k : k + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def sample():
    rng = random.Random(5)
    vocab = ["a", "B", "c", "Dé", "e9"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([10, 12, 30]))) for k in range(8)] + [(20, "a b c d e"), (21, ""), (22, None), (23, items_dup := say(11)), (24, items_dup), (None, say(4))]
    docs = [(k, say(rng.choice([0, 3, 9, 60, 300]))) for k in range(30)] + [(100, None), (101, "..."), (102, items_dup + "!" + items_dup), (103, "x, " + items_dup.upper() + " y")]
    docs += [(104, docs[3][1]), (105, "A-b_c\nd  E")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = sample()
    want = brute(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1000, 20):
        blocks = dc.blocks_of(bench, block=block)
        got = {r.doc_id: (r.c.n_words, sum(s.end - s.start for s in r.c.spans), r.c["items"], r.c.unnamed) for r in df.select("doc_id", dc.contamination("text", blocks).alias("c")).collect()}
        assert got == want
        cleaned = df.select("doc_id", dc.clean("text", blocks).alias("text")).collect()
        assert all(x[1] == 0 for x in brute([(r.doc_id, r.text) for r in cleaned], items).values())
        kept = {r.doc_id: r.text for r in cleaned}
        assert all(kept[d] == t for d, t in docs if want[d][1] == 0)
    assert df.where("false").select(dc.contamination("text", blocks)).count() == 0
    assert dc.blocks_of(bench.where("false")) == []


def test_cut_shards():
    docs, items = sample()
    by = {}
    for i, t in items:
        b = [w.encode() for w in words(t)]
        for p in [b[k : k + 10] for k in range(max(1, len(b) - 9))] if b else []:
            by.setdefault(tuple(p), []).append(None if i is None else str(i))
    held = type("B", (), {"value": dc.Packed(dc.Block(by))})
    for blocks in ([held], [held, held]):
        got = dc.search_texts([t for _, t in docs], blocks, shard=17)
        assert [(n, sum(b - a for a, b in s), i, u) for n, s, i, u in got] == [brute(docs, items)[d] for d, _ in docs]


def test_whole_shards_are_indexed(monkeypatch):
    seen, of = [], dc.FmIndex
    monkeypatch.setattr(dc, "FmIndex", lambda text, top: seen.append(len(text)) or of(text, top))
    dc.search_shard([[b"x", b"y"], [], [b"z"] * 5], dc.Block({(b"x",): ["1"]}))
    assert seen == [2 + 0 + 5 + 3]  # all words, and an end for each document


def test_too_large_a_benchmark_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST", 2)
    with pytest.raises(ValueError):
        dc.blocks_of(spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e")], "item_id long, text string"))


def test_batches_are_taken_apart_in_slices(monkeypatch):
    docs, items = sample()
    monkeypatch.setattr(dc, "SLICE", 64)
    texts = pa.array([t for _, t in docs], pa.string())
    assert [t for some in dc.sliced(texts) for t in some] == [t for _, t in docs]
    assert max(map(len, dc.sliced(texts))) <= max(1, 64 * len(docs) // texts.nbytes) < len(docs)
    by = {tuple(w.encode() for w in words(t))[:10]: [str(i)] for i, t in items if words(t)}
    held = type("B", (), {"value": dc.Packed(dc.Block(by))})
    before = [t for _, t in docs]
    after = dc.cleaned(before, [held])
    assert before == [t for _, t in docs] and any(a is not b for a, b in zip(after, before)) and any(a is b and a for a, b in zip(after, before))
