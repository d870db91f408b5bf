import hashlib
import random
import re

from pyspark.sql import functions as F

from assaygrid.llm import line_dedup as ld


def brute(rows):
    lines = set()
    for d, t in rows:
        rk = hashlib.md5((t or "").encode()).hexdigest()[:15]
        for k, line in enumerate(t.split("\n") if t is not None and d is not None else []):
            w = [x for x in re.split("[ \t-\r]+", line.lower()) if x]
            tokens = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            lines.add((d, rk, k, tokens))
    gone = {(d, r, k) for d, r, k, s in lines for e, q, j, o in lines if s and (e, q, j) < (d, r, k) and len(s & o) / len(s | o) >= 0.8}
    kept = lambda d, t: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, hashlib.md5(t.encode()).hexdigest()[:15], k) not in gone)
    return sorted(((d, kept(d, t) if t is not None else None) for d, t in rows), key=str)


def corpus(n=70, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    pool = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 20, 60]))] for _ in range(12)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.choice([1, 3, 6])):
            line = list(rng.choice(pool)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(40)]
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(vocab)
            lines.append((" " if rng.random() < 0.2 else "") + "  ".join(line).upper())
        rows.append((d, "\n".join(lines)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("cid", F.lit(1))
    got = ld.dedup(df)
    assert got.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus() + [(500, None), (501, ""), (502, "\n\n"), (None, corpus()[0][1]), (503, " ".join(["long"] * 3000)), (504, "a b c d e\na b c d e")]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(ld, "FEW", 2)  # families of near copies, common tokens
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)
    assert run(spark, rows) == brute(rows)


def test_repeated_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f\nx")]
    assert run(spark, rows) == [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x")]
    assert run(spark, rows[:0]) == []


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(0, "p q r s t u v"), (1, "p q r s t u v\nother words here"), (1, "totally different first line of this row\nkeep")]
    assert run(spark, rows) == [(0, "p q r s t u v"), (1, "other words here"), (1, "totally different first line of this row\nkeep")] == brute(rows)


def test_short_lines_match_as_a_whole(spark):
    rows = [(1, "Accept all cookies\n\n  "), (2, "one\nACCEPT  all cookies\n\n"), (3, "one two\naccept all"), (4, "one two three four five")]
    assert run(spark, rows) == [(1, "Accept all cookies\n\n  "), (2, "one\n\n"), (3, "one two\naccept all"), (4, "one two three four five")] == brute(rows)
