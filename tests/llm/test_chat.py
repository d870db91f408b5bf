import random

from pyspark.sql import functions as F

from assaygrid.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None and t is not None:
            convs.setdefault(c, []).append((t, r, x))
    key = lambda e: (e[0], e[1] is not None, e[1] or "", e[2] is not None, e[2] or "")
    convs = {c: sorted(v, key=key) for c, v in convs.items()}
    gone = set()
    for a, u in convs.items():
        for b, v in convs.items():
            if a != b and (u == v and b < a or v[-1][0] > u[-1][0] and [e for e in v if e[0] <= u[-1][0]] == u):
                gone.add(a)
    return {c: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for _, r, x in v) for c, v in convs.items() if c not in gone}


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.part)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.rendered
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    base = [[(t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "b"])) for t in range(6)] for _ in range(6)]
    rows = [(c, *e) for c in range(60) for e in rng.choice(base)[: rng.randrange(1, 7)]]
    rows += [(100, 0, None, ""), (101, 0, None, None), (102, 0, None, None), (102, 1, "user", None), (None, 0, "x", "y"), (103, None, "x", "y"), (104, 3, "user", "q"), (104, 3, "bot", "q"), (104, 3, "bot", "q"), (105, 5, "bot", "t" * 100_000)]
    rows += [(200, t, "user", str(t)) for t in range(700)] + [(201, t, "user", str(t)) for t in range(600)] + [(202, t, "user", str(t + (t == 590))) for t in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(9)).withColumn("block", F.lit(1))
    assert joined(chat.format_chats(df)) == brute(rows)
    assert chat.format_chats(df.where("false")).count() == 0
