import random
import re

from assaygrid.llm import queries, secrets as sc

BASE = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)]
EXTRA = [(r.kind, r.regex, lambda m: True) for r in sc.RULES if not r.base]


def brute(text, rules):
    found = [(m.start(), k, kind, m.end()) for k, (kind, rx, ok) in enumerate(rules) for m in re.finditer(rx, text or "", re.A) if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_queries_are_mandatory():
    assert sc.trigram_query("[0-9a-f]{32,}") == frozenset()
    assert {"apikey", "api_key"} <= {s for s in sc._spellings(sc.parser.parse("(?i:api_?key)"))[0]}
    for r in sc.RULES:
        assert (r.kind == "hex") == (not sc.trigram_query(r.regex))


def texts():
    rng = random.Random(2)
    bits = ["token", "TOKEN=token:abcdefgh", "api_key = 'AbCdEf12345'", "apikey:", "passwd=short", "Secret\" : \"" + "x" * 9, "AKIA" + "A1" * 6, "AKIAAKIA", "AKIA" + "Z" * 11,
            "0" * 31, "deadbeef" * 4, "deadbeef" * 9, "é😀", "ghp_" + "a" * 36, "xoxb-1234567890-ab", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "tok en", "=", " ", "\n", "PASSWORD=" + "/" * 8, "secretsecret=secretsecret"]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 30]))) for _ in range(200)] + [None, "", "x" * 100_000 + "token=abcdefgh1"]


def test_against_re(spark):
    rows = [(k % 190 if k % 17 else None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sc.scan(df).select("doc_id", "text", sc.as_text(sc.F.col("spans")).alias("s")).collect()
    assert sorted(((r.doc_id, r.text, r.s) for r in got), key=str) == sorted(((d, t, brute(t, BASE + EXTRA)) for d, t in rows), key=str)
    digests = queries.secret_digests(df).collect()
    base = sorted(__import__("hashlib").sha256(brute(t, BASE).encode()).hexdigest() for _, t in rows)
    assert sorted(r.base_sha256 for r in digests) == base
    assert sum(r.n_hex for r in digests) == sum(brute(t, BASE[2:]).count("hex") for _, t in rows)
    assert sc.scan(df.where("false")).count() == 0
