import random
import struct
import tracemalloc

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaygrid.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
library = Tokenizer.from_file(PATH)


def ids(text):
    data = bpe.load(PATH).encode(text)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def same(text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    for step in (1, 3, 1000):
        machine = bpe.Decoder(bpe.load(PATH))
        got = "".join(machine.feed(want[a : a + step]) for a in range(0, len(want), step)) + machine.close()
        assert got == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "   ", "Hello, World's don't 12345", "É ö ß ẞ İstanbul ΑΣ ς é ́x", "a\x1cb\x1fc\x85d　e",
                                  "<|endoftext|> x<|startoftext|>y<|endoftex", "日本語 текст 👩‍👩‍👧 ퟿￿", "x" * 5000, "ab" * 3000 + "'re", "-" * 4001, "'s'T'LLx'd"])
def test_same_as_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text)


def test_long_words_stream():
    rng, machine = random.Random(1), bpe.load(PATH)
    assert machine.lookahead < 2000
    for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "!?-=", "éèà"):
        same("".join(rng.choice(letters) for _ in range(6 * machine.lookahead + 300)))


def test_columns(spark):
    rows = [(1, "Hello wörld"), (1, None), (None, ""), (2, "x " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.encode("text", PATH))
    got = df.withColumn("back", bpe.decode("ids", PATH)).withColumn("plain", bpe.decode("ids", PATH, "text")).collect()
    assert [r.back for r in got] == [library.decode(library.encode(t or "").ids, skip_special_tokens=False) for _, t in rows]
    assert got[0].plain == "hello wörld " and got[1].plain == ""
    assert df.where("false").withColumn("back", bpe.decode("ids", PATH)).count() == 0


def test_digests_are_those_of_the_columns(spark):
    rows = [(1, "Hello wörld <|endoftext|> x"), (1, None), (None, ""), (2, "x 日本語 " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids, back = F.col("ids"), F.col("back").cast("binary")
    want = df.select("doc_id", bpe.encode("text", PATH).alias("ids")).withColumn("back", bpe.decode("ids", PATH))
    want = want.select("doc_id", (F.octet_length(ids) / 4).cast("long"), F.sha2(ids, 256), F.sha2(back, 256))
    got = queries.bpe_digests(df)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "of(of(" not in got._jdf.queryExecution().executedPlan().toString()  # each text goes to Python once, only digests come back
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert queries.bpe_digests(df.where("false")).count() == 0


def test_digests_hold_one_text_at_a_time():
    machine = bpe.load(PATH)
    bpe.digest(machine, "a b", "tokens", 1 << 16)
    tracemalloc.start()
    try:
        for _ in range(40):
            bpe.digest(machine, "ab cd " * 10000, "tokens", 1 << 10)
        assert tracemalloc.get_traced_memory()[1] < 4_000_000
    finally:
        tracemalloc.stop()
