import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaygrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(PATH)
library.no_truncation()
library.no_padding()


def best_fit(lengths, size):
    """Sequences of plain best fit by falling length."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in left if s >= n]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else size) - n)
    return len(left)


def texts():
    rng = random.Random(4)
    words = ["alpha", "Beta,", "ñandú", "straße\n", "x", "12345", "<|endoftext|>", "  ", "\t\n", "中文", "Ⅷ", "\U0001f600", "𞤀", "it's"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 200, 900, 1500]))) for _ in range(120)]
    return out + ["", None, "same text here"] + ["same text here"] * 40 + ["a" * 5000, " " * 3000]


def checked(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(5)
    placed = packing.pack(df, PATH, size=size, with_ids=True)
    got = placed.collect()
    want = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % size or size
        at = [0, *range(first, len(ids), size)]
        for k, (a, z) in enumerate(zip(at, [*at[1:], len(ids)])):
            packed = np.array(ids[a:z], "<u4").tobytes()
            want[d, k, a, z - a, zlib.crc32(packed), packed] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= size
    assert len(by) == best_fit([r.length for r in got], size)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for s, own in by.items():
        assert bytes(whole[s].ids) == b"".join(bytes(r.ids) for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset)) and whole[s].length == sum(n for _, n in own)


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    checked(spark, rows, 1024)
    checked(spark, rows + [(None, "no id"), (None, "no id"), (3, "again")], 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_plan_equals_plain_best_fit():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.choice([1, 7, 16, 100])
        counts = {n: rng.choice([0, 1, 2, 5, 40]) for n in range(1, size + 1)}
        slots = packing.plan(counts, size)
        placed, lengths = {}, [n for n, c in counts.items() for _ in range(c)]
        ranks = {n: [] for n in counts}
        for n, first, last, sequence, offset, each in slots:
            for r in range(first, last):
                ranks[n].append(r)
                placed.setdefault(sequence + (r - first) // each, []).append((offset + (r - first) % each * n, n))
        assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
        assert len(placed) == best_fit(lengths, size)
        for own in placed.values():
            own.sort()
            assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= size


def test_plan_of_many_pieces_takes_few_steps():
    counts = {n: 10**9 + n for n in range(1, 1025)}
    slots = packing.plan(counts)
    assert len(slots) < 20_000 and sum(z - a for _, a, z, *_ in slots) == sum(counts.values())


def test_encoder_equals_library():
    rng = random.Random(2)
    letters = [chr(c) for c in (*range(0x250), 0x2003, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0x378, 0xA7CB)]
    encoder = packing.Encoder(PATH)
    assert encoder.fast is not None
    for _ in range(3000):
        t = "".join(rng.choice(letters if rng.random() < 0.5 else " a1'.\n") for _ in range(rng.randrange(14)))
        assert encoder.ids(t) == library.encode(t, add_special_tokens=False).ids
