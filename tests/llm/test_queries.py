"""Every registered opN_ query on small tables, its columns against plain computations."""

import hashlib
import random
import zlib

import __spark_entry__
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import test_chat, test_decontaminate, test_line_dedup, test_neighbours, test_secrets, test_simhash

SHA = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and repeated texts; returns (folder, documents, benchmark)."""
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    docs, items = test_decontaminate.sample()
    docs += [(200 + k, t) for k, t in enumerate(test_secrets.texts()[:40])] + [(400 + k, t) for k, (_, t) in enumerate(test_line_dedup.corpus(20))]
    docs += [(500 + k, " ".join(rng.choice(["%%zorrix", "blag#"] if k % 2 else ["then", "other."]) for _ in range(30))) for k in range(40)] + [(None, "no id here"), (900, "Ünïcode ☃ text\n\n")]
    rows = [(d, t, "xy"[(d or 0) % 2] if d != 3 else None, "s", None if t is None else len(t)) for d, t in docs]
    write = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).repartition(2).write.parquet(f"{at}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("benchmark", items, "item_id long, text string")
    write("labels", [(500 + k, 1 - k % 2, k % 2) for k in range(40)] + [(None, 1, 1), (501, None, None)], "doc_id long, quality int, toxic int")
    write("embeddings", [(k, [rng.random() - 0.5 for _ in range(6)], 0) for k in range(120)] + [(150, None, 0)], "vec_id long, embedding array<float>, label int")
    write("conversations", [(c, k, "user", f"t{k}") for c in range(5) for k in range(c + 1)], "conv_id long, turn long, role string, text string")
    return str(at), docs, items


def rows_of(spark, tables, name, key="doc_id"):
    got = __spark_entry__.queries()[name](spark, tables[0]).collect()
    return sorted(got, key=lambda r: (r[key] is None, r[key]))


def by_id(docs):
    return sorted(docs, key=lambda r: (r[0] is None, r[0]))


def test_op1(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r, (d, t) in zip(rows_of(spark, tables, "op1_bpe_round_trip"), by_id(tables[1]), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (d, len(ids), SHA(b"".join(i.to_bytes(4, "little") for i in ids)), SHA(library.decode(ids, skip_special_tokens=False).encode()))


def test_op2(spark, tables):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()]
    got = {}
    for r in sorted(rows_of(spark, tables, "op2_nearest_neighbours", "query_id"), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert got == {q: [(k, i, -s) for k, (s, i) in enumerate(v, 1)] for q, v in test_neighbours.exact(vectors).items()}


def test_op3(spark, tables):
    for r, (d, t) in zip(rows_of(spark, tables, "op3_secret_scan"), by_id(tables[1]), strict=True):
        base = test_secrets.brute(t, test_secrets.BASE)
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (d, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), SHA(base.encode()))
        assert r.spans == test_secrets.brute(t, test_secrets.BASE + test_secrets.EXTRA)


def test_op4(spark, tables):
    (r,) = rows_of(spark, tables, "op4_chat_format", "conv_id")
    assert r.conv_id == 4 and r.n_turns == 5 and r.rendered == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(5))


def test_op5(spark, tables):
    prints = {k: test_simhash.brute_print(t) for k, (d, t) in enumerate(by_id(tables[1]))}
    ids = {k: d for k, (d, _) in enumerate(by_id(tables[1]))}
    roots = test_simhash.brute_components(prints)
    least = {}
    for k, root in roots.items():
        if ids[k] is not None:
            least[root] = min(least.get(root, ids[k]), ids[k])
    for k, r in enumerate(rows_of(spark, tables, "op5_simhash_near_dedup")):
        assert (r.doc_id, r.fingerprint, r.component_id) == (ids[k], f"{prints[k] & (1 << 64) - 1:016x}", least.get(roots[k]))


def test_op6_op7_folds(spark, tables):
    crc = lambda d, m: zlib.crc32(str(d).encode()) % m
    for r, (d, t) in zip(rows_of(spark, tables, "op6_quality"), by_id(tables[1]), strict=True):
        assert (r.doc_id, r.held_out, r.predicted) == (d, d is not None and crc(d, 5) == 0, int(r.score >= 0.3)) and 0 <= r.score <= 1
    for r, (d, t) in zip(rows_of(spark, tables, "op7_language_id"), by_id(tables[1]), strict=True):
        assert (r.doc_id, r.held_out) == (d, d is not None and crc(d, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.lang_pred in ("x", "y", "und")


def test_op8(spark, tables):
    want = test_line_dedup.brute(tables[1])
    got = sorted(((r.doc_id, r.text) for r in rows_of(spark, tables, "op8_line_dedup")), key=str)
    assert got == want


def test_op9(spark, tables):
    want = test_decontaminate.brute(tables[1], tables[2])
    for r in rows_of(spark, tables, "op9_benchmark_decontamination"):
        n, hit, items, unnamed = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items) + unnamed, SHA(",".join(items).encode()), hit > 0)


def test_op10(spark, tables):
    got = {r.doc_id: r for r in rows_of(spark, tables, "op10_toxicity")}
    assert len(got) == len(tables[1]) and sum(got[500 + k].rejected == bool(k % 2) for k in range(40)) >= 38
    assert all(r.rejected == (r.p_toxic >= 0.5) for r in got.values())


def test_every_query_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, run in __spark_entry__.queries().items():
        if name.startswith("op") or name == "pipeline":
            assert run(spark, str(tmp_path)).count() == 0, name
