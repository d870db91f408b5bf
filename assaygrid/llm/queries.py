"""The registered opN_ queries: each applies one operator to its whole table."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, language, lexical, line_dedup, merkle, neighbours, packing, quality, secrets, simhash, toxicity
from .shared import crc_fold, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", bpe.digests(F.col("text"), tokenizer_path()).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontaminate.blocks_of(table(spark, sf_dir, "benchmark"))
    found = table(spark, sf_dir, "documents").select("doc_id", decontaminate.contamination(F.col("text"), blocks).alias("c"))
    hit = F.aggregate("c.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "c.n_words", hit.alias("n_hit"), (F.size("c.items") + F.col("c.unnamed").cast("int")).cast("long").alias("n_items"),
                        F.sha2(F.array_join("c.items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    p = docs.select("doc_id", toxicity.score(F.col("text"), chain).alias("p"))
    return p.select("doc_id", (F.col("p.toxic") >= toxicity.THRESHOLD).alias("rejected"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in reversed(toxicity.CATEGORIES)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(-1)).cast("long").alias("n_lines"))
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "text")


OP8_SQL = """
WITH rows AS (SELECT DISTINCT doc_id, substr(md5(text), 1, 15) AS rk, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT doc_id, rk, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM rows),
words AS (SELECT doc_id, rk, k, line, list_filter(regexp_split_to_array(lower(line), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM lines),
sets AS (SELECT doc_id, rk, k, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  ELSE [array_to_string(w, ' ')] END AS s FROM words WHERE len(w) > 0),
posts AS (SELECT doc_id, rk, k, len(s) AS n, unnest(s) AS t FROM sets),
hits AS (SELECT DISTINCT a.doc_id, a.rk, a.k FROM posts a JOIN posts b ON a.t = b.t
  AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.rk < a.rk OR b.doc_id = a.doc_id AND b.rk = a.rk AND b.k < a.k)
  GROUP BY a.doc_id, a.rk, a.k, b.doc_id, b.rk, b.k, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
kept AS (SELECT w.doc_id, w.rk, string_agg(w.line, chr(10) ORDER BY w.k) AS text FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.rk = w.rk AND h.k = w.k
  WHERE h.k IS NULL GROUP BY w.doc_id, w.rk)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN CAST(-1 AS BIGINT) ELSE CAST(len(string_split(d.text, chr(10))) AS BIGINT) END AS n_lines,
  CASE WHEN d.doc_id IS NULL OR d.text IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id AND k.rk = substr(md5(d.text), 1, 15)
"""


def secret_digests(docs: DataFrame) -> DataFrame:
    base = [r.kind for r in secrets.RULES if r.base]
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return secrets.scan(docs).select("doc_id", *(of(k).alias(f"n_{k}") for k in base),
                                     F.sha2(secrets.as_text(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_fold("doc_id", 5)
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"), fold != 0)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_fold("doc_id", 4)
    trees = spark.sparkContext.broadcast(language.learn(docs.where(fold != 2)))
    found = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), language.identify(F.col("text"), trees).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, max(turn) AS m, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM t GROUP BY conv_id),
x AS (SELECT DISTINCT conv_id, turn FROM t),
p AS (SELECT DISTINCT CAST(list_filter(c.l, lambda e: e.turn <= x.turn) AS VARCHAR) AS l FROM c JOIN x ON x.conv_id = c.conv_id WHERE x.turn < c.m),
k AS (SELECT min(conv_id) AS conv_id FROM c WHERE CAST(l AS VARCHAR) NOT IN (SELECT l FROM p) GROUP BY CAST(l AS VARCHAR))
SELECT t.conv_id, t.turn // 256 AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t JOIN k ON k.conv_id = t.conv_id GROUP BY t.conv_id, t.turn // 256
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, unnest(list_distinct(ws)) AS t FROM (SELECT DISTINCT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark)),
c AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY row, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
s AS (SELECT i.item_id, p.row, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score
  FROM i JOIN p ON p.t = i.t JOIN w ON w.t = i.t, c GROUP BY i.item_id, p.row, p.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own, folded = (merkle.digest(*(F.col(c) for c in names[:-1]), t) for t in (F.col("text"), F.translate("text", string.ascii_uppercase, string.ascii_lowercase)))
    leaves, segments, root = merkle.manifest(docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), own.alias("leaf"), F.when(crc_fold("doc_id", 3) == 0, folded).alias("changed")))
    return merkle.prove(leaves, segments, root).withColumnRenamed("key", "doc_id")


def _op12_sql(levels: int = 7, above: int = 3) -> str:
    """Unrolled for 8 ** levels leaves a tree and 8 ** above trees."""
    entry = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(entry(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"d AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256({head} || {entry('text')}) AS leaf, sha256({head} || {entry(lower)}) AS low FROM documents)",
           "g0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, low FROM d)",
           "bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)",
           "s0 AS (SELECT g0.*, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)) AS c FROM g0, bytes)",
           "f0 AS (SELECT doc_id, tree, i AS i0, h AS leaf, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN low ELSE h END AS f, '' AS proof FROM s0)"]

    def climb(g: str, f: str, k: int) -> None:
        sql.append(f"r{g}{k} AS (SELECT tree, i // 8 AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {g}{k}) GROUP BY tree, i // 8)")
        sql.append(f"{g}{k + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{g}{k})")
        at = f"CAST((x.i0 // {8**k}) % 8 AS BIGINT)"
        before, after = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:8], '')"
        keep = ", subroot" if f == "t" else ""
        sql.append(f"{f}{k + 1} AS (SELECT doc_id, x.tree, i0, leaf{keep}, CASE WHEN n = 1 THEN f ELSE sha256({before} || f || {after}) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || {before} || {after} END AS proof "
                   f"FROM {f}{k} x JOIN r{g}{k} r ON r.tree = x.tree AND r.i = x.i0 // {8 ** (k + 1)})")

    for k in range(levels):
        climb("g", "f", k)
    sql.append(f"u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS own FROM g{levels})")
    sql.append(f"t0 AS (SELECT doc_id, '' AS tree, u0.i AS i0, leaf, h AS subroot, f, proof FROM f{levels} x JOIN u0 ON u0.own = x.tree)")
    for k in range(above):
        climb("u", "t", k)
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, (SELECT h FROM u{above}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM u{above}) AS verified FROM t{above}"


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op4_chat_format": op4_chat_format, "op6_quality": op6_quality, "op7_language_id": op7_language_id, "op2_nearest_neighbours": op2_nearest_neighbours, "op3_secret_scan": op3_secret_scan, "op8_line_dedup": op8_line_dedup, "op10_toxicity": op10_toxicity, "op9_benchmark_decontamination": op9_benchmark_decontamination, "op1_bpe_round_trip": op1_bpe_round_trip, "op5_simhash_near_dedup": op5_simhash_near_dedup,
           "op11_ranked_search": op11_ranked_search, "op12_merkle_manifest": op12_merkle_manifest, "op13_best_fit_packing": op13_best_fit_packing}
ORACLE: dict[str, str] = {"op4_chat_format": OP4_SQL, "op8_line_dedup": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_merkle_manifest": _op12_sql()}
