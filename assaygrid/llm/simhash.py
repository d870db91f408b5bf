"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most two bits have a half
that differs in at most one, so they share a variant of that half in which one bit is left out. Variants are
the keys of an equality join over *distinct* fingerprints; candidates are verified on all 64 bits.

Copies fall together as one fingerprint before anything is joined. A bucket with more than `dense` different
fingerprints (a large family of near copies) is not paired up: its members take a finer key, the whole
fingerprint without two bits. At most four fingerprints share such a key and all of them are within two
bits, so a star over each key keeps every component whole and the rows grow with the members, not the pairs.

Components come from alternating large-star and small-star rounds on the link table; each round is a
shuffle over links and is written to the shared checkpoint folder.

Defined results: null, empty and white-space texts have no shingle, fingerprint 0, and link like any other;
fewer words than a shingle count as one shingle; repeated shingles count each time; a tie (exactly half) is
0. Rows with equal ids stay as rows, and a null id takes part but never names a component unless it is alone
(then the component is null). Extra columns are not read and do not clash.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from .shared import cut, small, written

HALF = 32
#: A bucket with more distinct fingerprints than this takes the finer keys.
DENSE = 128
BLOCK = 1 << 15


def majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n unsigned hashes, which come in blocks, as a signed long."""
    ones = np.zeros(64, np.int64)
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def bits_over_half(data: bytes, words: int) -> int:
    """Fingerprint of one lower-cased UTF-8 text. Shingle hashes are summed in blocks, so memory is bounded."""
    tokens = data.split()  # bytes split at exactly \x20 and \x09-\x0D
    if not tokens:
        return 0
    single, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    return majority((np.array([digest(single[a:b], 42) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64) for at in range(0, n, BLOCK)), n)


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit SimHash (a long) of word shingles under XXH64 with seed 42, after lower-casing A-Z."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            raw = x.as_py() if x.is_valid else None
            out.append(bits_over_half(raw.encode().lower(), words) if raw else 0)
        return pa.array(out, pa.int64())

    return of(text)


def _without(fp: Column, i: Column) -> Column:
    """The fingerprint with bit i cleared."""
    return fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a < b) that connect all distinct fingerprints `fp` at two or fewer differing bits.

    Every link holds; within dense buckets they are a spanning set, elsewhere all links.
    """
    half, bit = F.lit(HALF), F.col("bit")
    mask = F.lit((1 << HALF) - 1).cast("long")
    side = F.when(bit < HALF, F.col("fp").bitwiseAND(mask)).otherwise(F.call_function("shiftrightunsigned", F.col("fp"), half))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = lambda rows: rows.repartition(n, F.xxhash64("fp"))  # noqa: E731  few rows become many; Spark leaves out a repartition by `fp` itself after a grouping by it, and merges its small partitions
    keyed = even(prints).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(
        "fp", (_without(side, bit % HALF) * 64 + bit).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1")
    sizes = cut(sizes)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    shared = cut(keyed.hint("merge").join(sizes, "key"))  # Spark sizes keys by the fingerprints they come from, a 64th of them, and would broadcast them
    sparse = shared.where(F.col("n") <= dense)
    left, right = sparse.select("key", F.col("fp").alias("a")), sparse.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    i, j = F.col("i"), F.col("j")
    finer = (even(crowd).select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
             .select("fp", "i", F.explode(F.sequence(i + 1, F.lit(63))).alias("j"))
             .select("fp", _without(_without(F.col("fp"), i), j).alias("rest"), (i * 64 + j).alias("out")))
    stars = (finer.groupBy("rest", "out").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
             .select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b")))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for nodes with an edge."""
    edges = cut(edges.select("a", "b").where("a != b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low).where("a != b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct()).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, dense: int = DENSE) -> DataFrame:
    """One row per document: id, `fp` (long) and `component_id` (smallest id reachable at <= 2 bits)."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")))
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(firsts.select("fp"), dense))
    rooted = (firsts.join(roots, firsts.fp == roots.node, "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    rooted = cut(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The documents without all but the smallest id of each near-duplicate group; columns as given.

    Rows with a null id stay: no id tells them apart from the group's first. Rows that repeat an id stay or
    go together.
    """
    found = near_duplicates(docs, id_col, text_col, words)
    return without(docs, found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct(), id_col)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not in `gone` (id), which is broadcast if it has few rows; rows are held in a struct, so no name clashes."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(small(written(gone)), F.col(f"row.`{id_col}`") == F.col("id"), "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
