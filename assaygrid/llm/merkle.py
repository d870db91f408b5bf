"""A Merkle manifest of a dataset, kept as a postorder append log.

Leaves are in order within their tree. Aligned builders take `RUN ** LEVELS` leaves each and append every node to their segment of
the log when it is complete: a leaf at once, a parent after its eighth child, and the unfinished last runs, level by level, at
the end. In such a log a node's place follows from subtree sizes alone (`place`), so siblings are read without an index.
The segments' roots are the leaves of the next builders, up to one root for each tree; trees' roots form a last tree.

Proofs go the other way: a segment's log and the path above it give each of its leaves the siblings on its way to the root.
A segment holds `RUN ** LEVELS` leaves at most, whatever the tree; a tree may hold all rows.

Defined results: null values are told from empty ones; a null tree is a tree of its own and the first; null keys come first
in their tree; rows that repeat a key are in order of their leaves, and equal rows are leaves each. One leaf is its tree's root, one tree's
root is the root. An empty table has no leaves and no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

RUN, LEVELS = 8, 3
WIDTH = RUN**LEVELS
HEX = 64


def digest(*values: Column) -> Column:
    """H of values: each is `-` if null, else its bytes' count, `:` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


def _h(nodes: str) -> str:
    return hashlib.sha256(nodes.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n leaves until one node remains."""
    k = 0
    while RUN**k < n:
        k += 1
    return k


def append(leaves: list[str], levels: int) -> list[str]:
    """The log of one builder: its nodes in order of completion."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]
    for node in leaves:
        for k in range(levels + 1):
            log.append(node)
            runs[k].append(node)
            if k == levels or len(runs[k]) < RUN:
                break
            node = _h("".join(runs[k]))
            runs[k] = []
    for k in range(levels):
        if runs[k]:
            node = _h("".join(runs[k]))
            log.append(node)
            runs[k + 1].append(node)
    return log


def place(level: int, j: int, n: int, levels: int) -> int:
    """Where the log of n leaves has node j of a level: after the nodes that are complete before it."""
    last = (j + 1) * RUN**level - 1
    if last < n:
        return sum(last // RUN**m for m in range(levels + 1)) + level
    return sum(n // RUN**m for m in range(levels + 1)) + sum(n % RUN**m > 0 for m in range(1, level))


def siblings(log: str, n: int, levels: int) -> list[str]:
    """The nodes of each level below the last, side by side, from a log as one string of digests."""
    out = []
    for k in range(levels):
        at = [HEX * place(k, j, n, levels) for j in range(-(-n // RUN**k))]
        out.append("".join([log[a : a + HEX] for a in at]))
    return out


def path(rows: list[str], j: int) -> Iterator[tuple[str, str]]:
    """(before, after) of leaf j on each level: the run's other nodes."""
    for row in rows:
        run = j // RUN * RUN * HEX
        yield row[run : j * HEX], row[(j + 1) * HEX : run + RUN * HEX]
        j //= RUN


PATH = "array<struct<before:string,after:string>>"
PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def ranked(rows: DataFrame) -> DataFrame:
    """(tree, key, leaf, ...) with `rank` from 0 within the tree and `n`, the tree's leaves.

    Rows are range-partitioned and numbered within partitions; offsets come from one count for each partition and tree.
    """
    order = ["key", "leaf"]
    parts = written(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    local = parts.withColumn("r", F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)))
    w = Window.partitionBy("tree")
    counts = parts.groupBy("part", "tree").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "tree", before.alias("before"), F.sum("k").over(w).alias("n"))
    return local.join(offsets, ["part", "tree"]).withColumn("rank", F.col("r") - 1 + F.col("before")).drop("part", "r", "before")


def segments(leaves: DataFrame) -> DataFrame:
    """(tree, chunk, n, log, root) of leaves (tree, rank, n, leaf): one row for each builder."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table["n"][0].as_py()
        log = append(table["leaf"].to_pylist(), levels_of(n) if n <= WIDTH else LEVELS)
        return pa.table({"tree": table["tree"][:1], "chunk": table["chunk"][:1], "n": table["n"][:1], "log": ["".join(log)], "root": [log[-1]]})

    chunked = leaves.select("tree", "rank", "n", "leaf", F.floor(F.col("rank") / WIDTH).cast("long").alias("chunk"))
    return chunked.groupBy("tree", "chunk").applyInArrow(build, "tree string, chunk long, n long, log string, root string")


def build(leaves: DataFrame) -> list[DataFrame]:
    """The segments of each stage; a stage's leaves are the roots of the one before. The last has one segment for each tree that reached it."""
    stages = [written(segments(leaves))]
    while not (rest := stages[-1].where(F.col("n") > WIDTH)).isEmpty():
        stages.append(written(segments(rest.select("tree", F.col("chunk").alias("rank"), F.ceil(F.col("n") / WIDTH).cast("long").alias("n"), F.col("root").alias("leaf")))))
    return stages


def roots(stages: list[DataFrame]) -> DataFrame:
    """(tree, root)"""
    ended = [s.where(F.col("n") <= WIDTH).select("tree", "root") for s in stages]
    out = ended[0]
    for e in ended[1:]:
        out = out.union(e)
    return out


def _extended(stage: DataFrame, tails: DataFrame) -> DataFrame:
    """(tree, chunk, tail) for the segments below: each leaf's path in its segment, then the segment's own."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = min(WIDTH, r["n"] - r["chunk"] * WIDTH)
                rows = siblings(r["log"], n, levels_of(n) if r["n"] <= WIDTH else LEVELS)
                tails = [[{"before": a, "after": z} for a, z in path(rows, j)] + r["tail"] for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n), pa.array(range(r["chunk"] * WIDTH, r["chunk"] * WIDTH + n), pa.int64()), pa.array(tails, PATH_TYPE)], ["tree", "chunk", "tail"])

    return stage.join(tails, ["tree", "chunk"]).select("tree", "chunk", "n", "log", "tail").mapInArrow(extend, f"tree string, chunk long, tail {PATH}")


def tails(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, chunk, tail): the path from each segment of the first stage to the root; `tops` has (tree, tail) from tree to root."""
    ended = lambda s: s.where(F.col("n") <= WIDTH).select("tree", "chunk").join(tops, "tree")
    out = written(ended(stages[-1]))
    for upper, s in zip(stages[:0:-1], stages[-2::-1]):
        out = written(_extended(upper, out).unionByName(ended(s)))
    return out


def manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """Leaves with their places, segments with their paths, and the root of (tree, key, leaf, changed, ...).

    The first is `ranked`, the second (tree, chunk, n, log, tail, subroot).
    """
    named = rows.withColumn("tree", F.coalesce(F.concat(F.lit("+"), F.col("tree").cast("string")), F.lit("")))
    leaves = written(ranked(named))
    stages = build(leaves)
    subroots = roots(stages)
    top = written(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"))))
    above = build(top)
    root = roots(above).first()
    if root is None:
        return leaves, stages[0].select("tree", "chunk", "n", "log", F.lit(None).cast(PATH).alias("tail"), F.col("root").alias("subroot")), None
    start = leaves.sparkSession.createDataFrame([("", [])], f"tree string, tail {PATH}")
    paths = _extended(above[0], tails(above, start)).select(F.col("chunk").alias("rank"), "tail")
    tops = written(top.join(paths, "rank").select(F.col("key").alias("tree"), "tail"))
    segs = stages[0].select("tree", "chunk", "n", "log").join(tails(stages, tops), ["tree", "chunk"]).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    return leaves, segs, root.root


def prove(leaves: DataFrame, segs: DataFrame, root: str | None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf.

    The proof is the siblings of the untampered tree, level by level; `folded_root` follows it from `changed`, or from the leaf where that is null.
    """
    kind = leaves.schema["key"].dataType.simpleString()

    def fold(docs: pa.Table, segment: pa.Table) -> pa.Table:
        (s,) = segment.to_pylist()
        base, n = s["chunk"] * WIDTH, min(WIDTH, s["n"] - s["chunk"] * WIDTH)
        rows = siblings(s["log"], n, levels_of(n) if s["n"] <= WIDTH else LEVELS)
        tail = [(p["before"], p["after"]) for p in s["tail"]]
        rest = "".join([a + z for a, z in tail])
        proofs, folded, ok = [], [], []
        for rank, leaf, changed in zip(docs["rank"].to_pylist(), docs["leaf"].to_pylist(), docs["changed"].to_pylist()):
            own, node = list(path(rows, rank - base)), changed or leaf
            proofs.append(_h("".join([a + z for a, z in own]) + rest))
            for a, z in own:
                node = _h(a + node + z)
            for a, z in tail:
                node = _h(a + node + z)
            folded.append(node)
            ok.append(node == root)
        same = lambda v: pa.array([v] * len(docs), pa.string())
        return pa.table({"key": docs["key"], "leaf": docs["leaf"], "subroot": same(s["subroot"]), "root": same(root), "proof_sha256": proofs, "folded_root": folded, "verified": ok})

    chunked = leaves.select("tree", F.floor(F.col("rank") / WIDTH).cast("long").alias("chunk"), "rank", "key", "leaf", "changed")
    return chunked.groupBy("tree", "chunk").cogroup(segs.groupBy("tree", "chunk")).applyInArrow(
        fold, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
