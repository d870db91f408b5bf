"""Ranked lexical search over a document FP-tree.

Documents are restricted to the terms of the items and their terms put in order of document frequency, the commonest
first; documents that begin alike share a path of the tree. Every node knows, of the documents below it, each term's
largest tf, the least m and the least id. With these a node's score for an item is a bound on theirs, and at a leaf (documents of
equal vector and m) it is the score. Depth first, the branches with the largest bound before the others, each item walks the
tree and leaves out what cannot enter its best `k`. Nodes are taken in batches, so that bounds are array operations.

A tree holds a bounded number of documents; a task goes through its documents tree by tree and carries each item's best
on, so later trees are cut off early. Only the best `k` of an item and task are shuffled, and merged in two steps, so that
no task holds what all tasks have found for an item.

Two passes read the texts: one counts (how many documents and terms there are, and the items' terms' document
frequencies), the other builds and searches. Items go in blocks of a bounded number of term occurrences, each block in two passes.

Defined results: null and empty texts have no terms and are never found; items without terms, or whose terms no document holds, have
no rows; rows that repeat an item's id and text are one item, other texts of one id are ranked on their own; rows that repeat a
document's id are documents each; null ids come last among equal scores. Ids are integers. Other columns are not read. Texts are
taken whole, one at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from .decontaminate import words_of
from .shared import written

BEST = 50
#: Term occurrences of a block of items; entries of a tree's tf maxima (and so its documents); nodes taken at once.
BLOCK, CELLS, BATCH = 500_000, 4_000_000, 256
NO_ID = np.iinfo(np.int64).max


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def measure(n: int, n_docs: int, n_terms: int) -> int:
    """A document's m."""
    return 50 + 50 * n * n_docs // n_terms


class Tree:
    """FP-tree of documents (terms ascending by rank, their tfs, m, id), paths without a branch as one step."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray, int, int]], terms: int):
        leaves: dict[tuple[bytes, bytes, int], list[int]] = {}
        for ranks, tfs, m, i in docs:
            leaves.setdefault((ranks.astype(">u4").tobytes(), tfs.astype(">u4").tobytes(), m), []).append(i)
        keys = sorted(leaves)
        children = self._branches([np.frombuffer(k[0], ">u4") for k in keys])
        order, self.at, self.many = self._numbered(children)
        size = len(order)
        self.tf, self.m, self.least = np.zeros((size, terms), np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.ids: dict[int, np.ndarray] = {}
        for node in range(size - 1, -1, -1):  # children have larger numbers
            a, z = self.at[node], self.at[node] + self.many[node]
            if self.many[node]:
                self.tf[node], self.m[node], self.least[node] = self.tf[a:z].max(axis=0), self.m[a:z].min(), self.least[a:z].min()
            else:
                ranks, tfs, m = keys[order[node]]
                own = np.sort(np.array(leaves[keys[order[node]]], np.int64))
                self.tf[node, np.frombuffer(ranks, ">u4").astype(np.int64)] = np.frombuffer(tfs, ">u4")
                self.m[node], self.least[node], self.ids[node] = m, own[0], own

    @staticmethod
    def _branches(paths: list[np.ndarray]) -> list:
        """The tree of sorted paths as nested lists whose innermost entries are leaf numbers."""
        root: list = [0]
        open_ = [(0, root)]  # (depth, children) of the rightmost branch
        for k in range(1, len(paths)):
            n = min(len(paths[k - 1]), len(paths[k]))
            unlike = np.flatnonzero(paths[k - 1][:n] != paths[k][:n])
            shared = int(unlike[0]) if len(unlike) else n
            while open_[-1][0] > shared:
                open_.pop()
            if open_[-1][0] < shared:
                node = [open_[-1][1].pop()]
                open_[-1][1].append(node)
                open_.append((shared, node))
            open_[-1][1].append(k)
        return root

    @staticmethod
    def _numbered(root: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Nodes numbered so that children stand together: (leaf number or list) of each, first child, number of children."""
        nodes, at, many = [root], [], []
        k = 0
        while k < len(nodes):
            own = nodes[k] if isinstance(nodes[k], list) else []
            at.append(len(nodes))
            many.append(len(own))
            nodes += own
            k += 1
        return nodes, np.array(at, np.int64), np.array(many, np.int64)

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        tf = self.tf[nodes[:, None], terms].astype(np.int64)
        return (weights * (1_000_000_000 * tf // np.maximum(1000 * tf + 20 * self.m[nodes][:, None], 1))).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids), highest first, of those given and the tree's documents."""
        there = (self.tf[0, terms] > 0) & (weights > 0)
        terms, weights = terms[there], weights[there]
        if not len(terms):
            return best
        root = np.zeros(1, np.int64)
        stack = [(root, self.bounds(root, terms, weights))]
        while stack:
            nodes, bound = stack.pop()
            if len(best[0]) == k:
                may = (bound > best[0][-1]) | (bound == best[0][-1]) & (self.least[nodes] < best[1][-1])
            else:
                may = bound > 0
            nodes, bound = nodes[may], bound[may]
            leaf = self.many[nodes] == 0
            if leaf.any():
                own = [self.ids[n][:k] for n in nodes[leaf].tolist()]
                scores = np.concatenate((best[0], np.repeat(bound[leaf], [len(i) for i in own])))
                ids = np.concatenate((best[1], *own))
                order = np.lexsort((ids, -scores))[:k]
                best = scores[order], ids[order]
            nodes, bound = nodes[~leaf], bound[~leaf]
            if not len(nodes):
                continue
            order = np.argsort(-bound, kind="stable")
            now, later = order[:BATCH], order[BATCH:]
            if len(later):
                stack.append((nodes[later], bound[later]))
            many = self.many[nodes[now]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            below = np.repeat(self.at[nodes[now]], many) + step
            stack.append((below, self.bounds(below, terms, weights)))
        return best


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms) of items with a term, each once."""

    @arrow_udf("array<binary>")
    def terms(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(words_of(t))) for t in texts.to_pylist()], pa.list_(pa.binary()))

    each = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    return each.select("item", terms(F.col("text")).alias("terms"), F.xxhash64("text").alias("h")).where(F.size("terms") > 0)


def _counted(texts: DataFrame, vocab) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, their terms, and documents by term number; `vocab` is a broadcast of term: number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df, docs, terms = vocab.value.get, Counter(), 0, 0
        for batch in batches:
            for t in batch[0]:
                words = words_of(t.as_py())
                docs, terms = docs + bool(words), terms + len(words)
                df.update(set(map(get, words)))
        df.pop(None, None)
        found = {-2: docs, -1: terms, **df}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["t", "n"])

    df = {r.t: r.n for r in texts.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block
    return df.pop(-2, 0), df.pop(-1, 0), df


def _found(docs: DataFrame, queries, vocab, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, part, score, id): each item's best of each task. `queries` is a broadcast of (terms, weights) by item, `vocab` of term: rank."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, items = vocab.value, queries.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best, part, get = [none] * len(items), [], rank.get
        most = min(4096, max(64, CELLS // max(1, len(rank))))

        def flush():
            tree = Tree(part, len(rank))
            for q, (terms, weights) in enumerate(items):
                best[q] = tree.search(terms, weights, best[q], k)
            part.clear()

        for batch in batches:
            for i, t in zip(batch[0].to_pylist(), batch[1]):
                words = words_of(t.as_py())
                tf = Counter(map(get, words))
                tf.pop(None, None)
                if tf:
                    ranks = np.array(sorted(tf), np.int64)
                    part.append((ranks, np.array([tf[r] for r in ranks.tolist()], np.int64), measure(len(words), n_docs, n_terms), NO_ID if i is None else i))
                    if len(part) >= most:
                        flush()
        if part:
            flush()
        q = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        scores, ids = (np.concatenate([b[c] for b in best]) if best else none[0] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.full(len(q), TaskContext.get().partitionId(), np.int64)), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID)], ["q", "part", "score", "id"])

    return docs.mapInArrow(search, "q long, part long, score long, id long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): the k highest-scoring documents of each item, highest first."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = written(_items(items, item_col, item_text_col))
    blocks = max(1, -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // block))
    kind, out = wanted.schema["item"].dataType.simpleString(), []
    top = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "h"), F.lit(blocks)) == b).select("item", "terms").collect()
        terms = sorted({bytes(t) for r in rows for t in r.terms})
        vocab = spark.sparkContext.broadcast({t: n for n, t in enumerate(terms)})
        n_docs, n_terms, df = _counted(texts.select("text"), vocab)
        common = sorted(df, key=lambda t: (-df[t], t))  # term numbers that a document holds, the commonest first
        rank = {terms[t]: r for r, t in enumerate(common)}
        weights = np.array([weight(n_docs, df[t]) for t in common], np.int64)
        own = [np.array(sorted(rank[bytes(t)] for t in r.terms if bytes(t) in rank), np.int64) for r in rows]
        queries = spark.sparkContext.broadcast([(o, weights[o]) for o in own])
        found = written(_found(texts, queries, spark.sparkContext.broadcast(rank), n_docs, n_terms, k))
        salt = max(1, round(((found.agg(F.max("part")).first()[0] or 0) + 1) ** 0.5))
        some = found.withColumn("salt", F.col("part") % salt).withColumn("r", top("q", "salt")).where(F.col("r") <= k)
        best = some.withColumn("rank", top("q")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"q long, item {kind}")
        out.append(best.join(F.broadcast(names), "q").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found
