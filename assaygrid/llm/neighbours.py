"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Unit vectors are projected on Gaussian directions, shifted and cut into cells of one width; a table's bucket is the tuple
of a few cells. A query visits, in each table, its own bucket and perturbed ones (one cell up or down in some
directions), in the order of their estimated success: the sum of squared distances to the cell walls that must be
crossed, least first, made lazily by a heap of shift and expand moves. Candidates of all tables are merged and reranked by
the exact cosine of the original vectors in double precision.

Equal vectors are one entry: it carries its smallest k + 1 ids, which is all that k nearest can need. A bucket's entries
and visits meet in a cogroup that multiplies two small matrices and gives on each visit's best entries up to k other ids. A
bucket with more than `SPLIT` entries or visits is dealt out in a grid of groups that large; none is capped. A query
that finds fewer than k is compared with every row, in blocks of queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null id; vectors of another length than the commonest take no part (a tie: the longest); rows that share an id are one
candidate by the best of their vectors, and never neighbours of each other; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from .shared import cut

#: Unit vectors without structure need about half the rows as candidates for nine of ten neighbours.
TABLES, DIRECTIONS, WIDTH, PROBES, SEED = 8, 6, 1.6, 64, 11
SPLIT = 4096
#: Queries that find too few are compared with all rows, so many at a time.
BLOCK = 256


class Hashes:
    def __init__(self, dim: int, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(dim, tables * directions))
        self.b = rng.uniform(0, width, tables * directions)
        self.mix = rng.integers(1, 1 << 62, (tables, directions), dtype=np.int64) | 1
        self.shape, self.width = (tables, directions), width

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and places within the cell (0 to 1), by row, table and direction."""
        at = (unit @ self.a + self.b) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64).reshape(-1, *self.shape), (at - cell).reshape(-1, *self.shape)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for each table's bucket (tables in the last axis but one)."""
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(-1) * 64 + np.arange(self.shape[0])


def perturbations(place: np.ndarray, most: int) -> Iterator[list[tuple[int, int]]]:
    """Sets of (direction, -1 or 1), least squared distance first, at most `most`; the empty set comes first."""
    walls = sorted([(x * x, d, -1) for d, x in enumerate(place)] + [((1 - x) ** 2, d, 1) for d, x in enumerate(place)])
    yield []
    heap, given = [(walls[0][0], (0,))], 1
    while heap and given < most:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(walls):
            step = walls[last + 1][0]
            heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
            heapq.heappush(heap, (cost + step - walls[last][0], (*chosen[:-1], last + 1)))
        moves = [walls[k][1:] for k in chosen]
        if len({d for d, _ in moves}) == len(moves):
            given += 1
            yield moves


def _buckets(vector: Column, hashes: Hashes, probes: int) -> Column:
    """Bucket keys of each vector: one for each table, or `probes` for each."""

    @arrow_udf("array<bigint>")
    def of(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int64()))
        x = np.array(vectors.to_pylist(), float)
        cells, place = hashes.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
        if probes == 1:
            return pa.array(hashes.keys(cells).tolist(), pa.list_(pa.int64()))
        out = []
        for c, p in zip(cells, place):
            keys = set()
            with np.errstate(over="ignore"):
                base = hashes.keys(c)
                for t in range(len(c)):
                    for moves in perturbations(p[t], probes):
                        keys.add(int(base[t] + 64 * sum((hashes.mix[t, d] * s for d, s in moves), np.int64(0))))
            out.append(sorted(keys))
        return pa.array(out, pa.list_(pa.int64()))

    return of(vector)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with finite non-zero vectors of the commonest length, as doubles, and their norms."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    got = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    got = got.where(finite & (F.size(v) > 0)).withColumn("norm", F.sqrt(_dot(v, v))).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    sizes = got.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got.where(F.size(v) == (sizes.d if sizes else 0))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", probes: int = PROBES, **params) -> DataFrame:
    """(query_id, rank from 1, id, score): each query's k nearest found, nearest first. `is_query` is over the id column."""
    valid = _valid(rows, id_col, vec_col)
    first = Window.partitionBy("v").orderBy("id")
    members = valid.dropDuplicates(["v", "id"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    entries = cut(members.groupBy("v", "norm").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids")))  # k + 1 at most
    queries = cut(valid.withColumnRenamed("id", id_col).where(is_query).select(F.col(id_col).alias("query_id"), "v", "norm").dropDuplicates(["query_id", "v"]))
    one = entries.first()
    if one is None:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias(id_col), F.lit(0.0).alias("score")).where("false")
    hashes = Hashes(len(one.v), **params)
    index = entries.select("ids", "v", "norm", F.explode(_buckets(F.col("v"), hashes, 1)).alias("key"))
    visits = queries.select("query_id", F.col("v").alias("q"), F.col("norm").alias("qn"), F.explode(_buckets(F.col("v"), hashes, probes)).alias("key"))
    kind = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"
    best = cut(_best(_met(index, visits, k, kind), k))
    score = (_dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("norm"))).alias("score")
    enough = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(enough, "query_id", "left_anti")
    n = short.count()
    for b in range(-(-n // BLOCK)):
        part = short.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK))) == b).select("query_id", F.col("v").alias("q"), F.col("norm").alias("qn"))
        best = best.join(part.select("query_id").distinct(), "query_id", "left_anti").union(cut(_best(entries.crossJoin(F.broadcast(part)).select("query_id", "ids", score), k)))
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _met(index: DataFrame, visits: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, ids, score): for each visit of a bucket, or of a part of a large one, its best entries up to k other ids.

    Vectors travel in the type they came in, `kind`; products are in double precision.
    """
    parts = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias(name))
    grid = cut(parts(index, "s").join(parts(visits, "t"), "key").where("s > 1 or t > 1"))
    deal = lambda n, by: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    left = index.join(grid, "key", "left").select("key", deal(F.col("s"), "v").alias("a"), each(F.col("t")).alias("b"), "ids", F.col("v").cast(kind).alias("v"))
    right = visits.join(grid, "key", "left").select("key", each(F.col("s")).alias("a"), deal(F.col("t"), "query_id").alias("b"), "query_id", F.col("q").cast(kind).alias("q"))

    def meet(entries: pa.Table, visitors: pa.Table) -> pa.Table:
        rows: list[tuple[int, list[int], float]] = []
        if len(entries) and len(visitors):
            v, q = _matrix(entries["v"]), _matrix(visitors["q"])
            ids = entries["ids"].to_pylist()
            order = np.argsort([i[0] for i in ids], kind="stable")
            v = v[order]
            for at in range(0, len(q), 512):
                cos = q[at : at + 512] @ v.T
                best = np.argsort(-cos, axis=1, kind="stable")
                for row, query in enumerate(visitors["query_id"].slice(at, 512).to_pylist()):
                    others: set[int] = set()  # an id may stand for several vectors: go on until k others are seen
                    for e in best[row]:
                        rows.append((query, ids[order[e]], float(cos[row, e])))
                        others.update(ids[order[e]])
                        if len(others - {query}) >= k:
                            break
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "score": pa.array([r[2] for r in rows], pa.float64())})

    by = ("key", "a", "b")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, ids array<long>, score double")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.asarray(column.combine_chunks().flatten(), dtype=float).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best different ids of each query."""
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pairs = found.select("query_id", F.explode("ids").alias("id"), "score").where("id != query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
