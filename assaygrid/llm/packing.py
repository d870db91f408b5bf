"""Best-fit packing planned on a histogram of lengths.

Every document becomes its ids and an end mark; longer ones are cut into whole sequences, the first piece being the shorter one.
Best fit by falling length needs no documents, only how many pieces have each length: pieces of one length that fit
one remaining space are placed by division, a whole interval of sequences at once, so the plan takes steps by the number
of lengths and spaces (both at most `size`) and not by the number of pieces. Its slots are intervals: pieces `first` to `last` (by
rank within their length) go to sequences from `sequence` on, `each` to a sequence, from place `offset` on.

A piece's rank within its length is its number within its task plus the pieces of that length in the tasks before; so nothing
is sorted, and a length that most pieces have is dealt like any other. Pieces then take slots by a join on length and rank.

Defined results: null and empty texts are a piece of the end mark alone; rows that repeat an id, or have none, are packed each;
special-token strings in a text become their ids, as the tokenizers library does by default; other columns are not read.
An empty table has no pieces. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import byte_letters
from .line_dedup import _small
from .shared import written

SIZE, END = 1024, 2
#: How byte-level vocabularies of this kind part a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no recent version of Unicode has changed; texts with others go by the slower library.
SETTLED = regex.compile("[\x00-ԯḀ-⯿　-ヿ一-龥가-힣]*+")


class Encoder:
    """Ids of whole texts under a byte-level BPE file, equal to the tokenizers library's.

    Where ids are in order of merging, a second public library with the same vocabulary encodes several times faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        back, first = {c: bytes([b]) for b, c in enumerate(byte_letters())}, len(byte_letters())
        merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space") and all(vocab[m] == first + k for k, m in enumerate(merged)):
            import tiktoken

            ranks = {b"".join(back[c] for c in s): i for s, i in vocab.items() if s not in special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or SETTLED.fullmatch(text)):
            return self.fast.encode(text, allowed_special="all")
        return self.library.encode(text, add_special_tokens=False).ids


@functools.cache
def load(path: str) -> Encoder:
    """One per worker."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, local): `local` is the piece's number within its length and task `part`.

    `with_ids` adds the ids themselves, packed as little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "local", *["ids"] * with_ids]
    kind = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = load(path), [0] * (size + 1), TaskContext.get().partitionId()
        for batch in batches:
            whose, out = [], []
            for d, text in enumerate(batch["text"]):
                ids = np.array([*encoder.ids(text.as_py() or ""), end], "<u4").tobytes()
                at, tokens = 0, len(ids) // 4
                for k in range(-(-tokens // size)):
                    n = tokens % size or size if k == 0 else size
                    own = ids[4 * at : 4 * (at + n)]
                    whose.append(d)
                    out.append((k, at, n, zlib.crc32(own), part, seen[n], *[own] * with_ids))
                    seen[n] += 1
                    at += n
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds[: len(names) - 1]]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(whose, pa.int64())), *columns], names)

    return rows.mapInArrow(cut, kind)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first, last, sequence, offset, each) of best fit by falling length; `last` is exclusive."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # intervals (first sequence, how many) by space left
    slots, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            space = next((r for r in range(length, size + 1) if free[r]), None)
            if space is None:  # a new sequence takes all that fit, too
                space, each = size, size // length
                free[size].append((opened, -(-left // each)))
                opened += -(-left // each)
            each = space // length
            first, many = free[space].pop()
            full = min(many, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, size - space, each))
                free[space - each * length].append((first, full))
                rank, left, first, many = rank + full * each, left - full * each, first + full, many - full
            if many and 0 < left < each:
                slots.append((length, rank, rank + left, first, size - space, left))
                free[space - left * length].append((first, 1))
                left, first, many = 0, first + 1, many - 1
            if many:
                free[space].append((first, many))
    return slots


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; see `pieces` and `sequences`."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, size, end, id_col, text_col, with_ids))
    parts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    slots = spark.createDataFrame(plan(counts, size), "of long, first long, last long, sequence long, place long, each long")
    ranked = cut.join(_small(parts.select("part", "length", "before")), ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    taken = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(F.broadcast(slots), taken)  # slots: lengths times spaces at most
    nth = F.col("rank") - F.col("first")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
                         (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"), *["ids"] * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of what `pack` placed `with_ids`: the packed ids of each sequence in order."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(own, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
