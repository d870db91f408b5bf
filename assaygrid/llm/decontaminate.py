"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded slice of documents. All its words become integers, the shard's whole text gets a suffix array, a
Burrows-Wheeler transform held as a wavelet matrix, and sampled suffix positions. All benchmark windows are searched
backwards at once (rank by rank through the wavelet matrix), occurrences are located by stepping to the next sampled
position, and their word spans are merged. Each document ends with a symbol of its own, so copies within a shard compare
no further than their ends. Words that no window holds share `OTHERS` symbols, which no window asks for.

Windows come in blocks, each broadcast in packed form (about 4 MB) and unpacked for one shard at a time; a block has an index of
its own over the shard. A benchmark beyond `MOST` windows is an error: call once for each part of it, spans and items of
parts unite. Nothing is shuffled: a shard's result depends on its own rows alone.

Defined results: null and empty texts have no words; items without words have no window; windows of items with a null id are
found like others, and such items are told by `unnamed` instead of an id; repeated rows are searched like any other;
extra columns are not read. A document without a hit has an empty list of spans.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .shared import written

#: Bytes of words (digits, letters, all beyond ASCII) stay, A-Z become a-z, all others end a word.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Windows a block may hold; words of a shard; distance of sampled suffix positions.
BLOCK, SHARD, SAMPLE = 100_000, 250_000, 8
#: Bytes of texts that a task takes apart at once (one text at least).
SLICE = 8 << 20
#: Symbols for words that no window holds; windows that may be broadcast in all.
OTHERS, MOST = 1024, 20_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


def suffix_array(text: np.ndarray, bits: int = 16) -> np.ndarray:
    """By prefix doubling from as many symbols (of so many bits) as a word holds; only suffixes that still tie are sorted again."""
    n, k = len(text), max(1, 63 // bits)
    first = np.zeros(n, np.int64)
    for j in range(k):
        first <<= bits
        first[: max(0, n - j)] |= text[j:]
    order = np.argsort(first, kind="stable")
    first = first[order]
    head = np.concatenate(([True], first[1:] != first[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while n and not head.all():
        tied = np.flatnonzero(~head | np.concatenate((~head[1:], [False])))
        rows = order[tied]
        after = np.where(rows + k < n, rank[np.minimum(rows + k, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[rows]))
        rows, after = rows[by], after[by]
        order[tied] = rows
        new = np.concatenate(([True], (rank[rows][1:] != rank[rows][:-1]) | (after[1:] != after[:-1])))
        head[tied] = new
        rank[rows] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        k *= 2
    return order


class FmIndex:
    """Over integers from 0 to `top`. The text's end is a sentinel below all of them."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        text = np.concatenate((text.astype(np.int64) + 1, [0]))
        self.n, self.levels = len(text), (top + 1).bit_length()
        order = suffix_array(text, self.levels)
        last = text[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        self.ones, self.zeros = [], []
        level = last
        for b in range(self.levels - 1, -1, -1):
            bits = level >> b & 1
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate((level[bits == 0], level[bits == 1]))
        self.last = last.astype(np.int32)
        taken = order % sample == 0
        self.sampled = np.concatenate((np.zeros(1, np.int32), np.cumsum(taken, dtype=np.int32)))
        self.at = order[taken]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands in the first i[k] rows of the transform."""
        lo = np.zeros_like(i)
        for b, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            one = (c >> b & 1).astype(bool)
            lo, i = np.where(one, zeros + ones[lo], lo - ones[lo]), np.where(one, zeros + ones[i], i - ones[i])
        return i - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and the row after the last, for each row of `patterns` (all of one length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for c in (patterns.T + 1)[::-1]:
            c = c[live]
            lo[live], hi[live] = self.below[c] + self.rank(c, lo[live]), self.below[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.where(lo < hi, hi, lo)
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of transform rows."""
        found, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            r = rows[open_]
            marked = self.sampled[r + 1] > self.sampled[r]
            found[open_[marked]] = self.at[self.sampled[r[marked]]] + steps
            open_, r = open_[~marked], r[~marked]
            c = self.last[r].astype(np.int64)
            rows[open_] = self.below[c] + self.rank(c, r)
            steps += 1
        return found


class Block:
    """Windows as rows of word numbers, by length, each with its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str | None]]):
        self.ids = {w: k for k, w in enumerate(sorted({w for p in windows for w in p}), 1)}
        by: dict[int, list] = defaultdict(list)
        for p in sorted(windows):
            by[len(p)].append(p)
        self.by = {m: (np.array([[self.ids[w] for w in p] for p in ps], np.int64), [windows[p] for p in ps]) for m, ps in by.items()}


class Packed:
    """A block as bytes, for a broadcast."""

    def __init__(self, block: Block):
        self.data = zlib.compress(pickle.dumps(block), 1)

    def unpacked(self) -> Block:
        return pickle.loads(zlib.decompress(self.data))


def search_shard(words: list[list[bytes]], block: Block) -> tuple[list[list[tuple[int, int]]], list[set[str | None]]]:
    """For each document of the shard: merged word spans and the items found."""
    get, docs, known = block.ids.get, len(words), len(block.ids)
    size = sum(map(len, words)) + docs
    flat = np.fromiter((get(w) or known + 1 + (hash(w) & OTHERS - 1) for ws in words for w in (*ws, b"")), np.int64, size)
    ends = np.cumsum([len(ws) + 1 for ws in words])
    flat += docs - 1
    flat[ends - 1] = np.arange(docs)  # below all words
    spans: list[list[tuple[int, int]]] = [[] for _ in words]
    items: list[set[str | None]] = [set() for _ in words]
    index, cover = FmIndex(flat, docs + known + OTHERS), np.zeros(size + 1, np.int64)
    for m, (patterns, owners) in block.by.items():
        lo, hi = index.search(patterns + docs - 1)
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            continue
        counts = (hi - lo)[hits]
        rows = np.arange(counts.sum()) + np.repeat(lo[hits] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        start = index.locate(rows)
        cover += np.bincount(start, minlength=size + 1) - np.bincount(start + m, minlength=size + 1)
        doc = np.searchsorted(ends, start, side="right")
        for key in np.unique(doc * len(patterns) + np.repeat(hits, counts)).tolist():
            items[key // len(patterns)].update(owners[key % len(patterns)])
    hit = np.concatenate(([False], np.cumsum(cover) > 0, [False]))
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(np.searchsorted(ends, a, side="right"))
        base = int(ends[d - 1]) if d else 0
        spans[d].append((a - base, b - base))
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_texts(texts: list[str | None], blocks: list, shard: int = SHARD) -> list[tuple[int, list[tuple[int, int]], list[str], bool]]:
    """(words, spans, items, unnamed) of each text; `blocks` are broadcast variables. Texts beyond a shard are cut with overlap."""
    only = blocks[0].value.unpacked() if len(blocks) == 1 else None
    result: list[list] = [[0, [], set()] for _ in texts]
    part: list[tuple[int, int, list[bytes]]] = []

    def flush():
        for b in blocks:
            for (d, at, _), s, i in zip(part, *search_shard([w for _, _, w in part], only or b.value.unpacked())):
                result[d][1] += [(x + at, y + at) for x, y in s]
                result[d][2] |= i
        part.clear()

    size = 0
    for d, t in enumerate(texts):
        words = words_of(t)
        result[d][0] = len(words)
        for at in range(0, len(words), shard):
            part.append((d, at, words[at : at + shard + WINDOW - 1]))
            size += len(part[-1][2])
            if size >= shard:
                flush()
                size = 0
    if part:
        flush()
    return [(n, merged(s), sorted(i - {None}), None in i) for n, s, i in result]


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, window): each item's windows of `size` consecutive words; all its words, if it has fewer."""

    @arrow_udf("array<array<binary>>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            w = words_of(t)
            out.append([w[k : k + size] for k in range(max(1, len(w) - size + 1))] if w else [])
        return pa.array(out, pa.list_(pa.list_(pa.binary())))

    return benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.explode(cut(F.col(text_col))).alias("window"))


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> list:
    """Broadcast blocks of about `block` windows each; the driver holds one unpacked at a time."""
    found = written(windows(benchmark, item_col, text_col).distinct())
    total = found.count()
    if total > MOST:
        raise ValueError(f"{total} windows are too many to broadcast; call once for each part of the benchmark")
    n = -(-total // block)
    out = []
    for k in range(n):
        by: dict[tuple[bytes, ...], list[str | None]] = defaultdict(list)
        for item, window in found.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).collect():
            by[tuple(map(bytes, window))].append(item)
        if by:
            out.append(benchmark.sparkSession.sparkContext.broadcast(Packed(Block(by))))
    return out


RESULT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("unnamed", pa.bool_())])


def sliced(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in slices of about `SLICE` bytes, so that a batch of long texts is never a list as a whole."""
    step = max(1, len(texts) * SLICE // max(1, texts.nbytes))
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist()


def contamination(text: Column, blocks: list) -> Column:
    """struct<n_words, spans: array<struct<start, end>> in words, items: sorted array<string>, unnamed: boolean> of each text."""

    @arrow_udf("struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>,unnamed:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        rows = lambda found: pa.array([{"n_words": n, "spans": [{"start": a, "end": b} for a, b in s], "items": i, "unnamed": u} for n, s, i, u in found], RESULT)
        return pa.concat_arrays([rows([]), *(rows(search_texts(some, blocks)) for some in sliced(texts))])

    return of(text)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans; a line break stands where one was."""
    at, parts, words = 0, [], [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    for a, b in spans:
        parts.append(text[at : words[a][0]].rstrip())
        at = words[b - 1][1]
    return "\n".join([*parts, text[at:].lstrip()])


def cleaned(texts: list[str | None], blocks: list) -> list[str | None]:
    """The texts without windows; those that hold none are the same objects."""
    out, open_ = list(texts), list(range(len(texts)))
    while open_:
        found = search_texts([out[d] for d in open_], blocks)
        open_ = [(d, s) for d, (_, s, *_) in zip(open_, found) if s]
        for d, s in open_:
            out[d] = remove_spans(out[d], s)
        open_ = [d for d, _ in open_]
    return out


def clean(text: Column, blocks: list) -> Column:
    """The text without any occurrence of a window, those included that a removal brings about; null stays null."""

    @arrow_udf("string")
    def changed(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for some in sliced(texts):
            out += [new if new is not old else None for old, new in zip(some, cleaned(some, blocks))]
        return pa.array(out, pa.string())

    return F.coalesce(changed(text), text)  # only changed texts come back from Python
