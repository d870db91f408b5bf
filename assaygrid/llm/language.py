"""Language identification by prediction by partial matching.

For each language a byte context tree of order three is counted: how often each byte follows each context of
three, two, one and no bytes. A text is charged the exact number of bits that each language's frozen tree would code it in: a
byte seen after the longest known context costs -log2 n / (T + q), else the escape -log2 q / (T + q) (T: counts,
q: different bytes after the context) and the next shorter context; the last resort is one in 256. The least code
length wins; the score is its share of the languages' likelihoods.

Trees are learned from a bounded sample: `bound` documents a language, picked by a hash of the id. A byte's cost depends on
four bytes only, so a task charges each different four bytes once and sums over positions. Scoring covers whole texts.

Defined results: null texts and texts without a letter (Unicode categories L*; numerals and marks are none) are `und` with score 0; ties go to the language that sorts
first; with no training rows all are `und`; rows with a null language or text teach nothing, nor, in the op7 query, do rows with
a null id, which are scored and not held out. Rows that repeat both id and text are sampled together. More than `LANGUAGES` different
languages are an error, as trees are broadcast: the bound on the sample and this one bound their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

ORDER, BOUND, CHUNK, LANGUAGES = 3, 1200, 1 << 21, 500
LETTER = regex.compile(r"\p{L}")


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the lower-cased texts with the three before it (blanks before a text) as a number; bytes by text."""
    data = [b"   " + t.lower().encode() for t in texts]
    sizes = np.array([len(d) - ORDER for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(flat) <= ORDER:
        return np.zeros(0, np.uint32), sizes
    every = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    own = np.ones(len(every), bool)
    starts = np.cumsum(sizes + ORDER)[:-1]
    for k in range(1, ORDER + 1):
        own[starts - k] = False
    return every[own], sizes


class Tree:
    """Frozen statistics of one language: bits of each four bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            keys, at = np.unique(grams & mask, return_inverse=True)
            n = np.bincount(at, weights=counts)
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(at, weights=n), np.bincount(at)
            self.levels.append((mask, keys, np.log2((total + kinds)[at] / n), contexts, np.log2((total + kinds) / kinds)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        cost, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for mask, keys, price, contexts, escape in self.levels:
            g = grams[open_] & mask
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            seen = keys[at] == g
            cost[open_[seen]] += price[at[seen]]
            open_, g = open_[~seen], g[~seen] >> 8
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            cost[open_] += np.where(contexts[at] == g, escape[at], 0.0)
        cost[open_] += 8.0
        return cost


def learn(docs: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Tree]:
    """A tree for each language of the rows given."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not sizes:
        return {}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    pick = F.lit(0)
    for lang, n in sizes.items():
        pick = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, bound / n) * (1 << 60)))).otherwise(pick)
    sample = rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 60)) < pick).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            langs, texts = np.array(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
            for lang in sorted(set(langs)):
                grams, n = np.unique(codes([texts[k] for k in np.flatnonzero(langs == lang)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, grams, n = np.array(counted["lang"].to_pylist(), object), counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy()
    return {lang: Tree(grams[langs == lang], n[langs == lang]) for lang in sorted(set(langs))}


def charge(texts: list[str], trees: dict[str, Tree]) -> np.ndarray:
    """Bits of each text (rows) under each language."""
    grams, sizes = codes(texts)
    out = np.zeros((len(texts), len(trees)))
    owner, begin = np.repeat(np.arange(len(texts)), sizes), 0
    for begin in range(0, len(grams), CHUNK):
        keys, at = np.unique(grams[begin : begin + CHUNK], return_inverse=True)
        who = owner[begin : begin + CHUNK]
        for k, tree in enumerate(trees.values()):
            out[:, k] += np.bincount(who, weights=tree.bits(keys)[at], minlength=len(texts))
    return out


def identify(text: Column, trees) -> Column:
    """struct<lang, score>; `trees` is a broadcast of learn()."""

    @arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        known = trees.value
        names = list(known)
        out: list[dict] = [{"lang": "und", "score": 0.0}] * len(texts)
        part: list[int] = []
        size = 0

        def flush():
            bits = charge([texts[d].as_py() for d in part], known)
            best = bits.argmin(1)
            share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 60)).sum(1)
            for d, b, s in zip(part, best, share):
                out[d] = {"lang": names[b], "score": float(s)}
            part.clear()

        for d, t in enumerate(texts):
            s = t.as_py()
            if names and s and LETTER.search(s):
                part.append(d)
                size += len(s)
                if size >= CHUNK:
                    flush()
                    size = 0
        if part:
            flush()
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return of(text)
