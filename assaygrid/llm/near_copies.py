"""Near copies of documents: deletion-variant SimHash, and an exact check at Jaccard >= 0.8 of five-word shingles.

First, documents that can match none are set aside (`_open_classes`): a match has at least ceil(0.8 n) of a set's n tokens, so a set with more than
n - ceil(0.8 n) tokens that no other set holds is left alone. That is counted on a share of the hash space, the same for all documents, and then on
whole sets of those it leaves; once more whenever a count has left less than half of the sets. A passage that many otherwise different documents share makes no pair of them.

Every other document has a SimHash fingerprint of its shingles. Documents whose fingerprints are equal or share a deletion variant and
differ by at most two bits are candidates, and whole sets decide (`_printed`). Fingerprints alone miss pairs: at similarity 0.8
those of two documents differ by ten bits or so, and keys that find all such pairs are shared by most documents. So an
exact way follows for the rest, documents that SimHash has not brought into one component: as in line_dedup, two sets that match share a token in the first
n - ceil(0.8 n) + 1 of a fixed order, here: from the token that fewest of the remaining sets hold up (`_by_rarity`). Its candidates must be
near enough in length, have enough tokens left after the shared one, bitmaps that leave enough overlap and prefixes that do not show too
many tokens of one set to be missing in the other; whole sets decide.

Documents with equal sets are one class from the start: by 128 bits of hash, the first half of which (`cid`) names the class;
where two classes would share a name, both get another. Only a class's first document posts tokens. Tokens whose holders are all in
one component by SimHash are settled. Holders of the others meet the shortest class that holds the token first; tokens whose holders are not
in one component then either pair all their holders of different components. So large families of copies are not paired up, and no component is missed.

Defined results: words are split and lower-cased as in simhash; fewer than five words are one shingle; null, empty and
white-space texts have none and are copies of each other. Rows with a null id stay and are compared with none. Rows
that repeat an id stay or go together. Extra columns are not read and do not clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from .line_dedup import _enough, _needed, _small
from .shared import cut, written
from .simhash import BLOCK, components, links, majority, without

SHINGLE = 5
#: Hash buckets in which tokens are counted; a bucket is full, and its tokens pass for shared, at so many times the mean plus five of its standard deviations.
BUCKETS, FULL = 1 << 16, 1.25
#: Share of the hash space in which tokens of one set only are counted: over 0.2, or no set would be left alone.
COUNTED = 0.35
#: Values of arrays that may be broadcast, 32 MB of them.
BROADCAST = 4_000_000
#: Bits of a class's bitmap: each token flips one, so two sets differ in at least as many tokens as bits.
BITS = 2048
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def tokens_of(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, width = xxhash.xxh64_intdigest, min(SHINGLE, len(words))
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _ODD[k]
    out = (out ^ (out >> np.uint64(33))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two halves of 128 bits."""
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def print_of(tokens: np.ndarray) -> int:
    """The SimHash of a set: bits set in over half of its hashes."""
    return majority((tokens[at : at + BLOCK] for at in range(0, len(tokens), BLOCK)), len(tokens))


def _bucket_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(b, n): documents' tokens by hash bucket."""

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch[0]:
                np.add.at(n, (tokens_of(t.as_py()) % np.uint64(BUCKETS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], ["b", "n"])

    return docs.select(text_col).mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))


def _described(text: Column, full: list[int]) -> Column:
    """struct<cid, did, n, fp, bits, counted>: the class, its number of tokens, their SimHash and bitmap, and those tokens in the counted share of the hash space that are in no full bucket."""
    often, end = np.zeros(BUCKETS, bool), np.uint64(int(COUNTED * 2**64))
    often[full] = True

    @arrow_udf("struct<cid:long,did:long,n:int,fp:long,bits:array<long>,counted:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        cids, dids, ns, fps, bits, counted = [], [], [], [], [], []
        for x in texts:
            tokens = tokens_of(x.as_py())
            first = tokens[: np.searchsorted(tokens, end)]
            c, d = class_of(tokens)
            cids.append(c)
            dids.append(d)
            ns.append(len(tokens))
            fps.append(print_of(tokens))
            odd = np.bincount(((tokens >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
            bits.append(np.packbits(odd.astype(bool)).view(np.int64))
            counted.append(first[~often[(first % np.uint64(BUCKETS)).astype(np.int64)]].view(np.int64))
        return pa.StructArray.from_arrays([pa.array(cids, pa.int64()), pa.array(dids, pa.int64()), pa.array(ns, pa.int32()), pa.array(fps, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(counted, pa.list_(pa.int64()))], ["cid", "did", "n", "fp", "bits", "counted"])

    return of(text)


def _whole(text: Column) -> Column:
    """struct<did, tokens>: half of the class's hash and the whole set."""

    @arrow_udf("struct<did:long,tokens:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [tokens_of(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([class_of(s)[1] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["did", "tokens"])

    return of(text)


def _beside(pairs: DataFrame, of: DataFrame, size: Column) -> DataFrame:
    """The pairs (a, b, ...) with the other columns of `of` (cid, ...) for both sides, these being named after the sides.

    `size` is what a row of `of` holds; in all few of them are broadcast.
    """
    of = written(of)
    whole = of.agg(F.sum(size)).first()[0] or 0
    side = lambda s: of.select(F.col("cid").alias(s), *(F.col(c).alias(c + s) for c in of.columns if c != "cid"))
    held = (lambda df: F.broadcast(df)) if whole <= BROADCAST else (lambda df: df)
    return pairs.join(held(side("a")), "a").join(held(side("b")), "b")


def _sets_of(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, t): the whole sets of the classes."""
    ids = written(classes.select(F.col("first").alias("__id"), F.col("cid").alias("__cid"), F.col("did").alias("__did")))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(_small(ids), F.col("id") == F.col("__id"))
    sets = written(found.select("__cid", "__did", _whole(F.col("text")).alias("s")))  # before the filter, which Spark would else apply to every document
    return sets.where(F.col("s.did") == F.col("__did")).select(F.col("__cid").alias("cid"), F.col("s.tokens").alias("t")).dropDuplicates(["cid"])


def _matching(near: DataFrame, docs: DataFrame, classes: DataFrame, own: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of candidate pairs that pass the length and position filters and match on whole sets."""
    after = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # of the order, the shared token included
    pairs = written(near.where((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * (after + F.least("pa", "pb")) >= 4 * (F.col("na") + F.col("nb"))))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("n")).distinct())
    wanted = lambda of, pairs: of.join(_small(written(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())), "cid", "left_semi")
    odd = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = written(_beside(pairs, wanted(classes, pairs).select("cid", "bits"), F.size("bits")).where(9 * odd <= F.col("n")).select("a", "b"))

    ends_first = F.col("lasta") <= F.col("lastb")
    pairs = written(_beside(pairs, wanted(own, pairs), F.size("prefix")).where(_enough("prefixa", "prefixb", "na", "nb", ends_first, F.col("alonea"), F.col("aloneb"))).select("a", "b"))

    sets = _sets_of(wanted(classes, pairs), docs, id_col, text_col)
    return written(_beside(pairs, sets, F.size("t")).where(9 * F.size(F.array_intersect("ta", "tb")) >= 4 * (F.size("ta") + F.size("tb"))).select("a", "b"))


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with one `cid` for each class and no other, and (cid, did, first, n, fp, bits, k) of the classes."""
    while True:
        found = written(sets.groupBy("cid").agg(F.min("did").alias("did"), F.max("did").alias("other"), F.min("id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.count("*").alias("k")))
        shared = written(found.where("did != other").select("cid", F.lit(True).alias("shared")))
        if shared.isEmpty():
            return sets, found.drop("other")
        sets = written(sets.join(_small(shared), "cid", "left").withColumn("cid", F.when(F.col("shared"), F.xxhash64("cid", "did")).otherwise(F.col("cid"))).drop("shared"))


def _open_classes(own: DataFrame, tokens: Column) -> DataFrame:
    """The rows of `own` (cid, n, ...), one a class, but those with more tokens of their own than a match leaves; `tokens` are those that count."""
    own = written(own)
    left = own.count()
    while True:
        posts = own.select("cid", F.explode(tokens).alias("token"))
        alone = posts.groupBy("token").agg(F.min("cid").alias("cid"), F.max("cid").alias("hi")).where("cid = hi").groupBy("cid").agg(F.count("*").alias("alone"))
        own = written(own.join(alone, "cid", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - _needed("n")).drop("alone"))
        before, left = left, own.count()
        if 2 * left >= before:
            return own


def _by_rarity(sets: DataFrame) -> DataFrame:
    """(cid, n, alone, last, prefix) of sets (cid, n, t): the first tokens in order of how many of the sets hold them, but for the `alone` ones that no other set holds; `last` is the last one's place in that order."""
    each = sets.select("cid", "n", F.explode("t").alias("token"))
    counts = written(each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    shared = each.join(_small(counts), "token").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("shared")).withColumn("alone", F.col("n") - F.size("shared"))
    taken = shared.select("cid", "n", "alone", F.slice("shared", 1, F.greatest(F.col("n") - _needed("n") + 1 - F.col("alone"), F.lit(0))).alias("first")).where(F.size("first") > 0)
    return written(taken.select("cid", "n", "alone", F.element_at("first", -1).alias("last"), F.transform("first", lambda x: x["token"]).alias("prefix")))


def _printed(classes: DataFrame) -> DataFrame:
    """Candidates (a, na, pa, b, nb, pb) by SimHash: classes of one fingerprint with the least of them, and these where fingerprints link."""
    one = written(classes.groupBy("fp").agg(F.min(F.struct("cid", "n")).alias("e"), F.count("*").alias("k")))
    side = lambda of, s, fp: of.select(F.col("fp").alias(fp), F.col("e.cid").alias(s), F.col("e.n").alias("n" + s), F.lit(0).alias("p" + s))
    alike = written(one.where("k > 1"))
    equal = classes.select("fp", F.struct("cid", "n").alias("e")).join(_small(alike.select("fp")), "fp", "left_semi")
    equal = side(equal, "a", "fp").join(_small(side(alike, "b", "fp")), "fp").where("a != b").drop("fp")
    found = written(links(one.select("fp")))
    ends = written(one.join(_small(written(found.select(F.col("a").alias("fp")).union(found.select("b")).distinct())), "fp", "left_semi"))
    close = found.toDF("fa", "fb").join(_small(side(ends, "a", "fa")), "fa").join(_small(side(ends, "b", "fb")), "fb")
    return equal.unionByName(close.drop("fa", "fb"))


def _open(held: DataFrame, found: DataFrame) -> DataFrame:
    """Posts (token, cid, n, pos, root) of tokens whose holders are not all in one component of the pairs found."""
    roots = written(components(found))
    rooted = held.join(_small(roots), held.cid == roots.node, "left").select("token", "cid", "n", "pos", F.coalesce("root", "cid").alias("root"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    return written(rooted.join(mixed, "token"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with an id: id and `component_id`, the smallest id reachable over pairs at Jaccard >= 0.8."""
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    counts = cut(_bucket_counts(docs, text_col))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    full = [r.b for r in counts.where(F.col("n") > FULL * mean + 5 * mean**0.5 + 16).select("b").collect()]  # fewer than BUCKETS
    sets = written(docs.select(F.col(id_col).alias("id"), _described(F.col(text_col), full).alias("s")).select("id", "s.*"))
    sets, classes = _classes(sets)

    copied = written(classes.where("k > 1").select("cid", "first"))
    own = sets.join(_small(copied), "cid", "left").where("first is null or id = first").select("cid", "n", "counted").dropDuplicates(["cid"])
    own = _open_classes(own, F.col("counted"))
    whole = _sets_of(classes.join(_small(own.select("cid")), "cid", "left_semi"), docs, id_col, text_col)
    own = _by_rarity(_open_classes(whole.select("cid", F.size("t").alias("n"), "t"), F.col("t")))
    kept = written(classes.join(_small(own.select("cid")), "cid", "left_semi"))
    posts = own.select("cid", "n", "alone", F.posexplode("prefix").alias("i", "token")).withColumn("pos", F.col("alone") + F.col("i"))
    shared = written(posts.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo != hi").select("token"))
    held = written(posts.join(_small(shared), "token").select("token", "cid", "n", "pos"))

    found = _matching(_printed(kept), docs, kept, own, id_col, text_col)
    open_ = _open(held, found)
    side = lambda s: open_.select("token", F.col("cid").alias(s), F.col("n").alias("n" + s), F.col("pos").alias("p" + s), F.col("root").alias("r" + s))
    hub = open_.groupBy("token").agg(F.min(F.struct("n", "cid", "pos", "root")).alias("e")).select("token", F.col("e.cid").alias("b"), F.col("e.n").alias("nb"), F.col("e.pos").alias("pb"), F.col("e.root").alias("rb"))
    found = found.union(_matching(side("a").join(hub, "token").where("ra != rb"), docs, kept, own, id_col, text_col))
    open_ = _open(held, found)
    more = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")))
    roots = written(components(found.union(_matching(more, docs, kept, own, id_col, text_col))))
    of = written(classes.join(_small(roots), classes.cid == roots.node, "left").select("cid", "first", "k", F.coalesce("root", "cid").alias("root")))
    named = of.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("k").alias("all"))
    joined = written(of.join(named.where(F.col("all") > 1), "root").select("cid", "component_id"))  # classes of documents that stand alone need no join
    return sets.select("id", "cid").join(_small(joined), "cid", "left").select(F.col("id").alias(id_col), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the smallest id of each group of near copies; columns as given."""
    found = near_duplicates(docs, id_col, text_col)
    return without(docs, found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct(), id_col)
