"""Line dedup: an exact set-similarity join over lines, in DataFrame functions only.

A line's tokens are its distinct five-word shingles (64-bit hashes); a line of one to four words has one token, its whole
word sequence. Two lines match at Jaccard >= 0.8; a line is removed if an earlier one matches it, removed or not. Lines are in
order of (id, row, line number), where the rows of one id are told apart and ordered by a digest of their text.

Lines with equal token sets are one class from the start (a 128-bit hash), so copies are never paired. Matching sets of
nx and ny tokens share a token within the first n - ceil(0.8 n) + 1 of any common order. How rare a token is is measured in two
steps, so that not every token of the corpus is counted:

1. Every class posts its prefix in hash order. Tokens that only one class posts fall away; those of up to `FEW` classes are rare
   enough to pair their holders; of a commoner token, holders are dealt by length (a match differs by a fifth at most)
   and paired where few are together.
2. The classes left in larger groups are ordered by rarity: all their tokens are counted, over all these classes, and the
   prefix is taken from the rarest up. Tokens of one class only come first and are posted nowhere. A pair that the first step
   misses has both classes here and shares only common tokens, so this order, used by both, is enough.

What is still common then (large families of near copies) meets the earliest holder first; classes that match it
are settled, and only the others look at all earlier holders. Candidates pass the length and positional filters, and two
prefixes in one order tell how many tokens of one set the other lacks at least. What passes is verified on whole sets.

Defined results: lines without a word always stay; null texts stay null; rows with a null id stay as they are and are
compared with none; rows with equal id and equal text are one row (they lose the same lines, not each other's). A document
of removed lines has an empty text. Other columns, whatever their names, pass unchanged. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import written

SHINGLE = 5
#: A token, or a token at one length, with more classes than this is common: its holders are not paired up.
FEW = 16
#: Rows that may be broadcast, under 150 MB as a hash table; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
PLACE = ("id", "rk", "line")


def row_key(text: Column) -> Column:
    """60 bits of the text's digest: tells rows of one id apart."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _words(line: Column) -> Column:
    """Lower-cased words; most lines need no more than a split at single blanks."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for found in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd |= F.contains(line, F.lit(found))
    return F.when(odd, F.array_remove(F.split(F.regexp_replace(F.lower(line), r"[\x09-\x0D]", " "), " "), "")).otherwise(F.split(F.lower(line), " "))


def _once(value: Column) -> Column:
    """A generator of the one value, so that it is computed once however often it is used."""
    return F.explode(F.array(value))


def _tokenised(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens) of (keys, s): the distinct tokens of each line with a word, in hash order."""
    words = lines.where("s != ''").select(*keys, _once(_words(F.col("s"))).alias("words")).where(F.size("words") > 0)
    hashed = words.select(*keys, _once(F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
    shingles = F.slice(F.transform("h", lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, SHINGLE)))), F.lit(1), F.size("h") - (SHINGLE - 1))
    tokens = F.when(F.size("h") >= SHINGLE, shingles).otherwise(F.array(F.xxhash64("h")))
    return hashed.select(*keys, _once(F.sort_array(F.array_distinct(tokens))).alias("tokens"))


def _class() -> tuple[Column, Column]:
    """The class: two hashes of the token set."""
    return F.xxhash64("tokens").alias("c"), F.xxhash64(F.lit(1), F.col("tokens")).alias("d")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _is_row(text: Column, key: Column) -> Column:
    """Whether a text has this row key; no equality of two columns, so that a join on the id comes first and digests few texts."""
    return row_key(text) - key == 0


def _needed(n: str) -> Column:
    """ceil(0.8 n)"""
    return F.expr(f"(4 * {n} + 4) div 5").cast("int")


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """For broadcast if its rows are few; with a column of lists, what these hold is counted, too."""
    size = df.agg(F.count("*") + F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0] if lists else df.count()
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rk, line, c, d, n, prefix) of each line with a word; sets under four tokens match equal ones only and post nothing."""
    rows = _rows(docs, id_col, text_col).select("id", row_key(F.col("text")).alias("rk"), F.split("text", "\n").alias("lines"))  # beside the generator they would be computed for each line
    lines = rows.select("id", "rk", F.posexplode("lines").alias("line", "s"))
    n = F.size("tokens")
    return _tokenised(lines, *PLACE).select(*PLACE, *_class(), n.alias("n"), F.when(n > 3, F.slice("tokens", 1, n - _needed("size(tokens)") + 1)).alias("prefix"))


def _near(a: str, b: str) -> Column:
    """The length and positional filters on posts of one token (positions from 1, tokens before may be shared too)."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")) + F.least(F.col(f"{a}.pos"), F.col(f"{b}.pos"))
    return (5 * F.least(f"{a}.n", f"{b}.n") >= 4 * F.greatest(f"{a}.n", f"{b}.n")) & (9 * most >= 4 * n)


def _enough(px: str, py: str, nx: str, ny: str, x_ends_first: Column, alone_x: Column, alone_y: Column) -> Column:
    """Whether two prefixes in one order leave a match possible; `alone` counts tokens before them that no other set has.

    What the prefix that ends first has and the other one lacks, the other set lacks.
    """
    shared = F.size(F.array_intersect(px, py))
    least = F.expr(f"(4 * ({nx} + {ny}) + 8) div 9").cast("int")
    lacks = F.when(x_ends_first, F.size(px) + alone_x - F.col(nx)).otherwise(F.size(py) + alone_y - F.col(ny)) - shared
    return lacks <= -least


def _alike(a: str, b: str, posts: DataFrame) -> Column:
    """All filters that the posts have columns for."""
    if "prefix" not in posts.columns:
        return _near(a, b)
    ends_first = F.col(f"{a}.last") <= F.col(f"{b}.last")
    return _near(a, b) & _enough(f"{a}.prefix", f"{b}.prefix", f"{a}.n", f"{b}.n", ends_first, F.col(f"{a}.alone"), F.col(f"{b}.alone"))


def _paired(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of classes that share a rare token, and the posts (and g) of common tokens at common lengths.

    `posts` has (token, c, n, pos), each once, and may have (alone, last, prefix). `g` groups holders of a token by length: those of
    one power of 5/4 and of the next.
    """
    more_columns = [c for c in ("alone", "last", "prefix") if c in posts.columns]
    common = written(posts.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > FEW).select("token"))
    few = posts.join(_small(common), "token", "left_anti")
    x, y = F.col("a.c").alias("x"), F.col("b.c").alias("y")
    pairs = few.alias("a").join(few.alias("b"), F.col("a.token") == F.col("b.token")).where((F.col("a.c") < F.col("b.c")) & _alike("a", "b", posts)).select(x, y)
    length = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int")
    dealt = posts.join(_small(common), "token", "left_semi").select("token", "c", "n", "pos", *more_columns, F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("g", length - F.col("up"))
    dealt = written(dealt)
    sizes = dealt.groupBy("token", "g").agg(F.count("*").alias("k"), F.min("up").alias("own")).where("k > 1 and own = 0")
    crowds = written(sizes.where(F.col("k") > FEW).select("token", "g"))
    sparse, crowd = (dealt.join(_small(crowds), ["token", "g"], how) for how in ("left_anti", "left_semi"))
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.g") == F.col("b.g"))
    own = (F.col("a.up") == 0) & ((F.col("b.up") == 1) | (F.col("a.c") < F.col("b.c"))) & (F.col("a.c") != F.col("b.c"))
    more = sparse.alias("a").join(sparse.alias("b"), same).where(own & _alike("a", "b", posts)).select(x, y)
    each = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    return written(pairs.union(more).select(*each).distinct()), crowd


def _lacking(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (x, y) whose prefixes in hash order do not rule a match out."""
    side = lambda s: prefixes.select(F.col("c").alias(s), F.col("n").alias("n" + s), F.col("prefix").alias("p" + s))
    return pairs.join(side("x"), "x").join(side("y"), "y").where(_enough("px", "py", "nx", "ny", F.element_at("px", -1) <= F.element_at("py", -1), F.lit(0), F.lit(0))).select("x", "y")


def _token_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(c, d, first, n, tokens) of the wanted classes (c, d, first), from the lines where they stand first.

    Only rows that stand more than once give a class more than once; those are told apart by counting and reduced.
    """
    at = written(wanted.groupBy(F.col("first.id").alias("__id"), F.col("first.rk").alias("__rk")).agg(F.collect_list(F.struct("c", "d", "first")).alias("at")))
    rows = _rows(docs, id_col, text_col).join(_small(at, "at"), (F.col("id") == F.col("__id")) & _is_row(F.col("text"), F.col("__rk")))
    lines = rows.select(F.split("text", "\n").alias("lines"), "at").select("lines", F.explode("at").alias("at")).select("at.*", F.get("lines", F.col("at.first.line")).alias("s"))
    sets = written(_tokenised(lines, "c", "d", "first").select("c", "d", "first", F.size("tokens").alias("n"), "tokens"))
    again = written(sets.groupBy("c", "d").agg(F.count("*").alias("k")).where("k > 1").select("c", "d"))
    if again.isEmpty():
        return sets
    again = _small(again)
    return written(sets.join(again, ["c", "d"], "left_anti").unionByName(sets.join(again, ["c", "d"], "left_semi").dropDuplicates(["c", "d"])))


def _matching(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, d): the later class of each pair (x, y) that matches on whole sets."""
    pairs = written(pairs)
    wanted = lambda s: sets.join(_small(written(pairs.select(F.col(s).alias("c")).distinct())), "c", "left_semi")
    side = lambda s: wanted(s).select(F.col("c").alias(s), *(F.col(k).alias(k + s) for k in ("d", "first", "n", "tokens")))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(9 * F.size(F.array_intersect("tokensx", "tokensy")) >= 4 * (F.col("nx") + F.col("ny")))
    later = F.when(F.col("firstx") > F.col("firsty"), F.struct(F.col("x").alias("c"), F.col("dx").alias("d"))).otherwise(F.struct(F.col("y").alias("c"), F.col("dy").alias("d")))
    return written(both.select(later.alias("k")).select("k.*").distinct())


def _by_rarity(sets: DataFrame) -> DataFrame:
    """Posts (token, c, n, pos, alone, last, prefix) of each class, tokens ordered by how many of these classes hold them."""
    each = sets.select("c", "d", "n", F.explode("tokens").alias("token"))
    counts = written(each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    shared = each.join(_small(counts), "token").groupBy("c", "d", "n").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")  # tokens of this class only: rarest, and no partner's
    taken = shared.select("c", "n", alone.alias("alone"), F.slice("shared", 1, F.greatest(F.col("n") - _needed("n") + 1 - alone, F.lit(0))).alias("prefix"))
    tokens = F.transform("prefix", lambda t: t["token"])
    each = taken.select("c", "n", "alone", F.element_at("prefix", -1).alias("last"), tokens.alias("prefix")).where(F.size("prefix") > 0)
    return each.select("c", "n", "alone", "last", "prefix", F.posexplode("prefix").alias("i", "token")).select("token", "c", "n", (F.col("alone") + F.col("i") + 1).alias("pos"), "alone", "last", "prefix")


def _families(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, d) of later classes among posts (and g) of tokens that stay common in order of rarity."""
    crowd = written(crowd.join(sets.groupBy("c").agg(F.min("first").alias("first")), "c"))
    hub = crowd.groupBy("token", "g").agg(F.min_by(F.struct("c", "n", "pos", "alone", "last", "prefix"), "first").alias("e")).select("token", "g", "e.*")
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.c") != F.col("b.c")) & _alike("a", "b", crowd)
    x, y = F.col("a.c").alias("x"), F.col("b.c").alias("y")
    settled = _matching(crowd.alias("a").join(hub.alias("b"), same).select(x, y).distinct(), sets)
    open_ = crowd.join(_small(settled.select("c").distinct()), "c", "left_anti")
    more = open_.alias("a").join(crowd.alias("b"), same & (F.col("b.first") < F.col("a.first"))).select(x, y).distinct()
    return settled.union(_matching(more, sets))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rk, line) of every line that an earlier one matches, lines counted from 0; `rk` is the row's `row_key`."""
    sets = written(_sets(docs, id_col, text_col))
    posts = sets.select("c", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = written(posts.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a != z").select("token"))
    held = written(posts.join(_small(shared), "token").select("token", "c", "n", (F.col("pos") + 1).alias("pos")))
    held = written(held.distinct())  # copies fall together before their shuffle
    pairs, crowd = _paired(held)

    one = lambda s: pairs.select(F.col(s).alias("c"))
    prefixes = written(sets.join(_small(one("x").union(one("y")).distinct()), "c", "left_semi").groupBy("c").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    pairs = written(_lacking(pairs, prefixes))
    crowd = written(crowd.select("c").distinct())
    wanted = written(one("x").union(one("y")).union(crowd).distinct().withColumn("w", F.lit(True)))

    classes = sets.groupBy("c", "d").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("k"))
    classes = written(classes.join(_small(wanted), "c", "left").where("w or k > 1"))
    whole = _token_sets(docs, classes.where("w"), id_col, text_col)
    gone = _matching(pairs, whole)
    crowd = whole.join(_small(crowd), "c", "left_semi")
    pairs, families = _paired(written(_by_rarity(crowd)))
    gone = written(gone.union(_matching(pairs, crowd)).union(_families(families, crowd)).distinct().withColumn("gone", F.lit(True)))

    found = written(classes.join(gone, ["c", "d"], "left").where("gone or k > 1").select("c", "d", "first", "gone"))
    return sets.select(*PLACE, "c", "d").join(_small(found), ["c", "d"]).where(F.col("gone").isNotNull() | (F.struct(*PLACE) != F.col("first"))).select(*PLACE)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later matching lines taken out of the text column."""
    gone = written(removed_lines(docs, id_col, text_col).groupBy(F.col("id"), F.col("rk")).agg(F.collect_set("line").alias("gone")))
    rows = docs.select(F.struct("*").alias("row"))  # so that no name clashes
    text = F.col(f"row.`{text_col}`")
    joined = rows.join(_small(gone, "gone"), (F.col(f"row.`{id_col}`") == F.col("id")) & _is_row(text, F.col("rk")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(*((F.when(F.col("gone").isNull(), text).otherwise(kept) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
