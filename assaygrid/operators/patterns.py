"""Relational patterns over facts and their ranking. A pattern is a conjunction of facts about a gene with constants."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from assaygrid.functions.scalars import occurrences, specificity
from assaygrid.operators.staging import small, staged, written
from assaygrid.operators.texts import contained


def profile(*parts: Column) -> Column:
    """Parts joined by _; null if any part is."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("_"), p)
    return joined


def profiles(phenotypes: DataFrame) -> DataFrame:
    """(gene, profile), distinct; a null profile is one member."""
    return phenotypes.select("gene", profile(F.col("state"), F.col("value"), F.col("cond")).alias("profile")).distinct()


def greedy_cover(sets: DataFrame, n: int) -> DataFrame:
    """(step, gene, gain): the gene that adds most new profiles, ties by name, until n genes are taken or none is left.

    A null profile is one more member. The driver sees one row a step; every eighth step is written.
    """
    kind = dict(sets.dtypes)["gene"]
    left, picked = staged(sets.select("gene", F.col("profile").isNull().alias("none"), F.coalesce("profile", F.lit("")).alias("profile")).distinct()), []
    genes = staged(left.select("gene").distinct())
    for step in range(1, n + 1):
        best = left.groupBy("gene").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "gene").first()
        if best is None:
            break
        picked.append((step, best.gene, best.gain))
        covered = left.where(F.col("gene") == F.lit(best.gene)).select("none", "profile")
        left = left.join(covered, ["none", "profile"], "left_anti")
        left = staged(left) if step % 8 == 0 else left
    out = sets.sparkSession.createDataFrame(picked, f"step int, gene {kind}, gain long")
    rest = genes.join(out, "gene", "left_anti").orderBy("gene").limit(n - len(picked))  # these add nothing
    at = F.row_number().over(Window.orderBy("gene")) + len(picked)
    return out.union(rest.select(at.alias("step"), "gene", F.lit(0).cast("long").alias("gain")))


TEMPLATES = {
    "state": ("state",), "state_cond": ("state", "cond"), "state_value": ("state", "value"), "state_value_cond": ("state", "value", "cond"),
}


def shared_coverage(phenotypes: DataFrame, targets: DataFrame, pathways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pattern_id, cover), (cover, gene)): all bodies over the declared templates with their constants, and the genes of each cover, once.

    Bodies on targets say only which values they take, so those with the same values share one cover: the rows grow with the
    genes' facts and the targets, not with their product. A cover that no gene satisfies has no row.
    """
    named = lambda name, cols: F.concat_ws("|", F.lit(name), *(F.col(c).cast("string") for c in cols))
    facts = written(phenotypes.select("gene", "state", "value", "cond").distinct())
    by_gene = facts.repartition("gene")  # what is distinct by gene and pattern needs no further exchange
    plain = by_gene.select("gene", F.explode(F.array(*(named(name, cols) for name, cols in TEMPLATES.items()))).alias("cover")).distinct()
    metabolites = pathways.select("gene", "metabolite").distinct()
    plain = plain.unionByName(metabolites.select("gene", named("pathway", ["metabolite"]).alias("cover")).distinct())
    plain = plain.unionByName(by_gene.select("gene", "state").distinct().join(metabolites, "gene").select("gene", named("state_pathway", ["state", "metabolite"]).alias("cover")).distinct())

    takes = targets.where("value is not null").select(named("target", ["gene", "action"]).alias("pattern_id"), "value")
    takes = takes.groupBy("pattern_id").agg(F.array_sort(F.collect_set("value")).alias("values")).withColumn("cover", F.concat(F.lit("values|"), F.to_json("values")))
    takes = written(takes)
    asked = takes.select("cover", "values").dropDuplicates(["cover"]).select("cover", F.explode("values").alias("value"))
    met = by_gene.select("gene", "value").distinct().join(small(asked), "value").select("gene", "cover").distinct()
    rows = written(plain.unionByName(met).select("cover", "gene"))
    patterns = rows.where(~F.startswith("cover", F.lit("values|"))).select("cover").distinct().select(F.col("cover").alias("pattern_id"), "cover")
    return written(patterns.unionByName(takes.select("pattern_id", "cover"))), rows


def coverage(phenotypes: DataFrame, targets: DataFrame, pathways: DataFrame) -> DataFrame:
    """(pattern_id, gene): genes that satisfy each body, for all bodies over the declared templates with their constants."""
    patterns, rows = shared_coverage(phenotypes, targets, pathways)
    return rows.join(small(patterns), "cover").select("pattern_id", "gene")


def frequent(cover: DataFrame, positives: int, least: float = 0.001, most: int = 4097, once: bool = False) -> DataFrame:
    """(pattern_id, support) of patterns that enough genes satisfy, the best supported `most`. `once`: no row of `cover` is repeated."""
    n = F.count("gene") if once else F.count_distinct("gene")
    s = cover.groupBy("pattern_id").agg(n.alias("support")).where(F.col("support") >= least * positives)
    return s.orderBy(F.desc("support"), "pattern_id").limit(most)


def frequent_shared(patterns: DataFrame, rows: DataFrame, positives: int, least: float = 0.001, most: int = 4097) -> DataFrame:
    """`frequent` of a shared coverage: support is counted once a cover."""
    s = rows.groupBy("cover").agg(F.count("gene").alias("support")).where(F.col("support") >= least * positives)
    return patterns.join(s, "cover").select("pattern_id", "support").orderBy(F.desc("support"), "pattern_id").limit(most)


def bitmaps(cover: DataFrame) -> DataFrame:
    """(pattern_id, bucket, bits): each pattern's genes as bits, 32,768 genes a bucket; buckets without a gene of it are left out.

    Genes, a null one among them, are numbered once and the numbers are kept. Rows meet at (pattern, bucket) before they become bits, so a
    rare pattern costs its rows in the shuffle and not a bitmap a task. Repeated rows set the same bit.
    """
    cover = written(cover.select("pattern_id", "gene"))
    numbers = written(cover.select(F.col("gene").alias("of")).distinct().withColumn("number", F.monotonically_increasing_id()))
    keyed = cover.join(small(numbers), F.col("gene").eqNullSafe(F.col("of"))).select("pattern_id", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    return keyed.repartition("pattern_id", "bucket").groupBy("pattern_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def identical_groups(cover: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(pattern_id, duplicates): patterns with the same genes; the first is kept, the others listed.

    With `patterns`, `cover` is the coverage they share: its covers are compared, and all patterns of equal ones are listed.

    Patterns alike in counts and two order-free hash sums of their bitmaps are candidates; each is then compared bucket by bucket with
    its group's first, so no pattern's genes are gathered and no equality rests on a hash. Null genes are equal.
    """
    parts = written(bitmaps(cover if patterns is None else cover.withColumnRenamed("cover", "pattern_id")))
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "bucket", "bits").cast("decimal(38,0)"))
    prints = staged(parts.groupBy("pattern_id").agg(F.count("*").alias("m"), F.sum(F.bitmap_count("bits")).alias("n"), h(1).alias("a"), h(2).alias("b")))
    first = prints.groupBy("m", "n", "a", "b").agg(F.min("pattern_id").alias("first"))
    near = staged(prints.join(first, ["m", "n", "a", "b"]).select("pattern_id", "first", "m"))
    mine = near.where("pattern_id <> first").join(parts, "pattern_id")
    shared = mine.join(parts.toDF("first", "bucket", "bits"), ["first", "bucket", "bits"]).groupBy("pattern_id").agg(F.count("*").alias("k"))
    same = near.join(shared, "pattern_id", "left").withColumn("head", F.when((F.col("pattern_id") == F.col("first")) | (F.col("k") == F.col("m")), F.col("first")).otherwise(F.col("pattern_id")))
    if patterns is not None:
        same = same.select(F.col("pattern_id").alias("cover"), "head").join(patterns, "cover")
    return same.groupBy("head").agg(F.array_sort(F.collect_list("pattern_id")).alias("all")).select(F.get("all", F.lit(0)).alias("pattern_id"), F.array_join(F.slice("all", 2, F.size("all")), ",").alias("duplicates"))


def features_of(targets: DataFrame, cover: DataFrame) -> DataFrame:
    """Each target's gene with its patterns (left: genes without one stay)."""
    return targets.join(cover, "gene", "left")


#: Targets that a block of `features_of_shared` holds on average.
BLOCK = 512


def features_of_shared(targets: DataFrame, patterns: DataFrame, rows: DataFrame) -> DataFrame:
    """`features_of` a shared coverage, whose rows are targets times patterns; `rows` are computed.

    Targets are dealt out by gene to blocks of some hundred, and what is shuffled is a number for each cover and target. A block's targets of one
    cover are listed once and go out pattern by pattern: equal lists follow each other, so that a columnar file holds them in little more than one.
    """
    columns, n = targets.columns, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("gene"), F.lit(max(n, targets.count() // BLOCK)))
    numbers = written(rows.select("cover").distinct().withColumn("__number", F.monotonically_increasing_id()))
    met = rows.join(small(numbers), "cover").select("gene", "__number").join(small(targets), "gene").repartition(n, block % n)
    met = met.select(*columns, "__number", block.alias("__block"), (block % n).alias("__part")).sortWithinPartitions("__part", "__number", "__block")
    lists = met.groupBy("__part", "__number", "__block").agg(F.collect_list(F.struct(*columns)).alias("all"))
    texts = written(patterns.join(small(numbers), "cover").select("__number", "pattern_id"))
    found = lists.join(small(texts), "__number", "left").select(F.explode("all").alias("t"), "pattern_id").select(*(F.col(f"t.`{c}`") for c in columns), "pattern_id")
    return found.unionByName(targets.join(rows.select("gene").distinct(), "gene", "left_anti").select(*columns, F.lit(None).cast("string").alias("pattern_id")))


def good_targets(scores: DataFrame) -> DataFrame:
    """Targets whose mean cross-validated R2 is positive."""
    return scores.groupBy("target").agg(F.avg("r2").alias("r2")).where("r2 > 0")


def ranked(coefs: DataFrame, target: str, alpha: float) -> DataFrame:
    """(pattern_id, score, direction): patterns with weight for the target, by how specific the weight is."""
    t = F.max(F.when(F.col("target") == target, F.col("coef")))
    others = F.sum(F.when(F.col("target") != target, F.abs("coef")).otherwise(0.0))
    s = coefs.groupBy("pattern_id").agg(F.coalesce(t, F.lit(0.0)).alias("t"), others.alias("o")).where("t != 0")
    return s.select("pattern_id", specificity(F.col("t"), F.col("o"), alpha).alias("score"), F.when(F.col("t") > 0, "higher").otherwise("lower").alias("direction")).orderBy(F.desc("score"), "pattern_id")


def negative_controls(coefs: DataFrame) -> DataFrame:
    """(pattern_id, controls): targets that give the pattern no weight; patterns without one drop out."""
    return coefs.where("coef = 0").groupBy("pattern_id").agg(F.array_sort(F.collect_set("target")).alias("controls"))


def not_listed(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates (target, clause) whose target:clause is part of no listed line. A null target or clause is part of none."""
    key = F.concat("target", F.lit(":"), "clause")
    found = contained(candidates.select(key.alias("needle")), listed.select("line")).select("needle").distinct()
    return candidates.join(found, key == F.col("needle"), "left_anti")


def listed_lines(*lists: DataFrame) -> DataFrame:
    """One list out of several (forbidden, already used), lines trimmed, empty ones left out."""
    out = lists[0].select(F.trim("line").alias("line"))
    for x in lists[1:]:
        out = out.union(x.select(F.trim("line").alias("line")))
    return out.where("line <> ''").distinct()


def first_n(candidates: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n after all filters, in a stated order."""
    return candidates.orderBy(*order).limit(n)


def measurable(phenotypes: DataFrame, observables: list[str], chemicals: list[str], accumulation: str = "chemical compound accumulation") -> DataFrame:
    """Without unmeasurable observables and without accumulation of unmeasurable chemicals, by value; nulls stay."""
    bad = F.col("state").isin(observables) | ((F.col("state") == accumulation) & F.col("value").cast("string").isin(chemicals))
    return phenotypes.where(~F.coalesce(bad, F.lit(False)))


def kept_features(cover: DataFrame, kept: DataFrame) -> DataFrame:
    """Coverage rows of the kept patterns only."""
    return cover.join(kept.select("pattern_id"), "pattern_id", "left_semi")


def in_all_targets(coefs: DataFrame) -> DataFrame:
    """Coefficients of the patterns that every target has (the N-way inner merge in long form)."""
    n = coefs.agg(F.count_distinct("target").alias("n"))
    seen = coefs.groupBy("pattern_id").agg(F.count_distinct("target").alias("k")).join(F.broadcast(n)).where("k = n")
    return coefs.join(seen, "pattern_id", "left_semi")


def usable_lines(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line, text, feature) of a clause file's lines (key, line, text): a feature line goes with the support line before it.

    A line with two phenotype literals or more, or with a target literal but no metabolism literal, is dropped, and so is
    its support line; every other line stays once.
    """
    low = F.lower("text")
    bad = lambda c: (occurrences(c, F.lit("exhibits_phenotype")) > 1) | (F.contains(c, F.lit("compound_modulates_target")) & ~F.contains(c, F.lit("participates_in_metabolism")))
    w = Window.partitionBy(key).orderBy("line")
    is_feature = F.contains(F.col("text"), F.lit("feature("))
    ahead = F.lead("text").over(w)
    gone = F.when(is_feature, bad(low)).otherwise(F.coalesce(F.contains(ahead, F.lit("feature(")) & bad(F.lower(ahead)), F.lit(False)))
    return lines.withColumn("gone", gone).where("not gone").select(key, "line", "text", F.regexp_extract("text", r"feature\((\d+),", 1).try_cast("int").alias("feature"))


def readable_clauses(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern_id, clause): pattern <example>_ilp<number> meets the feature of that example and number; its head is renamed.

    `features` is (example, id, clause) as read from an explanation file.
    """
    pid = F.col("pattern_id")
    keyed = wanted.select("pattern_id", F.regexp_extract(pid, r"^(.*)_ilp(\d+)$", 1).alias("example"), F.regexp_extract(pid, r"^(.*)_ilp(\d+)$", 2).try_cast("int").alias("id"))
    return keyed.join(features, ["example", "id"]).select("pattern_id", F.replace("clause", F.lit("gene(A):-"), F.lit("Cell(A):-")).alias("clause"))


@dataclass(frozen=True)
class _Bodies:
    """One shape of clause bodies: `rows` (key, gene), none repeated, `texts` (key, pattern_id), and `counts` (key, n genes)."""

    rows: DataFrame
    texts: DataFrame
    counts: DataFrame


def _clause_bodies(phenotypes: DataFrame, names: DataFrame, conditions: DataFrame, targets: DataFrame, pathways: DataFrame, share: float) -> tuple[list[_Bodies], float]:
    """The shapes of `clause_cover`, and the genes a body needs. Facts are dealt out by gene, so nothing but them and counts is shuffled.

    What a fact satisfies depends on its state, value and cond only: bodies are made and numbered for these, and facts take the numbers.
    """
    facts = written(phenotypes.select("gene", "state", "value", "cond").distinct())
    least = share * facts.agg(F.count_distinct("gene")).first()[0]
    spot = ["state", "value", "cond"]
    text = lambda *c: F.concat_ws(",", *(F.col(x).cast("string") if isinstance(x, str) else x for x in c))
    lit, by_gene = F.lit, facts.repartition("gene")
    by_value = names.select("value", text(lit("name"), "name").alias("a")).union(targets.select("value", text(lit("target"), "action").alias("a"))).distinct()
    by_cond = conditions.select("cond", text(lit("condition"), "text").alias("a")).distinct()
    through = targets.select("value", "action", "through").join(pathways.select(F.col("gene").alias("through"), "kind", "metabolite").distinct(), "through")
    chains = through.select("value", text(lit("target"), "action", lit("pathway"), "kind", "metabolite").alias("a")).distinct()

    def bodies(rows: DataFrame, texts: DataFrame | None = None) -> _Bodies:
        """Without `texts`, a key holds its text's parts."""
        counts = written(rows.groupBy("key").agg(F.count("gene").alias("n")))
        return _Bodies(rows, texts or counts.select("key", F.concat_ws("&", *(f"key.{c}" for c in rows.schema["key"].dataType.names)).alias("pattern_id")), counts)

    def often(b: _Bodies) -> DataFrame:
        return b.counts.where(F.col("n") >= least).select("key")

    def on_facts(made: DataFrame, facts: DataFrame = by_gene) -> _Bodies:
        """Bodies given as (state, value, cond, pattern_id), repeats allowed; null is a value like others."""
        made = written(made)
        texts = written(made.select("pattern_id").distinct().withColumn("key", F.monotonically_increasing_id()))
        of = written(made.join(texts, "pattern_id").groupBy(*spot).agg(F.collect_set("key").alias("keys")))
        of = of.select("keys", *(F.col(c).alias(f"of_{c}") for c in spot))
        return bodies(facts.join(small(of), [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in spot]).select("gene", F.explode("keys").alias("key")).distinct(), texts)

    first = bodies(by_gene.where("state is not null").select("gene", F.struct(F.col("state").cast("string").alias("x")).alias("key")).distinct())
    known = written(often(first).select("key.x"))
    spots = written(facts.select(*spot).distinct().join(small(known), F.col("state").cast("string") == F.col("x"), "left_semi"))
    tails = written(spots.join(by_value, "value").select(*spot, "a").union(spots.join(by_cond, "cond").select(*spot, "a")).distinct())
    second = on_facts(tails.select(*spot, text("state", "a").alias("pattern_id")))
    alive = written(second.texts.join(often(second), "key", "left_semi"))
    two = written(tails.withColumn("pattern_id", text("state", "a")).join(small(alive.select("pattern_id")), "pattern_id", "left_semi").select(*spot, "a"))
    pairs = two.alias("x").join(two.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in spot]).where("x.a < y.a")
    pairs = on_facts(pairs.select(*(F.col(f"x.{c}").alias(c) for c in spot), F.concat_ws(",", F.col("x.state").cast("string"), "x.a", "y.a").alias("pattern_id")), by_gene.where("gene is not null"))
    chained = on_facts(spots.join(chains, "value").select(*spot, text("state", "a").alias("pattern_id")))

    own = first.rows.where("gene is not null").select("gene", "key.x").join(small(known), "x", "left_semi").groupBy("gene").agg(F.array_sort(F.collect_list("x")).alias("states"))
    couple = own.select("gene", "states", F.explode("states").alias("x")).select("gene", "states", "x", F.explode(F.filter("states", lambda y: y > F.col("x"))).alias("y"))
    couples = bodies(couple.select("gene", F.struct("x", "y").alias("key")))
    met = couple.join(small(written(often(couples).select("key.*"))), ["x", "y"], "left_semi")
    triples = bodies(met.select("gene", "x", "y", F.explode(F.filter("states", lambda z: z > F.col("y"))).alias("z")).select("gene", F.struct("x", "y", "z").alias("key")))
    with_state = second.rows.join(small(alive.select("key")), "key", "left_semi").join(own, "gene").select("gene", "key", F.explode("states").alias("y")).select("gene", F.struct(F.col("key").alias("x"), "y").alias("key"))
    beside = bodies(with_state)
    beside = replace(beside, texts=beside.counts.join(alive.select(F.col("key").alias("x"), F.col("pattern_id").alias("before")), F.col("key.x") == F.col("x")).select("key", F.concat_ws("&", "before", "key.y").alias("pattern_id")))
    return [first, second, couples, pairs, chained, beside, triples], least


def clause_support(phenotypes: DataFrame, names: DataFrame, conditions: DataFrame, targets: DataFrame, pathways: DataFrame, share: float = 0.001) -> DataFrame:
    """(pattern_id, support) of the bodies of `clause_cover`. Rows of genes are read only for texts that several shapes give."""
    shapes, least = _clause_bodies(phenotypes, names, conditions, targets, pathways, share)
    counted = written(reduce(DataFrame.union, [b.counts.join(b.texts, "key").select("pattern_id", "n") for b in shapes]))
    several = written(counted.groupBy("pattern_id").agg(F.count("*").alias("k")).where("k > 1").select("pattern_id"))
    single = counted.join(small(several), "pattern_id", "left_anti").where(F.col("n") >= least).select("pattern_id", F.col("n").alias("support"))
    if several.isEmpty():
        return single
    again = reduce(DataFrame.union, [b.rows.join(b.texts.join(several, "pattern_id", "left_semi"), "key").select("pattern_id", "gene") for b in shapes])
    return single.union(again.groupBy("pattern_id").agg(F.count_distinct("gene").alias("support")).where(F.col("support") >= least))


def clause_cover(phenotypes: DataFrame, names: DataFrame, conditions: DataFrame, targets: DataFrame, pathways: DataFrame, share: float = 0.001) -> DataFrame:
    """(pattern_id, gene) for every body of at most three literals over the declared modes that enough genes satisfy.

    Modes: phenotype(gene, #state, value, cond); name(value, #name); condition(cond, #text); target(value, #action, through);
    pathway(through, #kind, #metabolite). Literals hang on the phenotype whose value or cond they use. Bodies grow level by
    level, each level only from parents with at least `share` of all genes.
    """
    shapes, least = _clause_bodies(phenotypes, names, conditions, targets, pathways, share)
    rows = reduce(DataFrame.union, [b.rows.join(b.texts, "key").select("pattern_id", "gene") for b in shapes]).distinct()
    good = rows.groupBy("pattern_id").agg(F.count("gene").alias("n")).where(F.col("n") >= least)
    return rows.join(good.select("pattern_id"), "pattern_id", "left_semi")


def relevance(clauses: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight times occurrences of each word in the lower-cased clause, and the same for presence."""
    score, present = F.lit(0.0), F.lit(0.0)
    for word, w in weights.items():
        n = occurrences(F.col("clause"), F.lit(word))
        score, present = score + n * w, present + F.when(n > 0, w).otherwise(0.0)
    return clauses.withColumn("score", score).withColumn("present", present)


def best_clauses(dups: DataFrame, scores: DataFrame) -> DataFrame:
    """(pattern_id, best): of the listed duplicates the best scored, the earlier at a tie; the pattern itself if none is scored."""
    each = dups.select("pattern_id", F.posexplode("duplicates").alias("at", "clause")).join(scores, "clause")
    w = Window.partitionBy("pattern_id").orderBy(F.desc("score"), "at")
    top = each.withColumn("k", F.row_number().over(w)).where("k = 1").select("pattern_id", F.col("clause").alias("c"))
    return dups.join(top, "pattern_id", "left").select("pattern_id", F.coalesce("c", "pattern_id").alias("best"))


_ATOM = re.compile(r"\s*([a-z_]\w*)\((.*)\)\s*$", re.S)
#: A quoted text with escapes, `:-`, or one character.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|:-|.""", re.S)


def _pieces(text: str, at: str) -> list[str] | None:
    """The text cut at a mark that stands outside quotes and brackets; None where brackets or quotes do not close."""
    parts, depth = [""], 0
    for token in _TOKEN.findall(text):
        depth += (token in ("(", "[", "{")) - (token in (")", "]", "}"))
        if depth < 0 or token in ("'", '"'):
            return None
        if token == at and depth == 0:
            parts.append("")
        else:
            parts[-1] += token
    return parts if depth == 0 else None


def _unquoted(arg: str) -> str:
    arg = arg.strip()
    return re.sub(r"\\(.)", r"\1", arg[1:-1]) if len(arg) > 1 and arg[0] in "'\"" and arg[-1] == arg[0] else arg


def parse_clause(text: str | None):
    """(head, [(name, args)]) of `Head:-a(x),b(y)`; head None where there is no `:-`; None for text that is no clause."""
    sides = _pieces((text or "").strip().removesuffix("."), ":-")
    if not sides or len(sides) > 2 or not sides[-1].strip() or (len(sides) == 2 and not sides[0].strip()):
        return None
    atoms = []
    for part in _pieces(sides[-1], ",") or [""]:
        m = _ATOM.match(part)
        args = _pieces(m[2], ",") if m else None
        if args is None:
            return None
        atoms.append((m[1], [_unquoted(a) for a in args]))
    return (sides[0].strip() if len(sides) == 2 else None), atoms


def parse_clauses(clauses: DataFrame) -> DataFrame:
    """Adds `parsed`: struct<head, atoms: array<struct<name, args>>>, null where the text is no clause.

    Clauses whose atoms hold plain or quoted arguments (no inner bracket outside quotes, no backslash) are cut up by expressions in
    Catalyst; the others, and those of more than 4,000 characters, are parsed in Python, in Arrow batches.
    """

    @F.pandas_udf("struct<head:string,atoms:array<struct<name:string,args:array<string>>>>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        got = [parse_clause(t) for t in texts]
        return pd.DataFrame({"head": [g[0] if g else None for g in got], "atoms": [[{"name": n, "args": a} for n, a in g[1]] if g else None for g in got]})

    kind = "struct<head:string,atoms:array<struct<name:string,args:array<string>>>>"
    quoted = r"""'[^'\\]*+'|"[^"\\]*+\""""
    inside = rf"""(?:{quoted}|(?!:-)[^()\[\]{{}}'"\\])*+"""
    atom = rf"[a-z_]\w*\({inside}\)"
    body = F.regexp_replace(F.regexp_replace("clause", r"^\s+|\s+$", ""), r"\.$", "")
    shape = rf"""^\s*([A-Za-z_]\w*\([^()\[\]{{}}'"\\:]*\))\s*:-\s*({atom}(?:\s*,\s*{atom})*+)\s*$"""
    plain = F.coalesce((F.length("clause") <= 4000) & F.rlike(body, F.lit(shape)), F.lit(False))
    atoms = F.regexp_extract_all(F.regexp_extract(body, shape, 2), F.lit(f"({atom})"), F.lit(1))
    args = lambda a: F.regexp_extract_all(F.regexp_extract(a, r"(?s)^\w+\((.*)\)$", 1), F.lit(f"(?:^|,)((?:{quoted}|[^,'\"])*+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"""(?s)^(['"])(.*)\1$""", "$2")
    cut = F.transform(atoms, lambda a: F.struct(F.regexp_extract(a, r"^(\w+)", 1).alias("name"), F.transform(args(a), bare).alias("args")))
    fast = F.struct(F.regexp_extract(body, shape, 1).alias("head"), cut.alias("atoms")).cast(kind)
    p = parse(F.when(~plain, F.col("clause")))
    return clauses.withColumn("parsed", F.when(plain, fast).when(p["atoms"].isNotNull(), p))


def atom_count(parsed: Column, name: str) -> Column:
    return F.size(F.filter(parsed["atoms"], lambda a: a["name"] == name))


def usable(parsed: Column) -> Column:
    """At most one phenotype literal, and no target literal without a metabolism literal."""
    count = lambda n: atom_count(parsed, n)
    return (count("exhibits_phenotype") <= 1) & ~((count("compound_modulates_target") > 0) & (count("participates_in_metabolism") == 0))
