"""Quads (g, s, p, o) as a table: construction by templates, and graph-pattern queries as joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assaygrid.functions.scalars import changed
from assaygrid.operators.staging import small, staged, written
from assaygrid.operators.store import Labelled, labelled, unsorted

QUAD = "struct<g:string,s:string,p:string,o:string>"


def node_id(*parts: Column) -> Column:
    """A node is named by a hash of what defines it, so it is found again and never made twice."""
    return F.concat(F.lit("n:"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts)), 256))


def quads(rows: DataFrame, *templates: tuple[Column, Column, Column, Column]) -> DataFrame:
    """One quad for each template and row; a template with a null part gives none."""
    made = F.array(*(F.struct(g.cast("string").alias("g"), s.cast("string").alias("s"), p.cast("string").alias("p"), o.cast("string").alias("o")) for g, s, p, o in templates))
    return rows.select(F.explode(made).alias("q")).select("q.*").dropna()


def restrictions(rows: DataFrame, graph: Column, subject: Column, role: Column, filler: Column) -> DataFrame:
    """The four quads that say `subject` has some `role` in `filler`, around one named blank node."""
    b = F.concat(F.lit("_:"), F.sha2(F.concat_ws("\x1f", subject, role, filler), 256))
    iri = F.lit
    return quads(rows, (graph, subject, iri("rdfs:subClassOf"), b), (graph, b, iri("rdf:type"), iri("owl:Restriction")), (graph, b, iri("owl:onProperty"), role), (graph, b, iri("owl:someValuesFrom"), filler))


def restriction_view(store: DataFrame | Labelled) -> DataFrame:
    """(g, subject, prop, filler) of all restriction quadruples, matched on their shared blank node."""
    part = lambda prop, s, o: pattern(store, prop, s, o) if isinstance(store, Labelled) else pattern(store, prop, s, o).hint("merge")  # noqa: E731  a set's rows are far larger than the file they come from, by whose size Spark would broadcast them
    a = part("rdfs:subClassOf", "subject", "b")
    return (a.join(part("owl:onProperty", "b", "prop"), ["g", "b"]).join(part("owl:someValuesFrom", "b", "filler"), ["g", "b"])
            .join(part("rdf:type", "b", "k").where("k = 'owl:Restriction'"), ["g", "b"], "left_semi").select("g", "subject", "prop", "filler"))


@dataclass(frozen=True)
class QuadStore:
    """Quads by property and subject, and the restriction view by role and subject, each computed once."""

    quads: Labelled
    restrictions: Labelled


def stored(store: DataFrame, buckets: int | None = None) -> QuadStore:
    """A store for many patterns: each then scans one property's folder, and joins on subjects need no exchange."""
    quads = labelled(store.select("g", "s", "p", "o"), "p", "s", buckets)
    return QuadStore(quads, labelled(restriction_view(quads), "prop", "subject", buckets))


def read_once(store: DataFrame) -> QuadStore:
    """A store for one query's patterns: its quads and restrictions written once, in no order; joins shuffle what they match, not all quads."""
    quads = unsorted(store.select("g", "s", "p", "o"), "p")
    return QuadStore(quads, unsorted(restriction_view(quads), "prop"))


def pattern(store: DataFrame | Labelled, prop: str, s: str, o: str, graph: str | None = None) -> DataFrame:
    """(g, s, o) of one property; swap the names for an inverse path. The property filter reaches the scan."""
    rows = store.of(prop) if isinstance(store, Labelled) else store.where(F.col("p") == prop)
    rows = rows if graph is None else rows.where(F.col("g") == graph)
    return rows.select("g", F.col("s").alias(s), F.col("o").alias(o))


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(child, parent): zero or more steps over `edges`; every node reaches itself. Paths double in length a round."""
    nodes = edges.select("child").union(edges.select("parent")).distinct()
    known, size = nodes.select("child", F.col("child").alias("parent")).union(edges.select("child", "parent")).distinct(), -1
    for _ in range(rounds):
        step = known.join(known.toDF("parent", "up"), "parent").select("child", F.col("up").alias("parent"))
        known = staged(known.union(step).distinct())
        now = known.count()
        if now == size:
            return known
        size = now
    raise RuntimeError("closure did not settle")


def reaching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(child, parent): each node with a path of zero or more (child, parent) edges to a seed, and that seed (column `parent` of `seeds`).

    Only paths to seeds are followed. Nodes with one edge, the links of long chains, jump to the first node that is a seed or has
    several edges or none, doubling their jump in each round; then a frontier of pairs goes from the seeds down over what
    remains, anti-joined with the pairs known. So a chain takes as many rounds as its length has bits, and the rounds of the frontier are
    the levels of nodes with several edges. Cycles end: links that only lead in a circle reach no seed. Null ends are no edges, repeated rows and
    loops add nothing, and a seed reaches itself even where no edge names it.
    """
    edges = written(edges.select("child", "parent").where("child <> parent").distinct())
    seeds = seeds.select("parent").where("parent is not null").distinct()
    fan = edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("at"))
    lone = fan.where("n = 1").join(seeds.withColumnRenamed("parent", "child"), "child", "left_anti").select("child", "at")
    jumps = written(lone.join(lone.select(F.col("child").alias("at"), F.lit(True).alias("open")), "at", "left").select("child", "at", F.coalesce("open", F.lit(False)).alias("open")))
    links = jumps.select("child")
    for _ in range(links.count().bit_length()):
        if jumps.where("open").isEmpty():
            break
        on = jumps.toDF("at", "far", "still")
        jumps = written(jumps.where("not open").union(jumps.where("open").join(on, "at").select("child", F.col("far").alias("at"), F.col("still").alias("open"))))
    ends = jumps.select(F.col("child").alias("parent"), "at", "open")
    steps = edges.join(links, "child", "left_anti").join(ends, "parent", "left").where("open is null or not open").select("child", F.coalesce("at", "parent").alias("at"))
    steps = written(steps.distinct())
    known, front, rounds = seeds.select(F.col("parent").alias("child"), "parent"), seeds.select(F.col("parent").alias("at"), "parent"), 0
    while True:
        new = written(steps.join(front, "at").select("child", "parent").distinct().join(known, ["child", "parent"], "left_anti"))
        if new.isEmpty():
            break
        known, front, rounds = known.union(new), new.withColumnRenamed("child", "at"), rounds + 1
        known = written(known) if rounds % 16 == 0 else known
    return known.union(jumps.where("not open").select("child", "at").join(known.withColumnRenamed("child", "at"), "at").select("child", "parent"))


def merged(*stores: DataFrame) -> DataFrame:
    """One set of quads."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["g", "s", "p", "o"])


def exported(store: DataFrame, without: str = "ontology", metadata: str = "hypothesis-metadata") -> DataFrame:
    """All graphs but one, and no metadata of hypotheses whose own graph is empty."""
    store = written(store)
    kept = store.where(F.col("g") != without)
    filled = store.select(F.col("g").alias("s")).distinct()
    return kept.where(F.col("g") != metadata).unionByName(kept.where(F.col("g") == metadata).join(filled, "s", "left_semi").select(*kept.columns))


def either(*parts: DataFrame) -> DataFrame:
    """The union of query branches as a bag; names that a branch does not bind are null."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def resolve_labels(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, term): first by spelling (L-x, L-lower x, x, lower x), then by the kind of label, then by term."""
    x = F.col("name")
    tries = F.array(*(F.struct(F.lit(k).alias("try"), v.alias("label")) for k, v in enumerate((F.concat(F.lit("L-"), x), F.concat(F.lit("L-"), F.lower(x)), x, F.lower(x)))))
    kinds = F.array_position(F.array(*map(F.lit, ("typed", "en", "plain", "exact_synonym", "related_synonym"))), F.col("kind"))
    hits = names.select("name", F.explode(tries).alias("t")).select("name", "t.*").join(labels, "label").where(kinds > 0)
    found = hits.groupBy("name").agg(F.min_by("term", F.struct("try", kinds.alias("k"), "term")).alias("term"))
    return names.join(found, "name", "left").select("name", "term")


def clause_states(parsed: DataFrame) -> DataFrame:
    """(clause, qualifier, phenotype, compound) of each phenotype literal `qualifier phenotype`.

    Only three phenotypes carry a compound: the name that a compound_name literal gives to the phenotype's value. Without
    such a literal the compound is null and the phenotype stays.
    """
    a = parsed.select("clause", "parsed.atoms", F.explode("parsed.atoms").alias("a")).where("a.name = 'exhibits_phenotype'")
    args = F.col("a.args")
    text, value = F.get(args, F.lit(1)), F.get(args, F.lit(2))
    phenotype = F.regexp_extract(text, r"^\S+\s+(.*)$", 1)
    named = F.filter("atoms", lambda x: (x["name"] == "compound_name") & (F.get(x["args"], F.lit(0)) == value))
    compound = F.get(F.get(named, F.lit(0))["args"], F.lit(1))
    return a.select("clause", F.regexp_extract(text, r"^(\S+)", 1).alias("qualifier"), phenotype.alias("phenotype"), F.when(phenotype.isin(*COMPOUND_PHENOTYPES), compound).alias("compound"))


#: Phenotypes whose literals name a compound; classes, roles and graphs of the hypothesis store.
COMPOUND_PHENOTYPES = ("resistance to chemicals", "metal resistance", "hyperosmotic stress resistance")
ACCUMULATION, ACCUMULATES, RESISTS = "obo:APO_0000095", ":accumulationOfChemical", ":resistanceToChemical"
RESISTANCE = "obo:APO_0000087"
STATE, OBSERVABLE, IMPLIES, REFERENCE = ":organismState", ":stateHasObservable", ":implies", ":reference-state"
STATES, PHENOTYPES, METADATA = "states", "phenotypes", "hypothesis-metadata"


def phenotype_parts(rows: DataFrame) -> DataFrame:
    """Adds the ids of the reference phenotype and of the compared one to (hypothesis, side, class, role, chemical, relation)."""
    ref = node_id(F.lit("P-REF"), F.lit(REFERENCE), F.col("class"), F.col("role"), F.col("chemical"))
    return rows.withColumn("ref", ref).withColumn("phenotype", node_id(F.lit("P"), F.col("class"), F.col("role"), F.col("chemical"), F.col("relation"), F.col("ref")))


def target_parts(hypotheses: DataFrame, terms: DataFrame) -> DataFrame:
    """Side 1 of each hypothesis: its observable accumulates differently, as the qualifier says. No term, no part."""
    found = hypotheses.join(terms.select(F.col("name").alias("observable"), "term"), "observable").where("term is not null")
    return phenotype_parts(found.select("hypothesis", F.lit(1).alias("side"), F.lit(ACCUMULATION).alias("class"), F.lit(ACCUMULATES).alias("role"), F.col("term").alias("chemical"), F.concat(changed(F.col("qualifier")), F.lit("ComparedTo")).alias("relation")))


def clause_parts(states: DataFrame, classes: DataFrame, terms: DataFrame) -> DataFrame:
    """Side 2: the phenotypes of each hypothesis's clause, from (hypothesis, qualifier, phenotype, compound).

    `classes` is (phenotype, class). A compound without a term is left out and its phenotype stays; one without a class goes.
    """
    got = states.join(classes, "phenotype").join(terms.select(F.col("name").alias("compound"), "term"), "compound", "left")
    return phenotype_parts(got.select("hypothesis", F.lit(2).alias("side"), "class", F.when(F.col("term").isNotNull(), RESISTS).alias("role"), F.col("term").alias("chemical"), F.concat("qualifier", F.lit("ComparedTo")).alias("relation")).distinct())


def hypothesis_states(parts: DataFrame) -> DataFrame:
    """(hypothesis, side, state): the organism state that shows all phenotypes of a side."""
    return parts.groupBy("hypothesis", "side").agg(F.array_sort(F.collect_set("phenotype")).alias("all")).select("hypothesis", "side", node_id(F.lit("S"), F.array_join("all", ",")).alias("state"))


def hypothesis_quads(hypotheses: DataFrame, parts: DataFrame) -> DataFrame:
    """Hypotheses (hypothesis, created, creator) and their parts as quads; `state 1 implies state 2` stands in a graph of its own.

    A hypothesis without both sides has no such graph. A creator that is null is Genesis.
    """
    parts = written(parts)
    states, c, lit = written(hypothesis_states(parts)), F.col, F.lit
    shown = parts.join(states, ["hypothesis", "side"])
    two = states.where("side = 1").select("hypothesis", c("state").alias("state1")).join(states.where("side = 2").select("hypothesis", c("state").alias("state2")), "hypothesis")
    some = parts.where("chemical is not null")
    few = lambda rows, *cols: rows.select(*cols).distinct()  # noqa: E731  what a template reads, once: narrower than its quads
    pieces = [
        restrictions(few(parts, "ref"), lit(STATES), lit(REFERENCE), lit(OBSERVABLE), c("ref")), quads(few(states, "state"), (lit(STATES), c("state"), lit("rdfs:subClassOf"), lit(STATE))),
        restrictions(few(shown, "state", "phenotype"), lit(STATES), c("state"), lit(OBSERVABLE), c("phenotype")),
        *(quads(few(parts, x, "class"), (lit(PHENOTYPES), c(x), lit("rdfs:subClassOf"), c("class"))) for x in ("ref", "phenotype")),
        *(restrictions(few(some, x, "role", "chemical"), lit(PHENOTYPES), c(x), c("role"), c("chemical")) for x in ("ref", "phenotype")),
        restrictions(few(parts, "phenotype", "relation", "ref"), lit(PHENOTYPES), c("phenotype"), c("relation"), c("ref")), restrictions(few(two, "hypothesis", "state1", "state2"), c("hypothesis"), c("state1"), lit(IMPLIES), c("state2")),
        quads(few(hypotheses, "hypothesis", "created"), (lit(METADATA), c("hypothesis"), lit("dcterms:created"), c("created"))),
        quads(few(hypotheses, "hypothesis", F.coalesce("creator", lit("Genesis")).alias("creator")), (lit(METADATA), c("hypothesis"), lit("dcterms:creator"), c("creator")))]
    odd = c("hypothesis").isin(STATES, PHENOTYPES, METADATA)
    for x in ("class", "role", "chemical", "relation"):
        odd = odd | F.contains(c(x), lit("\x1f"))
    return merged(*pieces) if not parts.where(odd).isEmpty() else reduce(DataFrame.unionByName, pieces)  # else no two pieces or rows give one quad


def distinct_quads(rows: DataFrame, node: Column, *templates: tuple[Column, Column, Column, Column]) -> DataFrame:
    """The set of the quads of all rows, where equal quads come from rows of one `node` only.

    `rows` are read three times. Only those whose node another row has, too, can repeat a quad: nodes are counted by a hash, and the quads of the others pass
    unshuffled. A hash that two nodes share only sends more rows through the distinct.
    """
    key = F.xxhash64(node)
    several = written(rows.groupBy(key.alias("__node")).agg(F.count("*").alias("n")).where("n > 1").select("__node"))
    once = quads(rows.join(small(several), key == F.col("__node"), "left_anti"), *templates)
    return once.unionByName(quads(rows.join(small(several), key == F.col("__node"), "left_semi"), *templates).distinct())


def protocol_quads(e: DataFrame) -> DataFrame:
    """Experiments of studies as quads: study, assays, culture, medium and treatment; what is null makes no quad.

    Columns: study, hypothesis_text, experiment (a whole number), type, summary, media_description, baseline_media, and chemical, value and unit
    of supplement (sup_) and treatment (treat_).
    """
    g, lit, c = F.lit("experiments"), F.lit, F.col
    e = written(e)
    study = F.concat(lit("STUDY-"), "study")
    assay = F.concat(lit("EXP-"), "study", lit("-"), "experiment")
    culture, medium, treatment, cells = F.concat(assay, lit("-cellculture")), F.concat(assay, lit("-medium")), F.concat(assay, lit("-treatment")), lit(":saccaharomyces-cerevisiae-population")
    a, part, given = lit("rdf:type"), lit("obo:BFO_0000051"), lit("obo:OBI_0000293")
    label = F.concat("type", lit(": "), "summary")
    shared = quads(e.select("study", "hypothesis_text").distinct(), (g, study, a, lit("obo:OBI_0500000")), (g, study, lit("rdfs:label"), c("hypothesis_text")))
    shared = shared.unionByName(quads(e.limit(1), (g, cells, a, lit("obo:NCBITaxon_4932"))))
    made = distinct_quads(e, assay, (g, study, part, assay), (g, assay, a, lit("obo:OBI_0000070")), (g, assay, lit("rdfs:label"), label),
                          (g, assay, given, culture), (g, assay, given, medium), (g, assay, given, treatment), (g, culture, a, lit("obo:OBI_0001876")), (g, culture, part, cells), (g, culture, part, medium),
                          (g, medium, a, lit("obo:OBI_0000079")), (g, medium, lit("rdfs:label"), c("media_description")), (g, medium, lit(":baselineMedia"), c("baseline_media")), (g, medium, lit(":mediaSupplementation"), c("sup_chemical")),
                          (g, medium, lit(":mediaSupplementationDosesValue"), c("sup_value")), (g, medium, lit(":mediaSupplementationDosesUnit"), c("sup_unit")), (g, treatment, a, lit(":treatment")),
                          (g, treatment, lit(":treatmentWithChemical"), c("treat_chemical")), (g, treatment, lit(":treatmentParametersValue"), c("treat_value")), (g, treatment, lit(":treatmentParametersUnit"), c("treat_unit")))
    return shared.distinct().unionByName(made)


def growth_test_quads(t: DataFrame) -> DataFrame:
    """Comparisons (study, i, assay, estimate, p, treatment, supplement, link) as quads; the reference is always assay 1."""
    g, lit, c = F.lit("growth-data"), F.lit, F.col
    test = F.concat(lit("GROWTH-"), "study", lit("-auc-forest-"), "i")
    ref, cond, a = F.concat(test, lit("-reference-condition")), F.concat(test, lit("-test-condition")), lit("rdf:type")
    labels = [(g, x, lit(p), c(v)) for x in (ref, cond) for p, v in ((":testConditionHasTreatment", "treatment"), (":testConditionHasSupplement", "supplement"))]
    return distinct_quads(written(t), test, (g, test, a, lit(":AUCForestComparativeTest")), (g, test, lit(":referenceCondition"), ref), (g, test, lit(":testCondition"), cond), (g, test, lit(":GLMCoefficient"), c("estimate")), (g, test, lit(":pValue"), c("p")),
                 (g, ref, a, lit(":growthDataTestCondition")), (g, ref, lit(":growthDataFromAssay"), F.concat(lit("EXP-"), "study", lit("-1"))), (g, ref, lit("rdfs:label"), lit("Treatment=None, Supplement=None")),
                 (g, cond, a, lit(":growthDataTestCondition")), (g, cond, lit(":growthDataFromAssay"), F.concat(lit("EXP-"), "study", lit("-"), "assay")), (g, cond, lit("rdfs:label"), c("link")), *labels)


def some(store: QuadStore, graph: str | None, subject: str, prop: str, filler: str) -> DataFrame:
    """(subject, filler) of restrictions on one property; in the graph named by column `g` too, where `graph` is None."""
    view = store.restrictions.of(prop)
    view = view if graph is None else view.where(F.col("g") == graph)
    return view.select(*(["g"] if graph is None else []), F.col("subject").alias(subject), F.col("filler").alias(filler))


def assays_of(store: Labelled, baseline: str) -> DataFrame:
    """(study, label, assay, supplement, treatment) of complete assays on one medium; a study of several labels has a row each."""
    one = lambda p, s, o: pattern(store, p, s, o, "experiments").select(s, o)
    typed = lambda df, x, k: df.join(one("rdf:type", x, "k").where(F.col("k") == k).select(x), x, "left_semi")
    assay = typed(typed(one("obo:BFO_0000051", "study", "assay"), "study", "obo:OBI_0500000"), "assay", "obo:OBI_0000070")
    given = one("obo:OBI_0000293", "assay", "x")
    medium = typed(given.withColumnRenamed("x", "medium"), "medium", "obo:OBI_0000079").join(one(":baselineMedia", "medium", "b").where(F.col("b") == baseline).select("medium"), "medium", "left_semi")
    medium = medium.join(one(":mediaSupplementation", "medium", "supplement"), "medium", "left")
    culture = typed(given.withColumnRenamed("x", "culture"), "culture", "obo:OBI_0001876").join(one("obo:BFO_0000051", "culture", "medium"), "culture")
    culture = culture.join(one("obo:BFO_0000051", "culture", "c").where("c = ':saccaharomyces-cerevisiae-population'").select("culture"), "culture", "left_semi")
    treated = typed(given.withColumnRenamed("x", "treatment_id"), "treatment_id", ":treatment").join(one(":treatmentWithChemical", "treatment_id", "treatment"), "treatment_id", "left")
    got = assay.join(medium, "assay").join(culture.select("assay", "medium").distinct(), ["assay", "medium"]).join(treated, "assay").join(one("rdfs:label", "study", "label"), "study")
    return got.select("study", "label", "assay", "supplement", "treatment")


def _read_by_hypotheses(baseline: str) -> Column:
    """Whether some pattern of `hypotheses_with_tests` can match a quad; restrictions are read in all graphs."""
    g, p, o = F.col("g"), F.col("p"), F.col("o")
    typed = lambda *kinds: (p == "rdf:type") & o.isin(*kinds)
    return (p.isin("rdfs:subClassOf", "owl:onProperty", "owl:someValuesFrom") | typed("owl:Restriction") | ((g == METADATA) & (p == "dcterms:created")) | ((g == "ontology") & (p == "rdfs:subPropertyOf"))
            | ((g == "experiments") & (p.isin("obo:BFO_0000051", "obo:OBI_0000293", "rdfs:label", ":mediaSupplementation", ":treatmentWithChemical") | ((p == ":baselineMedia") & (o == baseline))
                                       | typed("obo:OBI_0500000", "obo:OBI_0000070", "obo:OBI_0000079", "obo:OBI_0001876", ":treatment")))
            | ((g == "growth-data") & (p.isin(":referenceCondition", ":testCondition", ":GLMCoefficient", ":pValue", ":growthDataFromAssay") | typed(":AUCForestComparativeTest"))))


def hypotheses_with_tests(store: DataFrame | QuadStore, baseline: str = "Minimal media without amino acids") -> DataFrame:
    """(h, ql1, hypo_aa, ql2, hypo_supp, study, label, coef_aa, p_aa, coef_aa_supp, p_aa_supp) of all hypotheses.

    Optional: what the hypothesis says (accumulation of hypo_aa implies resistance to hypo_supp, with relations below differs or
    notDiffers and a class below resistance); optional within: a study with a base assay, one with hypo_aa alone and
    one with both, and the growth tests of the latter two against the base.
    """
    store = store if isinstance(store, QuadStore) else read_once(store.where(_read_by_hypotheses(baseline)))
    quads, role_rows = store.quads, store.restrictions
    h = pattern(quads, "dcterms:created", "h", "x", METADATA).select("h")
    below = lambda prop, *seeds: reaching(pattern(quads, prop, "child", "parent", "ontology"), quads.even.sparkSession.createDataFrame([(x,) for x in seeds], "parent string")).select("child").distinct()
    relations = below("rdfs:subPropertyOf", ":differsFrom", ":notDiffersFrom")
    resistant = below("rdfs:subClassOf", RESISTANCE)
    state = pattern(quads, "rdfs:subClassOf", "state", "k", STATES).where(F.col("k") == STATE).select("state")
    implied = some(store, None, "s1", IMPLIES, "s2").withColumnRenamed("g", "h")
    shows = written(some(store, STATES, "state", OBSERVABLE, "phenotype").join(state, "state", "left_semi"))
    kind = pattern(quads, "rdfs:subClassOf", "phenotype", "class", PHENOTYPES).select("phenotype", "class")
    related = role_rows.all().where(F.col("g") == PHENOTYPES).select(F.col("subject").alias("phenotype"), F.col("prop").alias("ql")).join(relations.withColumnRenamed("child", "ql"), "ql", "left_semi").distinct()
    side = lambda k, role, kinds: (shows.join(kind.join(kinds, "class", "left_semi").select("phenotype").distinct(), "phenotype").join(related, "phenotype")
                                   .join(some(store, PHENOTYPES, "phenotype", role, "chemical"), "phenotype").select(F.col("state").alias(f"s{k}"), F.col("ql").alias(f"ql{k}"), F.col("chemical").alias(f"c{k}")))
    first = side(1, ACCUMULATES, quads.even.sparkSession.createDataFrame([(ACCUMULATION,)], "class string"))
    second = side(2, RESISTS, resistant.withColumnRenamed("child", "class"))
    said = implied.join(first, "s1").join(second, "s2").select("h", "ql1", F.col("c1").alias("hypo_aa"), "ql2", F.col("c2").alias("hypo_supp"))

    assays = written(assays_of(quads, baseline))
    one = lambda p, s, o: pattern(quads, p, s, o, "growth-data").select(s, o)
    test = one("rdf:type", "test", "k").where("k = ':AUCForestComparativeTest'").select("test")
    for prop, name in ((":referenceCondition", "r"), (":testCondition", "t"), (":GLMCoefficient", "coef"), (":pValue", "p")):
        test = test.join(one(prop, "test", name), "test")
    test = written(test.join(one(":growthDataFromAssay", "r", "base"), "r").join(one(":growthDataFromAssay", "t", "assay"), "t").select("base", "assay", "coef", "p"))
    base = assays.where("supplement is null and treatment is null").select("study", "label", F.col("assay").alias("base"))
    alone = assays.where("supplement is not null and treatment is null").join(test, "assay").select("study", "base", F.col("supplement").alias("hypo_aa"), F.col("coef").alias("coef_aa"), F.col("p").alias("p_aa"))
    both = assays.where("supplement is not null and treatment is not null").join(test, "assay").select("study", "base", F.col("supplement").alias("hypo_aa"), F.col("treatment").alias("hypo_supp"), F.col("coef").alias("coef_aa_supp"), F.col("p").alias("p_aa_supp"))
    tested = base.join(alone, ["study", "base"]).join(both, ["study", "base", "hypo_aa"]).drop("base")
    return h.join(said, "h", "left").join(tested, ["hypo_aa", "hypo_supp"], "left").select("h", "ql1", "hypo_aa", "ql2", "hypo_supp", "study", "label", "coef_aa", "p_aa", "coef_aa_supp", "p_aa_supp")


def support_query(store: DataFrame, supplement: str, treatment: str) -> DataFrame:
    """(study, assay) of assays with both compounds whose study also has an assay with neither."""
    assay = pattern(store, "hasAssay", "study", "assay")
    sup = pattern(store, "hasSupplement", "assay", "c").where(F.col("c") == supplement)
    tre = pattern(store, "hasTreatment", "assay", "c").where(F.col("c") == treatment)
    both = assay.join(sup.select("assay"), "assay", "left_semi").join(tre.select("assay"), "assay", "left_semi")
    none = assay.join(pattern(store, "hasSupplement", "assay", "c").select("assay"), "assay", "left_anti").join(pattern(store, "hasTreatment", "assay", "c").select("assay"), "assay", "left_anti")
    return both.join(none.select("study"), "study", "left_semi").select("study", "assay")


def ask(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def asked(rows: DataFrame) -> DataFrame:
    """(answer): one row, whether there are any; the scan ends at the first."""
    return rows.limit(1).agg((F.count("*") > 0).alias("answer"))


def study_exists(store: DataFrame, supplement: str, treatment: str) -> DataFrame:
    """(answer): whether any study has an assay with both compounds and one with neither."""
    return asked(support_query(store, supplement, treatment))


def select_if(answer: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows if the one-row answer is true, else none."""
    return rows.join(F.broadcast(answer.where("answer").select(F.lit(1).alias("__yes")).limit(1))).drop("__yes")


def queried(spark: SparkSession, store: DataFrame, sql: str) -> DataFrame:
    """Ad-hoc SQL over the store, which the text names {quads}."""
    return spark.sql(sql, quads=store)


def hypotheses_with_support(store: DataFrame) -> DataFrame:
    """All hypotheses, with a supporting study if there is one, with its tests if there are any (the inner optional inside the outer)."""
    hyp = pattern(store, "implies", "hypothesis", "state").select("hypothesis", "state")
    test = pattern(store, "hasTest", "study", "test").select("study", "test").join(pattern(store, "hasValue", "test", "value").select("test", "value"), "test", "left")
    study = pattern(store, "supports", "study", "hypothesis").select("study", "hypothesis").join(test, "study", "left")
    return hyp.join(study, "hypothesis", "left").select("hypothesis", "state", "study", "test", "value")
