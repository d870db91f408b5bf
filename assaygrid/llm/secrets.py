"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must hold. The index
keeps, for each trigram that a query names, the rows whose lower-cased text holds it (postings), found in one pass over a text.
Postings are gathered by row, the queries decide from them which rows can match which rule, and only those are scanned by
the expression. A rule without a mandatory trigram scans every row. Candidates are few and are broadcast behind a count.

Matches are cut out natively: the text between matches comes from splitting at the expression, the matches from
extracting it, and places follow from their lengths in code points.

Defined results: null and empty texts have no span; the index is by id, so rows that share an id are candidates together and
each is scanned on its own text; rows with a null id are not indexed but scanned by all rules; spans of a kind do not overlap,
those of different kinds may. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

try:
    from re import _constants as sre, _parser as parser
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the given group has at least `least` code points."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = field(default=False)


#: The fixed base rules, then rules that only add spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Most strings that a part of an expression is spelled out to.
SPELLED = 64
#: Candidates that may be broadcast, about 100 bytes each; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
Query = frozenset  # of alternatives, each a frozenset of trigrams that must all be there; the empty alternative says nothing


def _spellings(nodes: Iterable, most: int = SPELLED) -> tuple[set[str] | None, list[set[str]]]:
    """All strings of a sequence if they are few (else None), and sets of strings one of which each match holds."""
    runs: list[set[str]] = []
    now: set[str] | None = {""}

    def close():
        nonlocal now
        if now is not None and now != {""}:
            runs.append(now)
        now = {""}

    whole = True
    for op, arg in nodes:
        part: set[str] | None = None
        inner: list[set[str]] = []
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part, inner = _spellings(arg[3])
        elif op is sre.BRANCH:
            parts = [_spellings(b) for b in arg[1]]
            part = set().union(*(p for p, _ in parts)) if all(p is not None for p, _ in parts) else None
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            some, _ = _spellings(arg[2])
            part = some | {""} if some is not None and arg[0] == 0 else some
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            _, inner = _spellings(arg[2])
        if part is not None and len(part) * len(now) <= most:
            now = {a + b for a in now for b in part}
            continue
        whole = False
        close()
        runs += inner
        if part is not None and len(part) <= most:
            now = part
    last = now
    close()
    return (last if whole else None), runs


def trigram_query(regex: str) -> Query:
    """Alternatives of mandatory trigrams; empty if the expression has none."""
    _, runs = _spellings(parser.parse(regex))
    best: Query = frozenset()
    for run in runs:
        if all(len(s) >= 3 for s in run):
            query = frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in run)
            if not best or min(map(len, query)) > min(map(len, best)):
                best = query
    return best


def postings(docs: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, id), for trigrams that some rule's query names."""
    grams = sorted({g for r in rules for alt in trigram_query(r.regex) for g in alt})
    if not grams:
        return docs.select(F.lit("").alias("trigram"), F.col(id_col).alias("id")).where("false")
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(one_of(grams)), F.lit(1)))
    return docs.where(F.col(id_col).isNotNull()).select(F.explode(held).alias("trigram"), F.col(id_col).alias("id"))


def one_of(grams: list[str]) -> str:
    """An expression that captures, at every place, the trigram that begins there: branches by first and second letter."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in grams:
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    some = lambda letters: "[" + "".join(sorted(re.sub(r"([^\w])", r"\\\1", x) for x in letters)) + "]"
    one = lambda x: some([x])
    ends = {a: "|".join(one(b) + some(cs) for b, cs in sorted(by.items())) for a, by in tree.items()}
    return f"(?={some(tree)})(?=(" + "|".join(f"{one(a)}(?:{ends[a]})" for a in sorted(tree)) + "))"


def candidates(index: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """(id, kinds): the rules whose query an id's postings satisfy."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    by = index.groupBy("id").agg(*(F.bool_or(F.col("trigram") == g).alias(f"g{k}") for k, g in enumerate(grams)))
    at = {g: F.coalesce(F.col(f"g{k}"), F.lit(False)) for k, g in enumerate(grams)}

    def holds(query: Query) -> Column:
        out = F.lit(False)
        for alt in sorted(query, key=sorted):
            each = F.lit(True)
            for g in sorted(alt):
                each = each & at[g]
            out = out | each
        return out

    kinds = F.array_compact(F.array(*(F.when(holds(q), F.lit(k)) for k, q in queries.items())))
    return by.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _found(text: Column, rule: Rule) -> Column:
    """array<struct<start, rank, kind, end>> of the rule's matches in a text."""
    hits = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    long = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    between = F.split(text, rule.regex, -1)
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  value is computed once
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    measured = F.struct(F.transform(F.slice(between, F.lit(1), F.size(hits)), lambda x: F.length(x)).alias("gaps"), F.transform(hits, lambda x: F.length(x)).alias("hits"), F.transform(long, lambda x: F.length(x)).alias("groups"))

    def placed(m):
        """Starts are sums of all lengths before; sums of blocks of about the root of their number keep that short."""
        sizes = F.zip_with(m["gaps"], m["hits"], lambda g, h: g + h)
        block = F.ceil(F.sqrt(F.size(m["hits"]))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m["hits"]) - 1) / block).cast("int")), lambda b: total(F.slice(sizes, b * block + 1, block)))
        done = lambda i: F.floor(i / block).cast("int")
        sums = F.struct(sizes.alias("sizes"), blocks.alias("blocks"))

        def spans(s):
            start = lambda i: total(F.slice(s["blocks"], F.lit(1), done(i))) + total(F.slice(s["sizes"], done(i) * block + 1, i - done(i) * block)) + F.get(m["gaps"], i)
            span = lambda g, i: F.struct(start(i).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start(i) + F.get(m["hits"], i)).alias("end"), g.alias("long"))
            kept = F.filter(F.transform(m["groups"], span), lambda x: x["long"] >= rule.least)
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))

        return once(sums, spans)

    return F.when(F.rlike(text, F.lit(rule.regex)), once(measured, placed))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): every row with its secrets, ordered by start and rule."""
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    can = cut(candidates(postings(docs, rules, id_col, text_col), rules).withColumnRenamed("id", "__id"))
    can = F.broadcast(can) if can.count() <= BROADCAST_ROWS else can
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(can, F.col(id_col) == F.col("__id"), "left")
    may = lambda r: F.array_contains("kinds", r.kind) | F.col(id_col).isNull() if trigram_query(r.regex) else F.col("text").isNotNull()
    found = [F.when(may(r), _found(F.col("text"), r)).otherwise(none) for r in rules]
    spans = F.array_sort(F.concat(*(F.coalesce(f, none) for f in found)))
    return rows.select(F.col(id_col), "text", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
