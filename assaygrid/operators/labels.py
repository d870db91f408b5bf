"""Texts and codes of clauses, comparisons and ontology terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TERM = r"CHEBI:\d+\w*"
#: Assay numbers by row of the forest table; treatment and supplement of each assay.
FOREST_ASSAYS = (None, 4, None, 3, None, 6, 7, 8)
ASSAYS = {1: ("None", "None"), 2: ("None", "PosLow"), 3: ("None", "PosHigh"), 4: ("Yes", "None"), 5: ("Yes", "PosLow"), 6: ("Yes", "PosHigh"), 7: ("No", "NegHigh"), 8: ("Yes", "NegHigh")}


def forest_assay(row: Column) -> Column:
    """Assay number of a row (from 0) of the forest table; null for rows that compare no assay."""
    return F.get(F.array(*(F.lit(a).cast("int") for a in FOREST_ASSAYS)), row.cast("int"))


def comparison(assay: Column) -> Column:
    """struct<treatment, supplement, link> of an assay number; null fields for other numbers."""
    at = assay.cast("int") - 1
    treatment, supplement = (F.get(F.array(*(F.lit(ASSAYS[k][part]) for k in sorted(ASSAYS))), at) for part in (0, 1))
    return F.struct(treatment.alias("treatment"), supplement.alias("supplement"), F.concat(F.lit("Treatment="), treatment, F.lit(", Supplement="), supplement).alias("link"))


def first_clause(text: Column, head: str = r"Cell\(A\):-exhibits_phenotype") -> Column:
    """From the first `head` to the next full stop, over lines; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?s){head}.*?\.", 0), F.lit(""))


def line_at(text: Column, k: int) -> Column:
    """Line k (from 0) without white space at its end; null if there are fewer."""
    return F.rtrim(F.get(F.split(text, "\r\n|\n|\r"), k), F.lit(" \t\x0b\x0c"))


def relevance(text: Column, words: list[str]) -> Column:
    """Sum of the weights of the words that the text contains; the first of k words weighs k, the last 1."""
    return sum((F.contains(text, F.lit(w)).cast("int") * (len(words) - i) for i, w in enumerate(words)), F.lit(0))


def named_terms(df: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """df with each term id in `text` replaced by its name from names(term, name); unknown ids and null texts stay.

    Ids are matched whole, so a short id is not replaced inside a longer one. Rows with a null key stay as they are.
    """
    ids = F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0))
    wanted = df.select(F.col(key).alias("__key"), F.explode(ids).alias("term")).distinct()
    known = names.where("term is not null and name is not null").groupBy("term").agg(F.min("name").alias("name"))
    found = wanted.join(known, "term").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("term", "name"))).alias("__names"))
    joined = df.join(found, F.col(key) == F.col("__key"), "left")
    rebuilt = F.array_join(F.zip_with(F.split(F.col(text), TERM, -1), ids, lambda piece, term: F.concat(piece, F.coalesce(F.col("__names")[term], term, F.lit("")))), "")
    return joined.select(*(F.when(F.col("__names").isNull(), F.col(text)).otherwise(rebuilt).alias(text) if c == text else df[c] for c in df.columns))
