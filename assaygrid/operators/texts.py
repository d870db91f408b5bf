"""Substring joins without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assaygrid.operators.staging import written

#: Window lengths; a text sought is found by its windows of the greatest length that is not above its own.
LENGTHS = (1, 2, 4, 8, 16)


def _windows(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """(text, w): the different windows of each text, of each length; a lookahead takes them in one pass over the text."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths)))
    return rows.select(text, F.explode(F.array_distinct(found)).alias("w"))


def contained(needles: DataFrame, lines: DataFrame) -> DataFrame:
    """(needle, line): which of the texts in column `needle` stands in which text of column `line`; both as they are, letter case counts.

    Windows of the lines are counted; a needle asks for its rarest one, and drops out at once if the lines lack any of its windows. An
    equality join on that window gives the candidates, and each is verified. Nothing is broadcast or limited but by the size that Catalyst
    knows, and a window that many lines hold is met only by needles that have no rarer one. Null and empty texts take no part; repeated
    rows count once.
    """
    needles = written(needles.select("needle").where("needle <> ''").distinct())
    lines = written(lines.select("line").where("line <> ''").distinct())
    size = F.greatest(*(F.when(F.length("needle") >= n, n).otherwise(1) for n in LENGTHS))
    needed = sorted(r[0] for r in needles.select(size.alias("n")).distinct().collect())  # at most five
    if not needed:
        return needles.join(lines.limit(0))
    held = written(_windows(lines, "line", needed))
    counts = held.groupBy("w").agg(F.count("*").alias("n"))
    asked = None
    for n in needed:
        one = _windows(needles.where(size == n), "needle", [n])
        asked = one if asked is None else asked.unionByName(one)
    best = asked.join(counts, "w", "left").groupBy("needle").agg(F.min_by("w", F.struct("n", "w")).alias("w"), F.min(F.col("n").isNotNull()).alias("whole")).where("whole").select("needle", "w")
    return best.join(held, "w").where(F.contains("line", "needle")).select("needle", "line")
