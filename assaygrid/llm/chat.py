"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only.

A logged conversation that is the beginning of a longer one (its rows are the other's rows up to its last turn) is a
snapshot and goes; of equal conversations the smallest id stays. A rolling hash describes every beginning: the sums,
over rows so far, of two 40-bit hashes of turn, role and text, with the last turn and the number of rows. Beginnings that are
shorter than their conversation form one set of keys; conversations are reduced to one per key and anti-joined with it.

Sums roll in blocks of `BLOCK` turns with block totals carried over, so a conversation of any length is spread over
tasks; it is rendered in parts of one block, in the order of `part`, whose concatenation is the whole.

Defined results: rows with a null conversation or turn are left out; null roles and texts differ from empty ones when
compared and render empty; rows that share a turn are ordered by role, then text; repeated rows count and render
each time. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

BLOCK, LANE = 256, (1 << 40) - 1
KEY = ("turn", "n", "s1", "s2")


def _beginnings(rows: DataFrame) -> DataFrame:
    """(conv, turn, n, s1, s2) for every turn that a conversation has."""
    sums = [F.sum(c).alias(c) for c in ("n", "s1", "s2")]
    turns = rows.groupBy("conv", "block", "turn").agg(*sums)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv", "block").agg(*sums).select("conv", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "s1", "s2")))
    within = Window.partitionBy("conv", "block").orderBy("turn")
    rolled = turns.select("conv", "block", "turn", *(F.sum(c).over(within).alias(c) for c in ("n", "s1", "s2")))
    return rolled.join(carried, ["conv", "block"]).select("conv", "turn", *((F.col(c) + F.col(f"{c}0")).alias(c) for c in ("n", "s1", "s2")))


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.floor(F.col(turn_col) / BLOCK).cast("long").alias("block"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def maximal(rows: DataFrame) -> DataFrame:
    """The `conv` of each conversation that no longer one begins with, one of equals."""
    parts = (F.col("turn"), F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    hashed = cut(rows.select("conv", "turn", "block", F.lit(1).cast("long").alias("n"), F.xxhash64(*parts).bitwiseAND(LANE).alias("s1"), F.xxhash64(F.lit("second"), *parts).bitwiseAND(LANE).alias("s2")))
    whole = hashed.groupBy("conv").agg(F.max("turn").alias("turn"), *(F.sum(c).alias(c) for c in ("n", "s1", "s2")))
    ends = whole.select("conv", F.col("turn").alias("last"))
    shorter = _beginnings(hashed).join(ends, "conv").where("turn < last").select(*KEY).distinct()
    return whole.groupBy(*KEY).agg(F.min("conv").alias("conv")).join(shorter, list(KEY), "left_anti").select("conv")


def render(role: Column, text: Column) -> Column:
    """One turn with role marks."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, n_turns, rendered) of the maximal conversations."""
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    kept = rows.join(cut(maximal(rows)), "conv", "left_semi")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return kept.groupBy("conv", "block").agg(turns.alias("turns")).select(
        F.col("conv").alias(conv_col), F.col("block").alias("part"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"])), "").alias("rendered"))
