"""Chat formatting with cumulative-snapshot collapse; DataFrame functions only.

Logs often hold a conversation several times, each snapshot longer than the one before.  Every
turn gets the rolling hash of the turns up to it (running sums of position-keyed turn hashes, 80
bits in all).  A conversation whose full hash is the hash of some longer conversation's prefix
of the same length is dropped by an anti-join; of conversations with equal turns the one with
the smallest id stays.  What remains is rendered with role markers.

The prefixes are made distinct before the anti-join (pre-aggregated map-side), so a first turn
shared by every conversation is one row.

Defined results: turns are ordered by (turn, role, text), nulls last; fully repeated rows count
once; rows without conv_id form one conversation of their own; null role or text is rendered as
empty text but differs from it when conversations are compared; control markers inside a text
are broken up so that they can't open or close a turn; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairrank.llm.common import pick, staged

START, END = "<|im_start|>", "<|im_end|>"
COLS = ["conv_id", "turn", "role", "text"]


def _turn_hash(seed: str) -> Column:
    """40 bits that depend on the turn's position, role and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role",
                                           F.col("text").isNull(), "text"), 24)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, p1, p2): per turn its position, the conversation's length and the hash
    of all turns up to it."""
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (turns.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(whole))
            .withColumn("p1", F.sum(_turn_hash("a")).over(run)).withColumn("p2", F.sum(_turn_hash("b")).over(run))
            .select("conv_id", "pos", "n", "p1", "p2"))


def render(role: Column, text: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), safe, F.lit(END + "\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) for every maximal conversation."""
    turns = pick(conversations, COLS).distinct()
    marks = staged(prefix_hashes(turns), "turn-prefixes")
    whole = marks.where("pos = n").groupBy("n", "p1", "p2").agg(
        F.min("conv_id").alias("keep"), F.count("*").alias("n_copies"))
    inner = marks.where("pos < n").select(F.col("pos").cast("bigint").alias("n"), "p1", "p2").distinct()
    maximal = whole.join(inner, ["n", "p1", "p2"], "left_anti").select("keep", "n", "n_copies")
    kept = turns.join(maximal, F.col("conv_id").eqNullSafe(F.col("keep")))
    parts = F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), F.col("role").isNull().alias("c"),
                     F.col("role").alias("d"), F.col("text").isNull().alias("e"), F.col("text").alias("f"))
    out = kept.groupBy("conv_id", "n", "n_copies").agg(F.array_sort(F.collect_list(parts)).alias("t"))
    return out.select("conv_id", F.col("n").alias("n_turns"), "n_copies",
                      F.array_join(F.transform("t", lambda x: render(x["d"], x["f"])), "").alias("text"))
