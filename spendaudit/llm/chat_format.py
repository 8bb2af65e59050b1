"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation that another one continues is a snapshot of it. Each turn's digest, taken with its place, enters a
running sum, so that every prefix of a conversation has a rolling hash (four sums of 32-bit pieces, 128 bits). Conversations
whose whole hash is a proper prefix of another are removed by an anti-join; of equal ones the smallest id stays. The rest are
rendered.

Hot keys: the running sums are made per block of turns and carried on by sums over blocks, so that one conversation may hold
a third of all rows; prefixes are made distinct, with partial sums, before the anti-join, so that one opening may be that of a
third of all conversations. Rendered text comes in parts of ``PART_TURNS`` turns, most conversations have one.

Results for odd input: rows without a conversation id belong to none and are left out; a null role reads ``unknown``, a null
text is empty when rendered, but differs from an empty one when compared; a row that repeats another in all four columns
counts once; turns with equal numbers are ordered by role and text, null numbers come first; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendaudit.session import materialize

#: Turn numbers in a block, and turns in a rendered part.
BLOCK_TURNS = 64
PART_TURNS = 64

PIECES = ["h0", "h1", "h2", "h3"]


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def placed_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, block, place (from 1), n_turns, role, text: the place of a turn is its rank in its block plus the blocks before."""
    turns = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"),
    ).filter("conv_id is not null").distinct()
    turns = materialize(turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62)))), "turns")
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select(
        "conv_id", "block", F.sum("n").over(whole).alias("n_turns"),
        (F.sum("n").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*_order()))
    return turns.withColumn("rank", rank).join(blocks, ["conv_id", "block"]).select(
        "conv_id", "block", (F.col("before") + F.col("rank")).alias("place"), "n_turns", "role", "text"
    )


def rolling_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, place, n_turns and the hash of the first ``place`` turns."""
    told = F.concat_ws(
        "\x1f", F.col("place").cast("string"), F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"),
        F.sha2(F.coalesce("role", F.lit("")), 256), F.sha2(F.coalesce("text", F.lit("")), 256),
    )
    digest = placed.select("conv_id", "block", "place", "n_turns", F.sha2(told, 256).alias("digest"))
    pieces = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(PIECES)]
    turns = materialize(digest.select("conv_id", "block", "place", "n_turns", *pieces), "turn-hashes")
    blocks = turns.groupBy("conv_id", "block").agg(*(F.sum(h).alias(h) for h in PIECES))
    up_to = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = blocks.select("conv_id", "block", *((F.sum(h).over(up_to) - F.col(h)).alias(f"{h}_before") for h in PIECES))
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = turns.select("conv_id", "block", "place", "n_turns", *(F.sum(h).over(inside).alias(h) for h in PIECES))
    return running.join(before, ["conv_id", "block"]).select(
        "conv_id", "place", "n_turns", *((F.col(h) + F.col(f"{h}_before")).alias(h) for h in PIECES)
    )


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal of the conversations that stay."""
    whole = hashes.filter("place = n_turns").groupBy("n_turns", *PIECES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    prefixes = hashes.filter("place < n_turns").select(F.col("place").alias("n_turns"), *PIECES).distinct()
    return whole.join(prefixes, ["n_turns", *PIECES], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_equal, n_part_turns, text: the kept conversations in the usual chat markup."""
    one = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    lines = placed.select("conv_id", F.floor((F.col("place") - 1) / PART_TURNS).alias("part"), "place", one.alias("line"))
    parts = lines.join(kept, "conv_id").groupBy("conv_id", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.count("*").alias("n_part_turns"),
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"),
    )
    return parts.select("conv_id", "part", "n_turns", "n_equal", "n_part_turns", F.array_join(F.col("lines.line"), "").alias("text"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as rendered text, one row per conversation and part."""
    placed = materialize(placed_turns(conversations, conv_col, turn_col, role_col, text_col), "placed-turns")
    return render(placed, materialize(maximal_conversations(rolling_hashes(placed)), "kept-conversations"))
