"""Logged conversations: keep those that no longer one continues, and render them.

Chat logs hold a snapshot after each turn. A conversation's rolling prefix hash after turn k covers its first
k turns; a conversation whose last hash is a prefix hash of a longer one is a snapshot of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import materialize, small_or_shuffled

#: Turns whose prefix sums are made together; a longer conversation spans several blocks.
BLOCK = 256


def text_hash(text: Column) -> Column:
    """128 bits of a text; null differs from every text."""
    return F.struct(*[F.xxhash64(F.lit(salt), text.isNull(), text).alias(n) for n, salt in (("x", 1), ("y", 2))])


def turn_block(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / BLOCK), F.lit(-(1 << 62)))


def placed(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place from 0, without their texts: (conv_id, place, role, th).

    A turn that is logged twice with the same number, role and text counts once. Order is by turn number, then role,
    then text, nulls first. Places come from counts by block of turn numbers, and ranks within a block, so a
    conversation of any length is ranked in parts. Texts are read again only for turns that share number and role.
    """
    rows = turns.select("conv_id", "turn", "role", text_hash(F.col("text")).alias("th")).where(F.col("conv_id").isNotNull()).distinct()
    rows = materialize(rows, "distinct-turns")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("conv_id", "turn", "role")]
    several = rows.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = materialize(several, "turns-of-one-number")
    texts = turns.select("conv_id", "turn", "role", "text", text_hash(F.col("text")).alias("th")).alias("m").join(small_or_shuffled(several, 64).alias("s"), same[0] & same[1] & same[2], "left_semi").distinct()
    ties = W.Window.partitionBy("conv_id", "turn", "role").orderBy(F.col("text").asc_nulls_first())
    ties = texts.select("conv_id", "turn", "role", "th", F.row_number().over(ties).alias("tie")).alias("s")
    rows = rows.alias("m").join(ties, same[0] & same[1] & same[2] & (F.col("m.th") == F.col("s.th")), "left").select("m.*", F.coalesce("s.tie", F.lit(0)).alias("tie"))
    rows = rows.withColumn("block", turn_block(F.col("turn")))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.Window.partitionBy("conv_id").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "tie"))
    return rows.withColumn("rank", rank).join(offsets, ["conv_id", "block"]).select("conv_id", (F.col("offset") + F.col("rank") - 1).alias("place"), "role", "th")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, a, b): the rolling hash of the first k turns, for every k.

    It is the sum of the turns' hashes, each salted with its place. Sums run within blocks of places; what
    comes before a block is a sum over whole blocks.
    """
    role = F.col("role")
    mix = F.struct(*[F.xxhash64(F.lit(salt), F.col("place"), role.isNull(), role, F.col("th.x"), F.col("th.y")).alias(n) for n, salt in (("a", 1), ("b", 2))])
    rows = turns.select("conv_id", "place", F.floor(F.col("place") / BLOCK).alias("block"), mix.alias("h"))
    # decimals hold the sums, which long arithmetic in ANSI mode would refuse; modulo 2^63 they stay long
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    rows = rows.select("conv_id", "place", "block", wide("h.a").alias("a"), wide("h.b").alias("b"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = W.Window.partitionBy("conv_id").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"])
    within = W.Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.Window.unboundedPreceding, 0)
    summed = rows.select("conv_id", "place", "block", *[F.sum(c).over(within).alias(c) for c in "ab"]).join(carried, ["conv_id", "block"])
    modulus = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return summed.select("conv_id", (F.col("place") + 1).alias("k"), *[F.pmod((F.col(c) + F.col(f"{c}0")).cast("decimal(38,0)"), modulus).cast("long").alias(c) for c in "ab"])


def maximal(turns: DataFrame) -> DataFrame:
    """The conv_id of each conversation that no other continues, or repeats under a smaller conv_id."""
    hashes = materialize(prefix_hashes(placed(turns)), "prefix-hashes")
    last = hashes.groupBy("conv_id").agg(F.max(F.struct("k", "a", "b")).alias("x")).select("conv_id", "x.*")
    # of equal conversations the smallest id stays
    first = last.groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    # prefixes that some conversation goes on from; each hash once, however many share it
    ends = last.select("conv_id", F.col("k").alias("n"))
    inner = hashes.join(ends, "conv_id").where(F.col("k") < F.col("n")).select("k", "a", "b").distinct()
    return first.join(inner, ["k", "a", "b"], "left_anti").select("conv_id")


def render(turns: DataFrame, start: str = "<|", close: str = "|>\n", end: str = "\n") -> DataFrame:
    """(conv_id, n_turns, text): each turn as start + role + close + text + end; null roles and texts as empty."""
    part = lambda x: F.concat(F.lit(start), F.coalesce(x["role"], F.lit("")), F.lit(close), F.coalesce(x["text"], F.lit("")), F.lit(end))
    rows = turns.select("conv_id", turn_block(F.col("turn")).alias("block"), F.struct("turn", "role", "text").alias("t"))
    # turns are put together by block first; the whole text of a conversation is one value in any case
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["part"]), "")
    sets = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    blocks = sets.select("conv_id", F.struct("block", F.array_join(F.transform("ts", part), "").alias("part")).alias("b"), F.size("ts").cast("long").alias("n"))
    return blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined(F.array_sort(F.collect_list("b"))).alias("text"))


def format_chats(conversations: DataFrame, **template) -> DataFrame:
    """One row a maximal conversation: conv_id, n_turns, text.

    Turns are in order of turn number, role and text, nulls first; equal turns count once. Null roles and texts show
    as empty, yet a null text is another turn than an empty one. Turns and texts of any length stay whole. Rows without
    conv_id are left out; other columns have no effect, whatever their names; an empty table gives no rows.
    """
    kept = materialize(maximal(conversations), "maximal-conversations")
    return render(conversations.join(small_or_shuffled(kept, 16), "conv_id", "left_semi"), **template)
