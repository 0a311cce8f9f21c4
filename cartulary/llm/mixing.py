"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to 1 as the token constraints allow, in relative entropy: the solution is an
exponential tilt, rate = exp(lambda * x), with one dual variable lambda for each source and x the document's
size over its source's token-weighted mean size. A rate never exceeds the cap. Newton steps on the convex
dual are sums over all documents, made on the executors; rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import WORD, drop, fresh, materialize, row_hash, small_or_shuffled

#: Documents that are rounded together, about.
BUCKET = 4096


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Distinct rows as (doc_id, rh, source, size, copies_in): size counts words, copies_in equal rows."""
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_hash(docs, text, source).alias("rh"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    return rows.groupBy("doc_id", "rh", "source", "size").agg(F.count(F.lit(1)).alias("copies_in"))


def exact_sum(value: Column, digits: int = 9) -> Column:
    """A sum that is the same whatever the order in which rows arrive: of decimals, given as a double."""
    return F.sum(value.cast(f"decimal(38,{digits})")).cast("double")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with sid, their place by code point, null last: ranges are sorted apart, and what comes before each is added."""
    dealt = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, [(-1, 0)]
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    place = F.row_number().over(W.Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    first = dealt.sparkSession.createDataFrame(offsets, "part int, before long")
    return dealt.withColumn("place", place).join(first, "part").withColumn("sid", F.col("before") + F.col("place")).drop("part", "place", "before")


def targets(units: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: sid, source, source_size, n_units, mean_size, target.

    Sources in code point order, null last, get the weights in turn and share total * all words by weight. A
    target stops at cap * its source's size; the excess goes to the others by weight until none is above. That
    fixed point gives every uncapped source level * weight. Each round is one sum over the sources: the level that
    the sources below it, at their caps, leave to the others; it rises until no more sources lie below.
    """
    square = F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)")
    stats = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies_in")).alias("source_size"),
        F.sum("copies_in").alias("n_units"),
        exact_sum(square * F.col("copies_in"), 0).alias("squares"),
    )
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = numbered(stats).withColumn("w", weight).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    ranked = materialize(ranked, "mix-weights")
    level, words = -math.inf, ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        capped = F.col("ratio") < F.lit(level)
        held = ranked.agg(F.sum(F.when(capped, F.col("source_size"))).alias("size"), exact_sum(F.when(~capped, F.col("w"))).alias("w")).first()
        after = (total * words - cap * (held["size"] or 0)) / held["w"] if held["w"] else math.inf
        if after <= level or not held["w"]:
            break
        level = after
    if not held["w"]:
        level = math.inf
    return ranked.select(
        "sid",
        "source",
        "source_size",
        "n_units",
        F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).alias("mean_size"),
        F.least("most", F.lit(level) * F.col("w")).alias("target"),
    )


def solve(units: DataFrame, aims: DataFrame, cap: float = 2.0, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """aims with `tilt`, the dual variable of each source: null where nothing is taken, infinity where all rates are the cap.

    Each round is one aggregation over (source, size) counts: the words that the present tilt takes, and their
    slope, in exact sums, so that the tilts depend on the rows alone. A Newton step that leaves the bracket around the root is replaced by the bracket's middle.
    """
    histogram = materialize(units.groupBy("source", "size").agg(F.sum("copies_in").alias("n")).where(F.col("size") > 0), "sizes")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    tilt = F.when((F.col("source_size") <= 0) | (F.col("target") <= 0), F.lit(None)).when(full, F.lit(math.inf))
    state = materialize(
        aims.withColumn("tilt", tilt.otherwise(F.log(F.col("target") / F.col("source_size"))))
        .withColumn("low", F.lit(-math.inf))
        .withColumn("high", F.lit(math.inf))
        .withColumn("open", F.col("tilt").isNotNull() & ~full),
        "tilts",
    )
    for _ in range(rounds):
        if not state.where("open").limit(1).count():
            break
        rows = histogram.alias("h").join(
            small_or_shuffled(state.where("open").select("source", "mean_size", "tilt"), 64).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))
        )
        x = F.col("h.size") / F.col("s.mean_size")
        raw = F.exp(F.least(F.col("s.tilt") * x, F.lit(700.0)))
        words = F.col("h.n") * F.col("h.size")
        sums = rows.groupBy(F.col("h.source").alias("source")).agg(
            exact_sum(words * F.least(F.lit(cap), raw)).alias("taken"), exact_sum(F.when(raw < cap, words * x * raw).otherwise(0.0)).alias("slope")
        )
        joined = state.alias("a").join(sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
        off = F.col("taken") - F.col("target")
        low = F.when(F.col("open") & (off < 0), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("open") & (off >= 0), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - off / F.nullif(F.col("slope"), F.lit(0.0))
        # inside the bracket Newton's step; else its middle, or a doubling step where one side is still open
        middle = F.when(F.col("low") == -math.inf, F.col("high") - 1 - F.abs("high")).when(F.col("high") == math.inf, F.col("low") + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        stepped = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise(middle)
        done = F.abs(off) <= tolerance * F.col("target")
        after = joined.select("a.sid", "a.source", "source_size", "n_units", "mean_size", "target", "tilt", low.alias("low"), high.alias("high"), (F.col("open") & ~done).alias("open"), newton.alias("newton"))
        after = after.select(*[c for c in after.columns if c not in ("tilt", "newton")], F.when(F.col("open"), stepped).otherwise(F.col("tilt")).alias("tilt"))
        last, state = state, materialize(after.select(*state.columns), "tilts")
        drop(last)
    drop(histogram)
    return state.select("sid", "source", "source_size", "n_units", "mean_size", "target", "tilt")


def rounded(units: DataFrame, solved: DataFrame, cap: float = 2.0) -> DataFrame:
    """units with sid, source_size, target, rate and copies, whole copies of 0 to cap.

    Documents of a source are dealt by a hash of their content into buckets of about 4096. In a bucket, from
    the largest document to the smallest, the words that rounding took too many or too few carry over to the
    next, so that a bucket misses its share by about half its smallest document.
    """
    most = int(cap)

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "rh"], ascending=[False, True, True], kind="stable")
        owed, copies = 0.0, []
        for rate, size, times in zip(rows["rate"], rows["size"], rows["copies_in"], strict=True):
            words = size * times
            wanted = rate * words + owed
            n = min(max(int(math.floor(wanted / words + 0.5)), 0), most) if words else 0
            owed = wanted - n * words
            copies.append(n)
        return rows.assign(copies=copies)

    marks = small_or_shuffled(solved, 96)
    u, s = units.alias("u"), marks.alias("s")
    rate = F.when(F.col("s.tilt").isNull(), 0.0).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("s.tilt") * F.col("u.size") / F.col("s.mean_size"), F.lit(700.0)))))
    buckets = F.ceil(F.col("s.n_units") / BUCKET)
    rows = u.join(s, F.col("u.source").eqNullSafe(F.col("s.source"))).select(
        "u.*", "s.sid", "s.source_size", "s.target", F.when(F.col("u.size") > 0, rate).otherwise(0.0).alias("rate"), F.pmod(F.xxhash64("u.doc_id", "u.rh"), buckets).alias("bucket")
    )
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", copies long"
    return rows.groupBy("sid", "bucket").applyInPandas(carry, schema).drop("bucket")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), total: float = 1.5, cap: float = 2.0, text: str = "text", source: str = "source") -> DataFrame:
    """Copies for each distinct row: doc_id, rh, source, size, copies_in, sid, source_size, target, rate, copies.

    Equal rows (copies_in of them) get the same number of copies each. Documents without words are never
    taken. A null source is a source, the last; an empty table gives no rows. The result depends on the rows
    alone, so reruns agree.
    """
    units = materialize(sized(docs, text, source), "mix-units")
    aims = materialize(targets(units, weights, total, cap), "mix-targets")
    return rounded(units, solve(units, aims, cap), cap)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns stay as they are."""
    plan = materialize(mix(docs, **how).where("copies > 0").select("doc_id", "rh", "copies"), "mix-copies")
    rh, copy = fresh(docs, "rh", "copy")
    own = {k: how[k] for k in ("text", "source") if k in how}
    d, p = docs.withColumn(rh, row_hash(docs, **own)).alias("d"), small_or_shuffled(plan, 24).alias("p")
    joined = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col(f"d.{rh}") == F.col("p.rh")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("p.copies"))).alias(copy)).drop(copy)
