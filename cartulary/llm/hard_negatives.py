"""Hard negatives by inner product: candidates sorted by norm into buckets, which length bounds prune.

A score is at most the product of both norms. Candidates are sorted by norm and cut into buckets, anchors into blocks;
a block meets only the buckets whose largest norm allows a score that it can still use. Positives are the best of an
anchor's own label, so their buckets are cut within labels and the limit is the k-th score so far. Each positive score
p then opens a window from low % of p to p for negatives; its limit is the window's lower end, or the k-th score found
in it so far if that is more. The buckets of the largest norms come first and leave the limits for all others. Within a
bucket, chunks go by descending norm as well, and an anchor whose bound falls short of its limits leaves.

Components are scaled and floored, so scores are whole numbers; they are exact whatever the order of summing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import materialize

#: Candidates of a bucket, anchors of a block, and candidates after which limits tighten.
BUCKET, BLOCK, CHUNK = 8192, 2048, 1024
#: Squared scaled lengths stay below, so that 100 times a score fits a long.
LONGEST = float(1 << 56)
#: Beyond this, double precision doesn't hold each whole number.
EXACT = float(1 << 53)
NOTHING, ANYTHING = -(1 << 62), 1 << 62
#: Bounds are taken so much larger that rounding of norms prunes nothing.
SLACK = 1 + 1e-9


def usable(vectors: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part; v: floor(scale * x) of each component.

    Rows take no part whose id, label, vector or any component is null, or any component not finite; nor those without
    components, of another number of components than most rows have (the larger one of equally frequent ones), or of a
    squared scaled length of 2^56 or more, whose scores might not fit a long.
    """
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.transform(F.when(finite, e), lambda x: F.lit(scale) * x.cast("double")).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda x: F.abs(x) < float(1 << 28)))
    whole = rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x)).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = whole.withColumn("norm", F.sqrt(length)).where(F.col("norm") < LONGEST**0.5)
    sizes = whole.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return whole.where(F.size("v") == (sizes.m.d if sizes.m else 0))


def cut(rows: DataFrame, order: Sequence[Column], size: int, total: int, name: str, column: str) -> DataFrame:
    """rows in a global order, cut into pieces of `size` rows at most: (part, column) names the piece."""
    parts = max(1, min(-(-total // size), 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = F.monotonically_increasing_id()  # the task's number, then the row's within it, of 33 bits
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", place)
    named = placed.withColumns({"part": F.shiftright("at", 33).cast("int"), column: F.expr(f"(at & {(1 << 33) - 1}) div {size}") + F.shiftleft(F.shiftright("at", 33), 33)}).drop("at")
    return materialize(named, name)


def matrix(table: pa.Table, dims: int) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(table.num_rows, dims)


def products(a: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Whole inner products; by double precision where that is exact, else in 64-bit integers."""
    return (a @ v.T).astype(np.int64) if most < EXACT else a.astype(np.int64) @ v.astype(np.int64).T


def best_of(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each row, by descending score, then id; rows ascend."""
    order = np.lexsort((ids, -score, row))
    ranked = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def scan(a: np.ndarray, a_ids: np.ndarray, a_norm: np.ndarray, a_label: np.ndarray, high: np.ndarray, low: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_norm: np.ndarray, v_label: np.ndarray, k: int, same: bool):
    """(row of a, window, row of v, score): each window's k best scores from low to high, of same or other labels.

    high, low: a row an anchor, a column a window; a window whose low exceeds its high is none. Candidates of the
    anchor's own id don't count. Fewer than k if there are no more; low rises to the k-th score found so far.
    """
    order = np.lexsort((v_ids, -v_norm))
    high, low = high.copy(), low.copy()
    high[high < low], low[high < low] = NOTHING, ANYTHING
    none = np.empty(0, np.int64)
    found = [(none, none, none) for _ in range(high.shape[1])]
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        bound = a_norm * v_norm[part[0]] * SLACK
        alive = np.flatnonzero(bound >= low.min(axis=1))
        if not len(alive):
            break  # later chunks are shorter still
        s = products(a[alive], v[part], float(a_norm[alive].max() * v_norm[part[0]]))
        r, c = np.nonzero((s >= low[alive].min(axis=1)[:, None]) & (s <= high[alive].max(axis=1)[:, None]))
        score, r, c = s[r, c], alive[r], part[c]
        fit = ((a_label[r] == v_label[c]) == same) & (a_ids[r] != v_ids[c])
        score, r, c = score[fit], r[fit], c[fit]
        for w in range(high.shape[1]):
            mine = (score >= low[r, w]) & (score <= high[r, w])
            if mine.any():
                rows, places, scores = (np.concatenate(x) for x in zip(found[w], (r[mine], c[mine], score[mine]), strict=True))
                top = best_of(rows, scores, v_ids[places], k)
                rows, places, scores = found[w] = rows[top], places[top], scores[top]
                last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True))
                full = last[np.diff(np.append(-1, last)) == k]
                low[rows[full], w] = np.maximum(low[rows[full], w], scores[full])
    window = np.concatenate([np.full(len(f[0]), w) for w, f in enumerate(found)])
    rows, places, scores = (np.concatenate([f[i] for f in found]) for i in range(3))
    return rows, window, places, scores


def _meet(asked: DataFrame, held: DataFrame, tiles: DataFrame, keys: Sequence[str], dims: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, high, vec_id, score) of blocks of anchors and buckets of candidates that meet in a tile."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "high", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        of = lambda t, c: t.column(c).to_numpy()
        # windows of each anchor as a rectangle; short rows end in windows that hold nothing
        highs, lows = left.column("highs").to_pylist(), left.column("lows").to_pylist()
        width = max(map(len, highs))
        high = np.array([x + [NOTHING] * (width - len(x)) for x in highs], dtype=np.int64)
        low = np.array([x + [ANYTHING] * (width - len(x)) for x in lows], dtype=np.int64)
        rows, window, places, scores = scan(matrix(left, dims), of(left, "anchor_id"), of(left, "norm"), of(left, "label"), high, low, matrix(right, dims), of(right, "vec_id"), of(right, "norm"), of(right, "label"), k, same)
        return pa.table({"anchor_id": of(left, "anchor_id")[rows], "high": high[rows, window], "vec_id": of(right, "vec_id")[places], "score": scores})

    every = ["block", "bucket", *keys]
    left = asked.join(tiles, ["block", *keys]).select(*every, *[c for c in asked.columns if c not in every])
    again = tiles.select(*[F.col(c).alias(c) for c in tiles.columns])  # as columns of its own, so that the sides differ
    right = held.join(again, ["bucket", *keys]).select(*every, *[c for c in held.columns if c not in every])
    return left.groupBy(*every).cogroup(right.groupBy(*every)).applyInArrow(tile, "anchor_id long, high long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with its rank among an anchor's window, up to k."""
    order = W.Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(asked: DataFrame, held: DataFrame, keys: Sequence[str], dims: int, k: int, same: bool, name: str) -> DataFrame:
    """The k best of each window; asked: block, part, anchor_id, label, v, norm, highs, lows; held: bucket, part, vec_id, ...

    Blocks and buckets are paired by their bounds alone, and only where a bound reaches the block's lowest limit.
    """
    norms = held.groupBy("part", "bucket", *keys).agg(F.max("norm").alias("longest"))
    buckets = materialize(norms, f"{name}-buckets")
    parts = buckets.agg(F.max("part")).first()[0]

    def tiles(limits: DataFrame, first: bool) -> DataFrame:
        """(block, bucket, keys): the bucket of the largest norms of each, or all others that the limits leave."""
        blocks = limits.groupBy("block", *keys).agg(F.max("norm").alias("norm"), F.min(F.array_min("lows")).alias("low"))
        if keys:
            met = blocks.join(buckets, list(keys))
        else:
            # parts are as many as tasks, so blocks are dealt to each; rows of both are one a block or bucket
            met = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))).join(buckets, "part")
        top = buckets.groupBy(*keys).agg(F.max_by("bucket", F.struct("longest", -F.col("bucket"))).alias("top"))
        met = met.join(top, list(keys)) if keys else met.withColumn("top", F.lit(top.first()["top"]))
        met = met.where((F.col("bucket") == F.col("top")) if first else ((F.col("bucket") != F.col("top")) & (F.col("norm") * F.col("longest") * SLACK >= F.col("low"))))
        return met.select("block", "bucket", *keys)

    before = materialize(_first(_meet(asked, held, tiles(asked, True), keys, dims, k, same), k).drop("rank"), f"{name}-first")
    # windows that hold k already start from the k-th
    reached = before.groupBy("anchor_id", "high").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = reached.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("high", "kth"))).alias("kths"))
    raised = F.zip_with("highs", "lows", lambda h, lo: F.greatest(lo, F.coalesce(F.try_element_at("kths", h), lo)))
    tight = asked.join(known, "anchor_id", "left").withColumn("lows", F.when(F.col("kths").isNull(), F.col("lows")).otherwise(raised)).drop("kths")
    tight = materialize(tight, f"{name}-limits")
    after = _meet(tight, held, tiles(tight, False), keys, dims, k, same)
    return _first(before.unionByName(after), k)


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the usable rows whose id % every = 0. A row's score is its inner product with the anchor over scaled,
    floored components; higher scores come first, ties by the smaller id. An anchor's positives are its first other
    rows of its label; for each of them come the first rows of other labels whose score lies from low % of the
    positive's score up to it. An anchor without positives, or a positive without such rows, gives none.
    Repeated rows are candidates each; of rows of an anchor's id, the one of smallest label and vector asks, and none
    is a candidate. See usable() for the rows that take no part. An empty table gives no rows; other columns go.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(usable(vectors, scale, vec_id, embedding, label), "scaled-vectors")
    total, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm")).alias("r"))
    asking = asking.select(F.col("vec_id").alias("anchor_id"), "r.label", "r.v", "r.norm")
    anchors = -(-total // every)
    window = {"highs": F.array(F.lit(ANYTHING)), "lows": F.array(F.lit(NOTHING))}
    mates = cut(rows, [F.col("label"), F.desc("norm"), F.col("vec_id")], BUCKET, total, "label-buckets", "bucket")
    asked = cut(asking.withColumns(window), [F.col("label"), F.desc("norm"), F.col("anchor_id")], BLOCK, anchors, "anchors", "block").drop("part")
    found = materialize(_search(asked, mates, ["label"], dims, positives, True, "positives").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the least whole number that is low % of p or more
    least = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100L)) div 100)")
    opened = found.select("anchor_id", "positive_score", least.alias("low")).where("low <= positive_score").distinct()
    opened = opened.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_score", "low"))).alias("w"))
    windows = opened.select("anchor_id", F.col("w.positive_score").alias("highs"), F.col("w.low").alias("lows"))
    others = cut(rows, [F.desc("norm"), F.col("vec_id")], BUCKET, total, "norm-buckets", "bucket")
    asked = materialize(asked.drop("highs", "lows").join(windows, "anchor_id"), "windows")
    near = _search(asked, others, [], dims, negatives, False, "negatives")
    near = near.select("anchor_id", F.col("high").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
