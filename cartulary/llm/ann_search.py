"""Nearest neighbours by inner product: probed lists, and an adaptive scan of rotated dimensions within each.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the smallest
distance. Centroids deal them to lists; a query scans the lists whose centroids are nearest. In a list,
vectors and query are turned by a random rotation and compared column block by column block. After each
block a hypothesis test on the partial distance abandons candidates that will hardly reach the best so far:
at d of D columns, those whose distance, scaled by D / d, exceeds the limit by (1 + epsilon / sqrt(d))^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import materialize

#: Vectors, and queries, that meet in one task's block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Columns of each step of the scan, and vectors after which a block's limits tighten.
STEP, CHUNK = 16, 1024
#: The test's width; at 2.1, the usual choice, a true neighbour is abandoned about once in a thousand.
EPSILON = 2.1
SAMPLE, MAX_LISTS = 16_384, 1024


def numbers(vectors: DataFrame, embedding: str) -> str:
    """The type in which vectors are kept: float stays float, all else is double."""
    return "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids and
    vectors whose length isn't the most frequent one (the longest of equally frequent ones).
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast(numbers(vectors, embedding)).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))
    lengths = rows.groupBy(F.size(e).alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return rows.where(F.size(e) == (lengths.m.d if lengths.m else 0))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings their norm to `top`."""
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))])


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means on the bounded sample; an empty list keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(sample, c, 1)[:, 0]
        n = np.bincount(own, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    return np.argsort(0.5 * (c * c).sum(1) - x @ c.T, axis=1, kind="stable")[:, :k]


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), dims)


def scan(q: np.ndarray, v: np.ndarray, top: float, turn: np.ndarray, k: int, epsilon: float = EPSILON, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query (row of q, ascending) and a place in v that may be among its k nearest, ties of the k-th included.

    known: for each query a squared distance within which it has k vectors elsewhere, or infinity. Without it never
    fewer than k, or all of v. Vectors come in chunks: the first is compared in full where nothing is known, and
    each later one against the limit that those before it left. A candidate that fails a test is gone.
    """
    rq, rv = np.column_stack([q, np.zeros(len(q))]) @ turn, lifted(v, top) @ turn
    dims, slack = rv.shape[1], 1e-9 * top * top
    limit = np.full(len(q), np.inf) if known is None else known.astype(np.float64)
    best = np.full((len(q), k), np.inf)
    rows, places, dists = [], [], []

    def partial(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)

    def bound(end: int, of: np.ndarray) -> np.ndarray:
        return limit[of] * (end / dims) * ((1 + epsilon / np.sqrt(end)) ** 2 if end < dims else 1) + slack

    def near(first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of queries and vectors of a chunk that pass all tests, and their squared distances."""
        queries, vectors = np.arange(len(q)), np.arange(first, last)
        sums, alive, end = np.zeros((len(q), last - first)), np.ones((len(q), last - first), dtype=bool), 0
        # matrix products while many pairs are left, over the queries and vectors that still have some
        while end < dims and alive.sum() >= 0.1 * alive.size:
            start, end = end, min(dims, end + STEP)
            sums += partial(rq[queries, start:end], rv[vectors, start:end])
            alive &= sums <= bound(end, queries)[:, None]
            used, held = alive.any(1), alive.any(0)
            if used.mean() < 0.9 or held.mean() < 0.9:
                queries, vectors = queries[used], vectors[held]
                sums, alive = sums[used][:, held], alive[used][:, held]
            if not alive.size:
                break
        row, col = np.nonzero(alive)
        left, row, col = sums[row, col], queries[row], vectors[col]
        while end < dims and len(row):
            start, end = end, min(dims, end + STEP)
            left = left + ((rq[row, start:end] - rv[col, start:end]) ** 2).sum(1)
            stay = left <= bound(end, row)
            row, col, left = row[stay], col[stay], left[stay]
        return row, col, left

    at, size = 0, max(4 * k, 256)
    while at < len(v):
        row, col, left = near(at, min(len(v), at + size))
        at, size = at + size, CHUNK
        rows.append(row)
        places.append(col)
        dists.append(left)
        if len(row):
            # each query's k smallest so far, with those of this chunk
            order = np.lexsort((left, row))
            row, left = row[order], left[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            fresh = np.full((len(q), k), np.inf)
            fresh[row[rank < k], rank[rank < k]] = left[rank < k]
            best = np.sort(np.hstack([best, fresh]), axis=1)[:, :k]
            limit = np.minimum(limit, best[:, -1])
    row, col, left = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, places, dists))
    stay = left <= limit[row] + slack if len(row) else np.empty(0, dtype=bool)
    row, col = row[stay], col[stay]
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both in double precision, each summed alike wherever its vector lies."""
    return (v * q).sum(axis=1)


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.96, vec_id: str = "vec_id", embedding: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, every usable vector whose id % every = 0.

    All usable vectors but the query's own id are candidates. Score is the inner product of the original
    vectors in double precision; nearest first, ties to the smaller vec_id. Repeated rows are candidates each;
    of query rows of one id the smallest vector asks.
    Centroids are fitted on a sample of up to 16,384 vectors (the lowest hashes of ids). How many lists a
    query probes is set by measurement: up to 64 sampled queries are compared with every vector, and the
    probes are as many as find `recall` of their true neighbours. A query whose lists hold fewer than k
    candidates probes its next lists until they hold k. Its first lists leave the limit with which the others
    are scanned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, vec_id, embedding), "vectors")
    kept = numbers(vectors, embedding)
    out_schema = "query_id long, rank int, vec_id long, score double"
    facts = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.max(F.size("embedding"))).first()
    total, dims = facts[0], facts[2]
    if not total:
        return spark.createDataFrame([], out_schema)
    top = float(np.sqrt(facts[1])) * (1 + 1e-12)
    lists = int(min(MAX_LISTS, max(1, round(np.sqrt(total)))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, 64 * lists)).toPandas()
    sample = matrix(drawn["embedding"], dims)
    lists = min(lists, len(sample))
    index = spark.sparkContext.broadcast((fit_centroids(lifted(sample, top), lists), top, rotation(dims + 1)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, norm, _ = index.value
        for b in batches:
            if len(b):
                own = nearest(lifted(matrix(b["embedding"], dims), norm), centroids, 1)[:, 0]
                yield b.assign(list=own.astype(np.int32))

    dealt = materialize(rows.mapInPandas(deal, f"vec_id long, embedding {kept}, list int"), "vector-lists")
    asking = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).cast("int").alias("copies"))
    probes = _probes(dealt, asking, index, dims, lists, k, recall)

    held = np.zeros(lists, dtype=np.int64)
    for r in dealt.groupBy("list").count().collect():  # one row a list, MAX_LISTS at most
        held[r["list"]] = r["count"]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = index.value[0]
        for b in batches:
            if len(b):
                x = matrix(b["embedding"], dims)
                near = nearest(np.column_stack([x, np.zeros(len(x))]), centroids, lists)
                copies = b["copies"].to_numpy()
                # the first lists of a query are those that together hold k rows besides its own
                before = np.cumsum(held[near], axis=1) - held[near]
                first = before < k + copies[:, None]
                take = (np.arange(lists) < probes) | first
                times = take.sum(1)
                yield pd.DataFrame({"query_id": np.repeat(b["vec_id"].to_numpy(), times), "query": np.repeat(np.array(b["embedding"], dtype=object), times), "copies": np.repeat(copies, times), "list": near[take].astype(np.int32), "first": first[take]})

    routed = materialize(asking.mapInPandas(route, f"query_id long, query {kept}, copies int, list int, first boolean"), "routed-queries")
    sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            _, norm, turn = index.value
            q, v = matrix(asked["query"], dims), matrix(held["embedding"], dims)
            ids, names, copies = held["vec_id"].to_numpy(), asked["query_id"].to_numpy(), asked["copies"].to_numpy()
            # from the score of the k-th found elsewhere, the distance that a vector must not exceed
            known = (q * q).sum(1) + norm * norm - 2 * asked["least"].fillna(-np.inf).to_numpy(dtype=np.float64)
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                row, col = scan(q[part], v, norm, turn, k + int(copies[part].max()), epsilon, known[part])
                other = ids[col] != names[part][row]
                row, col = row[other], col[other]
                score = np.concatenate([np.empty(0), *(exact(q[part][row[s : s + 65536]], v[col[s : s + 65536]]) for s in range(0, len(row), 65536))])
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"query_id": names[part][row[first]], "vec_id": ids[col[first]], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    def scanned(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of queries in their lists; asked: query_id, query, copies, list, least."""
        counted = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qblocks"))
        # one row a list, MAX_LISTS at most; a list too large for one task is cut into blocks, and so are its queries
        shape = F.broadcast(sizes.join(counted, "list"))
        parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(shape, "list").select("list", "query_id", "query", "copies", "least", F.pmod(F.xxhash64("query_id"), "qblocks").cast("int").alias("qblock"), parts("blocks").alias("block"))
        right = dealt.join(shape, "list").select("list", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), parts("qblocks").alias("qblock"))
        return left.groupBy("list", "block", "qblock").cogroup(right.groupBy("list", "block", "qblock")).applyInPandas(best, "query_id long, vec_id long, score double")

    def top_k(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.where(F.col("rank") <= k)

    # a query's first lists leave the limit with which its others are scanned
    near = materialize(top_k(scanned(routed.where("first").withColumn("least", F.lit(None).cast("double")))).drop("rank"), "first-neighbours")
    limits = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    more = scanned(routed.where("NOT first").join(limits, "query_id", "left"))
    return top_k(near.unionByName(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _probes(dealt: DataFrame, asking: DataFrame, index, dims: int, lists: int, k: int, recall: float) -> int:
    """How many lists to probe: measured on up to 64 queries against every vector; all of them for a recall of 1."""
    if recall >= 1:
        return lists
    some = asking.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(64).toPandas()
    if not len(some):
        return 1
    q = matrix(some["embedding"], dims)
    names = some["vec_id"].to_numpy()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            score = q @ matrix(b["embedding"], dims).T
            score[names[:, None] == b["vec_id"].to_numpy()[None, :]] = -np.inf
            n = min(k, len(b))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), n), "score": np.take_along_axis(score, top, 1).ravel(), "list": b["list"].to_numpy()[top].ravel()})

    true = dealt.mapInPandas(compare, "q long, score double, list int")
    true = true.withColumn("r", F.row_number().over(W.Window.partitionBy("q").orderBy(F.desc("score"), "list"))).where(F.col("r") <= k).where("score > double('-inf')").toPandas()
    order = nearest(np.column_stack([q, np.zeros(len(q))]), index.value[0], lists)
    place = np.argsort(order, axis=1)[true["q"].to_numpy(), true["list"].to_numpy()]
    if not len(place):
        return 1
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
