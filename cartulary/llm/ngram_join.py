"""Jaccard self-join of documents on word 5-grams, by vertical partitioning of the global n-gram order.

1. Fragments are ranges of the n-gram hashes. Batches of documents send each fragment the n-grams they hold;
   the fragment counts in how many documents each occurs, and answers with those that occur in two or more.
   An n-gram of one document adds to no overlap, so a document with fewer than 0.8 of its n-grams repeated
   has no link and leaves here. Documents of equal sets become one class, and the counts are made anew.
2. The global order is by document frequency, then hash. Two linked classes share an n-gram among the first
   n - ceil(0.8 n) + 1 of the larger set and the first m - ceil(1.6 m / 1.8) + 1 of the smaller one, of m n-grams:
   the smaller set's short prefix is its index. An n-gram of one is a bucket; its hub is the most typical set with
   it in a prefix, that of the most frequent n-grams, to which near copies of one text are likeliest linked. Each
   member is paired with its hub. A pair's overlap is counted fragment by fragment and summed.
   Equally long texts of one template that aren't linked differ in more than their index, so they make no bucket.
3. Members that these links leave outside their hub's component get the most typical of themselves as a second hub,
   and so on for a few rounds: groups that share a hub without links to it find together without all their pairs.
4. Two members of a star in different components might still be linked, if the smaller one has a bucket in its
   index. They meet by star and size band, one of them being outside the hub's component. Their overlap is at most
   what both share with the hub plus what both hold, repeated, outside it; pairs that reach the threshold by this
   bound are counted as well. So no link between different components is lost.
5. Components of the links, by alternating stars.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import drop, free_memory, fresh, materialize, small_or_shuffled
from cartulary.llm.packing import U64, Reader, mix64, pack, pack_sorted, range_of, runs

WORDS = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: N-grams that a batch of documents holds at most (one longer document is a batch of its own), and a fragment about.
BATCH, FRAGMENT = 600_000, 1_200_000
IDS = 1 << 16
#: Rounds of further hubs; pairs that they don't settle are counted one by one.
ROUNDS = 2
DOCS, REQUEST, REPLY = 0, 1, 2
#: Bytes that sign a batch, in front of each of its blobs.
SIGN = 8
OTHER_ORDER = "a task that ran again met its documents in another order; write them to a table first"
SET_SCHEMA = "doc_id long, node binary, n long, grams array<long>, freqs array<long>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def distinct_keys(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams with the places of their texts, each pair once, in the order of both; owner ascends."""
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    keep = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
    return grams[keep], owner[keep]


def gram_keys(texts: list[str | None], hashes: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word 5-grams of each text, as 64-bit hashes with the place of the text; a shorter text is one gram."""
    if len(hashes) > 150_000:
        hashes.clear()
    flat = [np.empty(0, dtype=U64)]
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        flat.append(np.fromiter(map(hashes.__getitem__, found), dtype=U64, count=len(found)))
    sizes = np.array([len(x) for x in flat[1:]], dtype=np.int64)
    words = np.concatenate(flat)
    starts = np.cumsum(sizes) - sizes
    grams = np.maximum(sizes - (WORDS - 1), np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), grams)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    left = np.minimum(sizes, WORDS)[owner]
    with np.errstate(over="ignore"):
        h = left.astype(U64)  # a gram of fewer words differs from all of five
        for k in range(WORDS):
            used = left > k
            h = np.where(used, mix64(h * U64(0x9E3779B97F4A7C15) + words[np.where(used, at + k, 0)]) if len(words) else h, h)
    return distinct_keys(h, owner.astype(U64))


def _signatures(grams: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each text's set, and 128 bits that tell sets apart."""
    owner = owner.astype(np.int64)
    order = np.argsort(owner, kind="stable")
    grams = grams[order]
    n = np.bincount(owner, minlength=n_docs)
    out = np.zeros((n_docs, 2), dtype=U64)
    if len(grams):
        filled = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[filled]
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                out[filled, k] = np.add.reduceat(mix64(grams + U64(salt)), starts)
    return n, out


def _sign(n: np.ndarray, signatures: np.ndarray) -> bytes:
    """Tells a batch from another of the same number: a task that runs again may meet its rows in another order."""
    return xxhash.xxh3_64_digest(np.ascontiguousarray(n, dtype=np.int64).tobytes() + np.ascontiguousarray(signatures).tobytes())


def _requests(batch: int, ids: list, n: np.ndarray, signatures: np.ndarray, grams: np.ndarray, owner: np.ndarray, fragments: int) -> list[tuple]:
    """Rows of one batch: its documents and locally repeated grams for itself, and its distinct grams for the fragments."""
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
    times = np.diff(np.append(starts, len(grams)))
    once = times == 1
    single, holder = grams[starts[once]], owner[starts[once]]
    many, count = grams[starts[~once]], times[~once]
    held = owner[np.repeat(times > 1, times)]
    known = np.array([i is not None for i in ids], dtype=U64)
    sign = _sign(n, signatures)
    # two's complement, so that negative ids pack as well
    number = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(U64)
    mine = b"".join((pack(number), pack(known), pack(n), pack(signatures[:, 0]), pack(signatures[:, 1]), pack_sorted(many), pack(count), pack(held)))
    rows = [(-1 - batch, batch, DOCS, sign + mine)]
    parts: dict[int, list[bytes]] = defaultdict(lambda: [pack_sorted(single[:0]) + pack(holder[:0]), pack_sorted(many[:0]) + pack(count[:0])])
    for f, s, e in runs(range_of(single, fragments)):
        parts[f][0] = pack_sorted(single[s:e]) + pack(holder[s:e])
    for f, s, e in runs(range_of(many, fragments)):
        parts[f][1] = pack_sorted(many[s:e]) + pack(count[s:e])
    return rows + [(f, batch, REQUEST, sign + a + b) for f, (a, b) in parts.items()]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    fragment, batch, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(fragment, pa.int64()), pa.array(batch, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["fragment", "batch", "kind", "data"])


def _batch_id(k: int) -> int:
    return TaskContext.get().partitionId() << 24 | k


def _from_texts(fragments: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, ids, texts, size, hashes = 0, [], [], 0, _WordHashes()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "") // 6 + 1
                if size >= BATCH or len(ids) == IDS:
                    yield _texts_batch(_batch_id(k), ids, texts, hashes, fragments)
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield _texts_batch(_batch_id(k), ids, texts, hashes, fragments)
        ids, texts = [], []
        hashes.clear()
        free_memory()

    return send


def _texts_batch(batch: int, ids: list, texts: list, hashes: _WordHashes, fragments: int) -> pa.RecordBatch:
    grams, owner = gram_keys(texts, hashes)
    n, signatures = _signatures(grams, owner, len(ids))
    return _as_batch(_requests(batch, ids, n, signatures, grams, owner, fragments))


def _from_sets(fragments: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            first, lengths = 0, np.array([len(x) for x in b.column(3)], dtype=np.int64)
            while first < b.num_rows:
                ends = np.cumsum(lengths[first : first + IDS])
                part = b.slice(first, max(1, int(np.searchsorted(ends, BATCH, side="right"))))
                grams = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(U64)
                owner = np.repeat(np.arange(part.num_rows, dtype=U64), lengths[first : first + part.num_rows])
                signatures = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u8").reshape(-1, 2)
                yield _as_batch(_requests(_batch_id(k), part.column(0).to_pylist(), part.column(2).to_numpy(), signatures, *distinct_keys(grams, owner), fragments))
                k, first = k + 1, first + part.num_rows
        free_memory()

    return send


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """A fragment's document frequencies, as replies to the batches that asked."""
    if rows["kind"].iloc[0] == DOCS:
        return rows
    asked, grams, times = [], [], []
    for data in rows["data"]:
        r = Reader(data[SIGN:])
        single, holder, many, count = r.sorted(), r.ints(), r.sorted(), r.ints()
        asked.append((len(single), holder, len(many)))
        grams += [single, many]
        times += [np.ones(len(single), np.int64), count.astype(np.int64)]
    every = np.concatenate(grams)
    _, place = np.unique(every, return_inverse=True)
    freq = np.bincount(place, weights=np.concatenate(times)).astype(np.int64)[place]
    out, at = [], 0
    for data, (n_single, holder, n_many) in zip(rows["data"], asked, strict=True):
        f, h = freq[at : at + n_single], every[at : at + n_single]
        more = f > 1
        many = freq[at + n_single : at + n_single + n_many]
        out.append(data[:SIGN] + pack_sorted(h[more]) + pack(holder[more]) + pack(f[more]) + pack(many))
        at += n_single + n_many
    return rows.assign(kind=REPLY, data=out)


def _collect(rows: pd.DataFrame) -> pd.DataFrame:
    """A batch's documents whose repeated grams suffice for a link, with these grams in the global order.

    Of the documents of one set only the smallest id carries the grams.
    """
    docs = rows.loc[rows["kind"] == DOCS, "data"]
    if len({data[:SIGN] for data in rows["data"]}) > 1 or len(docs) != 1:
        raise ValueError(OTHER_ORDER)
    r = Reader(docs.iloc[0][SIGN:])
    ids, known, n = r.ints().view(np.int64), r.ints().astype(bool), r.ints().astype(np.int64)
    signatures = np.stack([r.ints(), r.ints()], axis=1)
    many, count, held = r.sorted(), r.ints().astype(np.int64), r.ints()
    grams, owner, freq, many_freq = [np.repeat(many, count)], [held], [], []
    for data in rows[rows["kind"] == REPLY].sort_values("fragment")["data"]:
        r = Reader(data[SIGN:])
        grams.append(r.sorted())
        owner.append(r.ints())
        freq.append(r.ints())
        many_freq.append(r.ints())
    freq.insert(0, np.repeat(np.concatenate([np.empty(0, U64), *many_freq]), count))
    grams, owner, freq = (np.concatenate(x) for x in (grams, owner, freq))
    owner = owner.astype(np.int64)
    repeated = np.bincount(owner, minlength=len(ids))
    stay = known & (n > 0) & (100 * repeated >= PERCENT * n)
    node = [s.tobytes() for s in signatures]
    order = np.lexsort((grams, freq, owner))
    grams, freq = grams[order].astype(np.int64), freq[order].astype(np.int64)
    ends = np.cumsum(repeated)
    seen: set[bytes] = set()
    out = []
    for i in sorted(np.flatnonzero(stay), key=lambda i: ids[i]):
        s, e = ends[i] - repeated[i], ends[i]
        out.append((ids[i], node[i], n[i], *((None, None) if node[i] in seen else (grams[s:e], freq[s:e]))))
        seen.add(node[i])
    return pd.DataFrame(out, columns=["doc_id", "node", "n", "grams", "freqs"])


def _replies(rows: DataFrame, send, name: str) -> DataFrame:
    sent = rows.mapInArrow(send, "fragment long, batch long, kind int, data binary")
    return materialize(sent.groupBy("fragment").applyInPandas(_count, sent.schema), name)


def _fragments(spark, grams: int) -> int:
    return max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(grams) // FRAGMENT))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with i, the size of their intersection: partial counts by fragment of the global order, summed.

    The order is cut by frequency into three fragments: two documents, up to eight, and more.
    """
    fragment = lambda k: F.when(k <= 2, 0).when(k <= 8, 1).otherwise(2)
    zipped = F.arrays_zip("grams", "freqs")
    cut = F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda f: F.struct(f.alias("f"), F.transform(F.filter(zipped, lambda x: fragment(x["freqs"]) == f), lambda x: x["grams"]).alias("part")))
    parts = sets.select("node", F.explode(cut).alias("x")).select("node", "x.f", "x.part").where(F.size("part") > 0)
    left = pairs.join(parts.select(F.col("node").alias("a"), "f", F.col("part").alias("pa")), "a")
    both = left.join(parts.select(F.col("node").alias("b"), "f", F.col("part").alias("pb")), ["b", "f"])
    partial = both.select("a", "b", F.size(F.array_intersect("pa", "pb")).cast("long").alias("i"))
    return partial.groupBy("a", "b").agg(F.sum("i").alias("i"))


def linked(i, na, nb):
    return 100 * i >= PERCENT * (na + nb - i)


def typical(n, freqs):
    """How many other sets hold a set's n-grams, as the mean logarithm: the higher, the likelier a hub links to its members."""
    return F.aggregate(freqs, F.lit(0.0), lambda s, f: s + F.log2(f)) / n


def stars(sets: DataFrame) -> DataFrame:
    """(a, b, indexed): pairs of a hub and a member of one of its buckets, and whether such a bucket is in b's index."""
    n, single = F.col("n"), F.col("n") - F.size("grams")
    # what a link needs of the other's set: of any other one, and of one that is no smaller
    needed, needed_of_larger = F.expr(f"({PERCENT} * n + 99) div 100"), F.expr(f"({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT}")
    probe, index = (n - needed + 1 - single).cast("int"), (n - needed_of_larger + 1 - single).cast("int")
    prefix = F.slice("grams", F.lit(1), F.greatest(probe, F.lit(0)))
    # once a set: what stands beside a generator is computed for each of its rows
    once = sets.select("node", "doc_id", typical(n, "freqs").alias("typical"), index.alias("index"), prefix.alias("prefix"))
    rows = once.select("node", "doc_id", "typical", "index", F.posexplode("prefix").alias("at", "gram"))
    buckets = rows.withColumn("indexed", F.col("at") < F.col("index"))
    hub = F.max(F.struct("typical", "doc_id", "node")).alias("hub")
    hubs = buckets.groupBy("gram").agg(hub, F.count(F.lit(1)).alias("m"), F.max("indexed").alias("any")).where("m > 1 and any").drop("any")
    pairs = buckets.join(hubs, "gram").where(F.col("hub.node") != F.col("node"))
    return pairs.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.max("indexed").alias("indexed"))


def near_pairs(star: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a star, in different components, that might be linked to each other.

    x, the smaller one, is indexed. Sizes of linked sets differ by a quarter at most, so x lies in y's size band or
    the one below: both meet by an equi-join on hub and band. One of them at least is outside the hub's component.
    """
    band = F.floor(F.log("n_b") / F.log(F.lit(1.26)))
    inside = F.col("component_a") == F.col("component_b")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.where("indexed").withColumn("band", band).alias("x")
        y = y.withColumn("band", F.explode(F.array(band, band - 1))).alias("y")
        most = F.least("x.i", "y.i") + F.least(F.col("x.repeated_b") - F.col("x.i"), F.col("y.repeated_b") - F.col("y.i"))
        met = x.join(
            y,
            (F.col("x.a") == F.col("y.a"))
            & (F.col("x.band") == F.col("y.band"))
            & (F.col("x.component_b") != F.col("y.component_b"))
            & (F.col("x.n_b") <= F.col("y.n_b"))
            & (100 * F.col("x.n_b") >= PERCENT * F.col("y.n_b"))
            & ((100 + PERCENT) * most >= PERCENT * (F.col("x.n_b") + F.col("y.n_b"))),
        )
        return met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))

    outside = star.where(~inside)
    return meet(outside, star).union(meet(star.where(inside), outside)).distinct()


def links(sets: DataFrame) -> DataFrame:
    """Pairs of class representatives (u, v) whose links make up the components of all links."""
    about = materialize(sets.select("node", "doc_id", "n", F.size("grams").alias("repeated"), typical(F.col("n"), "freqs").alias("typical")), "about")
    of = lambda s: about.select(*[F.col(c).alias({"node": s}.get(c, f"{c}_{s}")) for c in about.columns])

    def counted(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with what is known of both, their overlap i, and whether they are linked."""
        with_i = pairs.join(overlaps(pairs.select("a", "b"), sets), ["a", "b"], "left").na.fill(0, ["i"])
        return with_i.join(of("a"), "a").join(of("b"), "b").withColumn("linked", linked(F.col("i"), F.col("n_a"), F.col("n_b")))

    edges = lambda rows: rows.where("linked").select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v"))

    def placed(star: DataFrame, found: DataFrame) -> DataFrame:
        """The star with the components of hubs and members by the links found so far."""
        known = components(found)
        for s in ("a", "b"):
            mine = known.select(F.col("node").alias(f"doc_id_{s}"), F.col("component").alias(f"component_{s}"))
            star = star.join(mine, f"doc_id_{s}", "left").withColumn(f"component_{s}", F.coalesce(f"component_{s}", f"doc_id_{s}"))
        return materialize(star, "placed-stars")

    star = materialize(counted(materialize(stars(sets), "hub-pairs")), "stars")
    found = edges(star)
    now = placed(star, found)
    for _ in range(ROUNDS):
        left = now.where("component_a <> component_b").select("a", "b", "typical_b", "doc_id_b")
        hub = left.groupBy("a").agg(F.max(F.struct("typical_b", "doc_id_b", "b"))["b"].alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        pairs = left.join(hub, "a").where("hub <> b").select(F.col("hub").alias("a"), "b").distinct()
        further = materialize(pairs, "further-hub-pairs")
        if further.isEmpty():
            break
        found = materialize(found.union(edges(counted(further))), "links")
        now, last = placed(star, found), now
        drop(last)
    near = materialize(near_pairs(now), "near-pairs")
    return found.union(edges(counted(near)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v) that isn't the smallest of its component.

    Alternating large and small stars: neighbours move to ever smaller centres until all hang on the smallest.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, now = now, materialize(small.where("u <> v").distinct(), "edges")
        drop(last)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(after)


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Words are runs of other characters than ASCII white space, with A-Z lower-cased. A document with fewer than
    five words is one gram; one without words, or a null text, has an empty set and no link. Rows of one doc_id
    are one document for the components. A null doc_id has no links, and a null component_id. Repeated rows
    stay; an empty table gives no rows; texts of any length count whole; other columns have no effect. Answers find
    their documents by place in a batch. A stored table gives each task its rows in one order, whenever it runs; if
    docs comes out of a shuffle and a task that is run again meets its rows in another order, that raises.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    replies = _replies(rows, _from_texts(_fragments(spark, size // 6)), "gram-counts")
    holding = materialize(replies.groupBy("batch").applyInPandas(_collect, SET_SCHEMA), "documents-with-repeats")
    # the node's smallest id holds its grams in every batch, so the smallest of those is the class's
    classes = holding.where(F.col("grams").isNotNull()).groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.first("grams").alias("grams"))
    classes = materialize(classes.select("doc_id", "node", "n", "grams"), "classes")
    grams = classes.agg(F.sum(F.size("grams"))).first()[0] or 0
    again = _replies(classes, _from_sets(_fragments(spark, grams)), "class-gram-counts")
    sets = materialize(again.groupBy("batch").applyInPandas(_collect, SET_SCHEMA), "class-sets")
    drop(again)
    copies = holding.select("doc_id", "node").join(classes.select("node", F.col("doc_id").alias("first")), "node").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    labels = materialize(components(links(sets).union(copies)), "components")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                r = Reader(data[SIGN:])
                ids, known, n = r.ints().view(np.int64), r.ints().astype(bool), r.ints().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known), pa.array(n, pa.int64())], names=["doc_id", "n_shingles"])

    counted = replies.where(F.col("kind") == DOCS).select("data").mapInArrow(sizes, "doc_id long, n_shingles long")
    named = counted.join(small_or_shuffled(labels, 24), counted.doc_id == labels.node, "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those whose component has a smaller doc_id; rows of one doc_id stay or go together."""
    joined = join(docs, text, doc_id)
    (gone,) = fresh(docs, "gone")
    copies = materialize(joined.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(gone)).distinct(), "copies")
    return docs.join(small_or_shuffled(copies, 16), F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
