"""A Katz backoff language model of words, learned from and evaluated on whole corpora.

    p(w | v) = d(c(v w)) c(v w) / c(v)   if the pair v w was seen min_count times or more in training
             = alpha(v) p(w)             otherwise
    p(w)     = d(c(w)) c(w) / N          if w was seen in training; else what is left, for any unknown word

d are Good-Turing discounts, and alpha(v) makes the probabilities after v sum to exactly 1. With a min_count of 1, the
default, every pair keeps its count. With 2 pairs seen once are treated as unseen, as Katz proposed: their mass goes
to the backoff.

Batches of documents send their distinct words and pairs to ranges of the hash space; each range adds up its
counts, keeps them as its part of the model's tables, and answers each batch. A second pass over the documents
joins the answers and evaluates every token: pair, then word, then unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import crc_mod, materialize
from cartulary.llm.packing import U64, Reader, mix64, pack, pack_listed, pack_sorted, range_of, runs

#: Tokens that a batch of documents holds at most (one longer document is a batch of its own), and keys of a range about.
BATCH, RANGE = 1_500_000, 1_000_000
#: Counts up to this are discounted.
K = 5
#: Of score() without a min_count.
MIN_COUNT = 1
PAIRS, WORDS, PAIR_TABLE, WORD_TABLE, PAIR_STATS, WORD_STATS = range(6)
OTHER_ORDER = "the documents came in another order on the second pass; write them to a table first"
ROW = "fragment long, batch long, kind int, data binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: A word holds no space, so these are not words.
END, START = word_hash(b" end"), word_hash(b" start")


def as_long(h: int) -> int:
    """A 64-bit hash as Spark's signed long."""
    return h - (1 << 64) if h >> 63 else h


def pressed(data: bytes) -> bytes:
    """Blobs are full of small numbers, which zstd codes shorter than the default codec of shuffles."""
    return zstandard.compress(data, 1)


def opened(data: bytes) -> bytes:
    return zstandard.decompress(data)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = word_hash(word)
        return h


@dataclass
class Batch:
    """Texts as places in the sorted array of their distinct words; each text ends with END, and follows START."""

    ids: list
    training: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    before: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, hashes: _Hashes, ids: list, training: list[bool], texts: list[str | None]) -> Batch:
        if len(hashes) > 150_000:
            hashes.clear()
        flat = [np.array([START], dtype=U64)]
        for t in texts:
            found = (t or "").encode("utf-8", "surrogatepass").lower().split()
            found.append(b" end")
            flat.append(np.fromiter(map(hashes.__getitem__, found), dtype=U64, count=len(found)))
        sizes = np.array([len(x) for x in flat[1:]], dtype=np.int64)
        words, tokens = np.unique(np.concatenate(flat), return_inverse=True)
        start, tokens = tokens[0], tokens[1:]
        before = np.append(start, tokens[:-1])
        before[np.cumsum(sizes) - sizes] = start
        return cls(ids, np.array(training, dtype=bool), words, tokens, before, sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs as (place before << 32 | place), ascending, and each token's pair."""
        return np.unique(self.before.astype(np.int64) << 32 | self.tokens, return_inverse=True)


def pair_range(words: np.ndarray, keys: np.ndarray, ranges: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = mix64(words[keys >> 32] * U64(0x9E3779B97F4A7C15) + words[keys & 0xFFFFFFFF])
    return range_of(mixed, ranges)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch]]:
    """Batches of a partition, in its order; a second pass over the same table cuts them alike."""
    k, size, held, hashes = 0, 0, ([], [], []), _Hashes()
    number = lambda: TaskContext.get().partitionId() << 24 | k
    for b in rows:
        for one in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for column, x in zip(held, one, strict=True):
                column.append(x)
            size += len(one[2] or "") // 5 + 1
            if size >= BATCH:
                yield number(), Batch.of(hashes, *held)
                k, size, held = k + 1, 0, ([], [], [])
    if held[0]:
        yield number(), Batch.of(hashes, *held)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["fragment", "batch", "kind", "data"])


def _ask(ranges: int):
    """Each batch's distinct pairs and words, with their counts in training documents, by range."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _batches(rows):
            weight = np.repeat(b.training, b.sizes).astype(np.float64)
            keys, at = b.pairs()
            count = np.bincount(at, weights=weight, minlength=len(keys)).astype(np.int64)
            where = pair_range(b.words, keys, ranges)
            order = np.argsort(where, kind="stable")
            keys, count, where = keys[order], count[order], where[order]
            first, second = b.words[keys >> 32], b.words[keys & 0xFFFFFFFF]
            out = []
            for f, s, e in runs(where):
                heads = np.flatnonzero(np.append(True, first[s + 1 : e] != first[s : e - 1]))
                data = pack_sorted(first[s:e][heads]) + pack(np.diff(np.append(heads, e - s))) + pack_listed(second[s:e]) + pack(count[s:e])
                out.append((f, number, PAIRS, pressed(data)))
            count = np.bincount(b.tokens, weights=weight, minlength=len(b.words)).astype(np.int64)
            for f, s, e in runs(range_of(b.words, ranges)):
                out.append((ranges + f, number, WORDS, pressed(pack_sorted(b.words[s:e]) + pack(count[s:e]))))
            yield _rows(out)
            del b, out, keys, at, first, second, count, where, order, weight
            pa.default_memory_pool().release_unused()

    return send


def _sum(min_count: int):
    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        """A range's counts: the answer to each batch (its keys' counts, in its order), the range's table and statistics."""
        fragment, kind = rows["fragment"].iloc[0], rows["kind"].iloc[0]
        first, second, count, sizes = [], [], [], []
        for data in rows["data"]:
            r = Reader(opened(data))
            if kind == PAIRS:
                heads, times = r.sorted(), r.ints().astype(np.int64)
                first.append(np.repeat(heads, times))
                second.append(r.listed())
            else:
                first.append(r.sorted())
                second.append(np.zeros(len(first[-1]), dtype=U64))
            count.append(r.ints().astype(np.int64))
            sizes.append(len(count[-1]))
        first, second, count = np.concatenate(first), np.concatenate(second), np.concatenate(count)
        order = np.lexsort((second, first)) if kind == PAIRS else np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total = np.add.reduceat(count[order], starts)
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
        ends = np.cumsum(sizes)
        answers = [pack(each[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
        if kind == WORDS:  # the words go along, for the backoff weights
            answers = [opened(d) + x for d, x in zip(rows["data"], answers, strict=True)]
        kept = total >= (min_count if kind == PAIRS else 1)
        table = pack_listed(a[starts][kept]) + pack_listed(b[starts][kept]) + pack(total[kept])
        stats = pack(np.append(np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2], [total.sum(), (total > 0).sum()]))
        more = pd.DataFrame({"fragment": fragment, "batch": 0, "kind": [kind + 2, kind + 4], "data": [pressed(table), pressed(stats)]})
        return pd.concat([rows.assign(data=[pressed(x) for x in answers]), more])

    return add_up


def _statistics(rows: DataFrame) -> np.ndarray:
    """Counts of counts 1 to K + 1, the tokens and the types of a kind of keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                n = Reader(opened(data)).ints().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["at", "n"])

    out = np.zeros(K + 3, dtype=np.int64)
    for r in rows.select("data").mapInArrow(read, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def discounts(n: np.ndarray, least: int = 1) -> np.ndarray:
    """d(0..K): Good-Turing ratios, renormalised so that counts above K stay; n has the counts of counts 1 to K + 1.

    Where the counts of counts give no ratio between 0 and 1 (small corpora), half an occurrence is discounted.
    Counts below `least` are treated as unseen and have 0.
    """
    out = np.zeros(K + 1)
    tail = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(least, K + 1):
        ratio = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail < 1 else 0.0
        out[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    tokens: int
    types: int
    d: np.ndarray
    total: float
    unknown: float

    @classmethod
    def of(cls, stats: np.ndarray) -> Unigrams:
        d, n = discounts(stats[: K + 1]), int(stats[K + 1])
        left = sum(int(stats[r - 1]) * r * (1 - d[r]) for r in range(1, K + 1))
        total = n + (1.0 if left <= 0 else 0.0)
        return cls(n, int(stats[K + 2]), d, total, (total - n + left) / total)

    def p(self, c: np.ndarray) -> np.ndarray:
        """The probabilities of words by their counts; a count of 0 is any unknown word."""
        seen = np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c / self.total
        return np.where(c > 0, seen, self.unknown)


def _discounted(c, d: np.ndarray):
    """d(c) c as a column."""
    return F.when(c <= K, F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least(c, F.lit(K)) + 1).cast("int")) * c).otherwise(c.cast("double"))


def _table(rows: DataFrame) -> DataFrame:
    """(a, b, c) of the packed parts of a table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for data in x.column(0).to_pylist():
                r = Reader(opened(data))
                parts = [r.listed(), r.listed(), r.ints()]
                for s in range(0, len(parts[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(p[s : s + 100_000].astype(np.int64)) for p in parts], names=["a", "b", "c"])

    return rows.select("data").mapInArrow(read, "a long, b long, c long")


def backoff(pairs: DataFrame, words: DataFrame, d: np.ndarray, uni: Unigrams) -> DataFrame:
    """(word, denominator, alpha) of every word that begins a kept pair.

    Where discounts leave nothing (all pairs frequent), the denominator is one more than the count, so that
    unseen words keep a share.
    """
    known = words.select(F.col("a").alias("w"), F.col("c").alias("cw"))
    joined = pairs.join(known, F.col("b") == F.col("w"))
    p = _discounted(F.col("cw"), uni.d) / uni.total
    sums = joined.groupBy("a").agg(F.sum(_discounted(F.col("c"), d)).alias("mass"), F.sum(p).alias("lower"))
    # START is followed by something as often as END is met
    sums = sums.withColumn("as", F.when(F.col("a") == as_long(START), F.lit(as_long(END))).otherwise(F.col("a")))
    out = sums.join(known, F.col("as") == F.col("w"))
    base = F.when(F.col("cw") - F.col("mass") < 1e-9, F.col("cw") + 1.0).otherwise(F.col("cw").cast("double"))
    return out.select(F.col("a").alias("word"), base.alias("denominator"), ((1 - F.col("mass") / base) / (1 - F.col("lower"))).alias("alpha"))


def _weigh(asked: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
    """Adds to each answer about words the denominators and weights of those that have them."""
    word = contexts["word"].to_numpy().astype(U64)
    order = np.argsort(word, kind="stable")
    word = word[order]
    numbers = [contexts[c].to_numpy()[order].astype("<f8") for c in ("denominator", "alpha")]
    out = []
    for data in map(opened, asked["data"]):
        mine = Reader(data).sorted()
        at = np.minimum(np.searchsorted(word, mine), max(len(word) - 1, 0))
        has = word[at] == mine if len(word) else np.zeros(len(mine), dtype=bool)
        out.append(pressed(data + pack_sorted(np.flatnonzero(has)) + b"".join(x[at[has]].tobytes() for x in numbers)))
    return asked.assign(data=out)


def _sign(words: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(words.tobytes())], dtype=U64)


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token sequences of each batch, with frequent words as small numbers."""
    press = zstandard.ZstdCompressor(level=3)
    for number, b in _batches(rows):
        by_use = np.argsort(-np.bincount(b.tokens, minlength=len(b.words)), kind="stable")
        rank = np.empty(len(by_use), np.int64)
        rank[by_use] = np.arange(len(by_use))
        known = np.array([i is not None for i in b.ids])
        ids = np.array([0 if i is None else i for i in b.ids], dtype=np.int64).view(U64)
        data = pack(ids) + pack(known) + pack(b.training) + pack(b.sizes) + pack(_sign(b.words)) + pack(by_use) + pack(rank[b.tokens])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([press.compress(data)], pa.binary())], names=["batch", "data"])


def _scores(ranges: int, uni: Unigrams, d: np.ndarray, min_count: int):
    def score(rows: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if len(texts) != 1 or not len(rows):
            raise ValueError(OTHER_ORDER)
        r = Reader(zstandard.ZstdDecompressor().decompress(texts["data"].iloc[0]))
        ids, known, training, sizes = r.ints().view(np.int64), r.ints() > 0, r.ints() > 0, r.ints().astype(np.int64)
        signature = r.ints()
        by_use, used = r.ints().astype(np.int64), r.ints().astype(np.int64)
        words, count, base, alpha = [], [], [], []
        for data in map(opened, rows[rows["kind"] == WORDS].sort_values("fragment")["data"]):
            r = Reader(data)
            words.append(r.sorted())
            r.ints()  # the batch's own counts
            count.append(r.ints().astype(np.int64))
            has = r.sorted().astype(np.int64)
            for column, fill, k in ((base, 1.0, 0), (alpha, 1.0, 1)):
                x = np.full(len(words[-1]), fill)
                x[has] = np.frombuffer(data, dtype="<f8", count=len(has), offset=r.at + 8 * k * len(has))
                column.append(x)
        words, count, base, alpha = (np.concatenate(x) for x in (words, count, base, alpha))
        if _sign(words)[0] != signature[0]:
            raise ValueError(OTHER_ORDER)
        tokens = by_use[used]
        ends = np.cumsum(sizes)
        start = np.searchsorted(words, U64(START))
        before = np.append(start, tokens[:-1])
        before[ends - sizes] = start
        b = Batch(list(ids), training, words, tokens, before, sizes)
        keys, at = b.pairs()
        order = np.argsort(pair_range(words, keys, ranges), kind="stable")
        pair = np.empty(len(keys), np.int64)
        pair[order] = np.concatenate([Reader(opened(x)).ints() for x in rows[rows["kind"] == PAIRS].sort_values("fragment")["data"]]).astype(np.int64)
        v, w = keys >> 32, keys & 0xFFFFFFFF
        with np.errstate(divide="ignore"):
            seen = np.log10(np.where(pair <= K, d[np.minimum(pair, K)], 1.0) * pair / base[v])
            unseen = np.log10(alpha[v]) + np.log10(uni.p(count))[w]
            each = np.where(pair >= min_count, seen, unseen)[at]
            plain = np.log10((count + 0.1) / (uni.tokens + 0.1 * (uni.types + 1)))[tokens]
        starts = ends - sizes
        out = pd.DataFrame({"doc_id": ids, "held_out": ~training, "n_tokens": sizes})
        out["n_known"] = np.add.reduceat((count[tokens] > 0).astype(np.int64), starts)
        out["train_tokens"] = uni.tokens
        out["base_score"] = np.add.reduceat(plain, starts)
        out["score"] = np.add.reduceat(each, starts)
        out["doc_id"] = pd.array(ids, dtype="Int64")
        out.loc[~known, "doc_id"] = pd.NA
        return out

    return score


def score(docs: DataFrame, folds: int = 10, text: str = "text", doc_id: str = "doc_id", min_count: int = MIN_COUNT) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the documents whose crc32(doc_id as text) mod folds is not 0; the others are held out. Words
    have A-Z lower-cased; each text ends with one end token. A null text counts as empty: its end is scored. A
    null doc_id counts as empty text for the fold. Pairs seen less than min_count (1 or more) times are unseen. Repeated rows count, and are scored, each. base_score is that
    of a unigram model with 0.1 added to each count; score is log10 of the Katz probability. Without training
    documents every token is the unknown word. An empty table gives no rows. The documents are read twice and must
    come in the same order, as a stored table gives them.
    """
    spark = docs.sparkSession
    training = (crc_mod(doc_id, folds) != 0).alias("training")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), training, F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 7 // RANGE))
    counted = materialize(rows.mapInArrow(_ask(ranges), ROW).groupBy("fragment").applyInPandas(_sum(min_count), ROW), "ngram-counts", partition_by="kind")
    of = lambda kind: counted.where(F.col("kind") == kind)
    uni, pair_stats = Unigrams.of(_statistics(of(WORD_STATS))), _statistics(of(PAIR_STATS))
    d = discounts(pair_stats[: K + 1], min_count)
    contexts = materialize(backoff(_table(of(PAIR_TABLE)), _table(of(WORD_TABLE)), d, uni), "backoff-weights")
    # the same rule as range_of()
    place = F.lit(ranges) + F.shiftrightunsigned(F.shiftrightunsigned("word", 32) * F.lit(ranges).cast("long"), 32)
    weights = contexts.withColumn("fragment", place.cast("long"))
    words = of(WORDS).select("fragment", "batch", "kind", "data")
    weighed = words.groupBy("fragment").cogroup(weights.groupBy("fragment")).applyInPandas(_weigh, ROW)
    answers = weighed.unionByName(of(PAIRS).select("fragment", "batch", "kind", "data"))
    # the texts have a stage of their own, whose tasks number their batches as the first pass did
    texts = rows.mapInArrow(_texts, "batch long, data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("batch").cogroup(texts.groupBy("batch")).applyInPandas(_scores(ranges, uni, d, min_count), schema)
