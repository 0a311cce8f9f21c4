"""Lines that many documents share, found in hash ranges and returned as run-compressed keep bitmaps; built-in functions only.

1. Every line with a key becomes (hash of its key, document, position); texts stay where they are.
2. These rows are dealt by ranges of (hash, document) and sorted by hash, document and position. A frequent key is
   spread over as many ranges as its rows fill, and no document of a key lies in two of them, so each range streams
   the first occurrence of a key in each document past a window, without another exchange.
3. First occurrences are counted a key, partially in each range; keys of enough documents are frequent.
4. The places of frequent keys meet again by document as the points where its keep bitmap changes. The bitmap of a
   document of a million lines that loses one run of them is two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import fresh, materialize, row_hash, small_or_shuffled, without

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z, and only these, in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    # lower() changes other letters as well, but is many times faster where there are none
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_places(docs: DataFrame, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(line, doc_id, content, rh, at): hash and position of each line whose key has min_chars code points or more.

    rh tells rows of one id apart; content is rh where there is no id, and a document is (doc_id, content).
    """

    def hashed(key: Column, at: Column) -> Column:
        return F.struct(F.when(F.char_length(key) >= min_chars, F.xxhash64(key)).alias("line"), at.alias("at"))

    keys = F.filter(F.transform(split_lines(F.col(f"`{text}`")), lambda x, i: hashed(line_key(x), i)), lambda x: x["line"].isNotNull())
    rh, number = row_hash(docs, text), F.col(f"`{doc_id}`")
    rows = docs.select(number.alias("doc_id"), F.when(number.isNull(), rh).alias("content"), rh.alias("rh"), F.explode(keys).alias("x"))
    return rows.select(F.col("x.line").alias("line"), "doc_id", "content", "rh", F.col("x.at").alias("at"))


def first_occurrences(places: DataFrame) -> DataFrame:
    """places reduced to the first one of each line in each document, streamed out of sorted hash ranges."""
    document = ["line", "doc_id", "content"]
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = places.repartitionByRange(parts, *document).sortWithinPartitions(*document, "at", "rh")
    order = W.Window.partitionBy(*document).orderBy("at", "rh")
    return ranged.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def frequent_lines(places: DataFrame, min_docs: int) -> DataFrame:
    """(line): hashes of keys that min_docs documents or more hold."""
    counted = first_occurrences(places).groupBy("line").agg(F.count(F.lit(1)).alias("docs"))
    return counted.where(F.col("docs") >= min_docs).select("line")


def flips(dropped: Column) -> Column:
    """Sorted places of dropped lines as the places where the keep bitmap changes: [start, end) of each run of them."""
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, F.greatest(i - 1, F.lit(0))) != p - 1))
    ends = F.transform(F.filter(dropped, lambda p, i: F.coalesce(F.get(dropped, i + 1) != p + 1, F.lit(True))), lambda p: p + 1)
    return F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.array(r["s"], r["e"])))


def dropped_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rh, n_dropped, flips) of the rows of docs that lose a line; equal rows of one id share theirs."""
    places = materialize(line_places(docs, min_chars, text, doc_id), "line-places")
    frequent = materialize(frequent_lines(places, min_docs), "frequent-lines")
    hit = places.join(small_or_shuffled(frequent, 16), "line").groupBy("doc_id", "rh").agg(F.array_sort(F.collect_set("at")).alias("at"))
    return hit.select("doc_id", "rh", F.size("at").cast("long").alias("n_dropped"), _bind(F.col("at"), flips).alias("flips"))


def _with_runs(docs: DataFrame, runs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, str, str]:
    """docs with what each row loses in columns of names that they don't hold: (frame, n_dropped, flips)."""
    number, rh, n, at = fresh(docs, "of_doc", "of_row", "n_lost", "lost_at")
    runs = materialize(runs, "keep-bitmaps")
    runs = runs.select(F.col("doc_id").alias(number), F.col("rh").alias(rh), F.col("n_dropped").alias(n), F.col("flips").alias(at))
    # two numbers a run and a few bytes for the row
    met = docs.join(small_or_shuffled(runs, 64), F.col(f"`{doc_id}`").eqNullSafe(F.col(number)) & (row_hash(docs, text) == F.col(rh)), "left")
    return met.withColumns({n: F.coalesce(n, F.lit(0)), at: F.coalesce(at, F.array().cast("array<int>"))}).drop(number, rh), n, at


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of docs: doc_id, n_lines, n_dropped, flips.

    flips is the keep bitmap in runs: lines before the first place in it stay, up to the second they go, and so on;
    it is empty if all stay. A line goes, wherever it stands, if at least min_docs documents hold its key, the first
    ones included. Keys are lines without white space at both ends and with A-Z in lower case; lines whose key has
    fewer than min_chars code points stay. Documents are told apart by id, rows without one by text, language and
    source; repeated rows stay and count once. A null text is an empty one, of one empty line. An empty table gives
    no rows. Lines of any length count whole, and a document may have any number of them.
    """
    bare = docs.select(F.col(f"`{doc_id}`"), F.size(split_lines(F.col(f"`{text}`"))).cast("long").alias("n_lines"), row_hash(docs, text).alias("rh"))
    lost = materialize(dropped_runs(docs, min_docs, min_chars, text, doc_id), "keep-bitmaps").alias("r")
    met = bare.alias("b").join(small_or_shuffled(lost, 64), F.col(f"b.`{doc_id}`").eqNullSafe(F.col("r.doc_id")) & (F.col("b.rh") == F.col("r.rh")), "left")
    none = F.array().cast("array<int>")
    return met.select(F.col(f"b.`{doc_id}`").alias("doc_id"), "b.n_lines", F.coalesce("r.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("r.flips", none).alias("flips"))


def kept_text(text: Column, at: Column) -> Column:
    """A text without the lines that its keep bitmap drops; the others stay as they are, joined by \\n."""

    def cut(lines: Column) -> Column:
        bounds = F.concat(F.array(F.lit(0)), at, F.array(F.size(lines)))
        pairs = F.sequence(F.lit(0), F.size(at), F.lit(2))
        return F.array_join(F.flatten(F.transform(pairs, lambda i: F.slice(lines, F.get(bounds, i) + 1, F.get(bounds, i + 1) - F.get(bounds, i)))), "\n")

    return F.when(F.size(at) == 0, F.coalesce(text, F.lit(""))).otherwise(_bind(split_lines(text), cut))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with their texts cut by the bitmaps of keep_bitmaps(), and n_lines (before), n_dropped.

    Columns of those two names are replaced. A document that loses all its lines keeps an empty text.
    """
    docs = without(docs, "n_lines", "n_dropped")
    met, n, at = _with_runs(docs, dropped_runs(docs, min_docs, min_chars, text, doc_id), text, doc_id)
    body = F.col(f"`{text}`")
    columns = [kept_text(body, F.col(at)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return met.select(*columns, F.size(split_lines(body)).cast("long").alias("n_lines"), F.col(n).cast("long").alias("n_dropped"))
