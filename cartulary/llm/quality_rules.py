"""Quality rules with built-in functions only, and the frequency of lines across a host's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import GAP, fresh, materialize, row_hash, small_or_shuffled, without

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeat_words(word_list: Column) -> Column:
    """Words that lie in windows of 8 words found twice or more in the text, the first one included."""

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            # `get` gives null beyond either end, and a comparison with null counts as false
            twin = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            places = F.array_sort(F.transform(twin, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                places,
                start,
                lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("long").alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(ranked, of_sorted))

    hashed = _bind(
        F.transform(word_list, lambda w: F.xxhash64(w)),
        lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))),
    )
    return F.when(F.size(word_list) <= WINDOW, F.lit(0).cast("long")).otherwise(_bind(hashed, covered))


def base_columns(text: Column) -> list[Column]:
    """struct<n_words, n_repeat_words>, word_chars, n_symbols and n_dup_lines of a text; a null text counts as empty."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        _bind(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))),
        F.char_length(F.regexp_replace(body, GAP, "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base columns and base_failed; columns of those names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = without(docs, *names)
    (counted,) = fresh(out, "counted")
    kept = [F.col(f"`{c}`") for c in out.columns]
    words_first, *others = base_columns(F.col(f"`{text}`"))
    out = out.select(*kept, words_first.alias(counted), *others)
    out = out.select(*kept, F.col(f"{counted}.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col(f"{counted}.n_repeat_words").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_lines(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The distinct normalised lines of each document: (doc_id, rh, line, n_words of all its occurrences).

    Normalised: lower case, runs of white space as one space, trimmed. `line` hashes host and line together;
    a null host is a host of its own. Lines without a word are left out.
    """
    clean = F.transform(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "\n", -1), lambda x: F.trim(F.regexp_replace(x, GAP, " ")))
    site = F.coalesce(F.col(f"`{host}`"), F.lit("\u0000"))
    hashed = F.transform(
        F.filter(clean, lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(site, x).alias("line"), (F.char_length(x) - F.char_length(F.translate(x, " ", "")) + 1).alias("n")),
    )
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_hash(docs, text, host).alias("rh"), hashed.alias("lines"))

    def merged(s: Column) -> Column:
        """Runs of equal lines in a sorted array; equal lines have equally many words."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["line"] != F.get(s, F.greatest(i - 1, F.lit(0)))["line"]))
        return _bind(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p)["line"].alias("line"), ((F.coalesce(F.get(at, k + 1), F.size(s)) - p) * F.get(s, p)["n"]).alias("n"))))

    repeats = F.size(F.array_distinct(F.col("lines.line"))) < F.size("lines")
    once = F.when(repeats, _bind(F.array_sort("lines"), merged)).otherwise(F.col("lines"))
    return rows.select("doc_id", "rh", F.explode(once).alias("x")).select("doc_id", "rh", F.col("x.line").alias("line"), F.col("x.n").cast("long").alias("n"))


def removed_words(docs: DataFrame, max_docs: int, text: str = "text", host: str = "source") -> DataFrame:
    """Words that lose their line, by document: (doc_id, rh, removed). Documents that lose none are absent.

    A line goes where more than max_docs documents of its host hold it; the one with the smallest id keeps it,
    so no content is lost altogether. Rows without an id are documents of their own if their content differs; they
    count, and never keep a frequent line. Counts are partial before any shuffle, whatever a line's frequency.
    """
    lines = materialize(host_lines(docs, text, host), "host-lines")
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("rh")))
    frequent = lines.groupBy("line").agg(F.count_distinct(document).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") > max_docs)
    frequent = materialize(frequent.select("line", "first"), "frequent-lines")
    hit = lines.join(small_or_shuffled(frequent, 16), "line").where(F.col("doc_id").isNull() | ~F.col("doc_id").eqNullSafe(F.col("first")))
    # equal rows of one document count once
    return hit.groupBy("doc_id", "rh", "line").agg(F.max("n").alias("n")).groupBy("doc_id", "rh").agg(F.sum("n").alias("removed"))


def judge(docs: DataFrame, max_docs: int = 50, min_words: int = 20, min_share: float = 0.3, text: str = "text", host: str = "source") -> DataFrame:
    """One row a document: doc_id, the base columns, base_failed, removed_words and kept.

    kept is false if base_failed, or if the document is depleted: without its frequent lines fewer than
    min_words words or less than min_share of its words are left. Null texts count as empty and fail; rows with a
    null doc_id are documents by their content; equal rows get equal verdicts; an empty table gives no rows.
    """
    removed = removed_words(docs, max_docs, text, host)
    (rh,) = fresh(docs, "rh")
    base = measured(docs.select("doc_id", F.col(f"`{text}`"), row_hash(docs, text, host).alias(rh)), text)
    base = base.select("doc_id", F.col(rh).alias("rh"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    b, r = base.alias("b"), removed.alias("r")
    out = b.join(r, F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.rh") == F.col("r.rh")), "left")
    out = out.select("b.*", F.coalesce("r.removed", F.lit(0)).cast("long").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < min_share * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("rh")


def keep(docs: DataFrame, max_docs: int = 50, min_words: int = 20, min_share: float = 0.3, text: str = "text", host: str = "source") -> DataFrame:
    """docs without the documents that judge() rejects; columns stay as they are.

    The base rules are tested on the row itself; only the ids of depleted documents are joined.
    """
    (rh,) = fresh(docs, "rh")
    removed = removed_words(docs, max_docs, text, host)
    marked = docs.withColumn(rh, row_hash(docs, text, host))
    flat, n = fresh(marked, "counted", "n")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    fit = marked.withColumn(flat, _bind(words(body), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))))
    fit = fit.where((F.col(f"{flat}.n") >= 20) & (100 * F.col(f"{flat}.r") <= 30 * F.col(f"{flat}.n")))
    some = materialize(removed, "removed-words").alias("r")
    out = fit.withColumn(n, F.col(f"{flat}.n")).alias("b").join(
        small_or_shuffled(some, 24), F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"b.{rh}") == F.col("r.rh")), "left"
    )
    left = F.col(n) - F.col("r.removed")
    return out.where(F.col("r.removed").isNull() | ((left >= min_words) & (left >= min_share * F.col(n)))).select(*[F.col(f"b.`{c}`") for c in docs.columns])
