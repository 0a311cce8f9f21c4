"""Similarity of words, and the best match in a dictionary.

`indel_ratio` is 200 * LCS / (len a + len b), where a substitution counts as two edits. `levenshtein_ratio` is
the built-in variant, 100 * (1 - distance / longer length).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Words of a dictionary that are all compared with each word of a like length.
SMALL = 1000


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of whole numbers."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 for equal texts, 0 for texts without a common character; null if either is null."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
        else:
            n = len(x) + len(y)
            out.append(200.0 * lcs_length(x, y) / n if n else 100.0)
    return pd.Series(out, dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def _grams(word: Column) -> Column:
    """The pairs of neighbouring characters of a word, each with how many equal ones come before it in sorted order."""

    def numbered(g: Column) -> Column:
        return F.transform(g, lambda x, i: F.concat(x, (i + 1 - F.array_position(g, x)).cast("string")))

    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
    some = F.transform(F.array(F.array_sort(pairs)), numbered)[0]
    return F.when(F.length(word) > 1, some).otherwise(F.array().cast("array<string>"))


def _common(a: Column, b: Column, cutoff: float, exact_ratio: bool) -> Column:
    """The length of a common subsequence that words of lengths a and b have if their ratio reaches the cutoff; null if it can't."""
    m = F.ceil((a + b) * cutoff / 200 - 1e-9) if exact_ratio else F.greatest(a, b) - F.floor(F.greatest(a, b) * (100 - cutoff) / 100 + 1e-9)
    return F.when(m <= F.least(a, b), m.cast("int"))


def _few(n: Column, gone: Column) -> Column:
    """Whether a word of n characters has at most 500 subsequences with so many characters gone."""
    return (gone == 0) | ((gone == 1) & (n <= 64)) | ((gone == 2) & (n <= 32)) | ((gone == 3) & (n <= 15))


def _without(word: Column, gone: int) -> Column:
    """The distinct subsequences of a word with so many characters gone."""
    out = F.array(word)
    for _ in range(gone):
        each = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        out = F.array_distinct(F.flatten(F.transform(out, each)))
    return out


def _shared(a: Column, b: Column, m: Column, exact_ratio: bool) -> Column:
    """How many numbered pairs two words share at least, of lengths a and b with a common subsequence of m.

    A word loses a - m characters, each of them in two pairs, and the other's b - m characters part one pair each. An
    edit by substitution changes two pairs of either word.
    """
    one = lambda x, y: (x - 1) - 2 * (x - m) - (y - m)
    return F.greatest(one(a, b), one(b, a)) if exact_ratio else F.greatest(a, b) - 1 - 2 * (F.greatest(a, b) - m)


def _band(n: Column) -> Column:
    """Lengths as a few classes: each of its own up to 32, then eight a doubling."""
    return F.when(n < 32, n).otherwise(32 + F.floor(8 * F.log2(F.greatest(n, F.lit(1)) / 32))).cast("int")


def candidates(words: DataFrame, column: str, dictionary: DataFrame, cutoff: float, exact_ratio: bool = True) -> DataFrame:
    """(column, word): every pair of distinct words and dictionary words whose ratio can reach the cutoff; equal ones too.

    An index without loss, by lengths. Words that reach the cutoff have a common subsequence whose length follows from
    theirs. Where few characters are gone from either (all but long words), each side lists its subsequences of such
    lengths, and equal ones meet: for the exact ratio that is the ratio's own condition. For other lengths a number of
    shared character pairs follows: with each word's pairs sorted from the rarest in the dictionary on, two such words
    share one among the first few of either. Few words meet at a rare pair; what meets must then share as many pairs as
    needed. Lengths for which neither follows (long words at a low cutoff) meet by length, and so do all words if the
    dictionary has at most SMALL: the work is then linear in the words.
    """
    share = cutoff / (200 - cutoff) if exact_ratio else cutoff / 100
    others = lambda n: F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int"))
    common = lambda a, b: _common(a, b, cutoff, exact_ratio)
    near = lambda a, b: F.coalesce(_few(a, a - common(a, b)) & _few(b, b - common(a, b)), F.lit(False))
    need = lambda a, b: F.when(~near(a, b), _shared(a, b, common(a, b), exact_ratio))
    # few bytes a word, and much work for each: as many tasks as a shuffle has, however small the words together
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = words.select(F.col(column).alias("__a")).where(F.length("__a") > 0).distinct().repartition(tasks, "__a").withColumn("n", F.length("__a"))
    known = dictionary.select("word").where(F.length("word") > 0).distinct().repartition(tasks, "word").withColumn("m", F.length("word"))

    if known.limit(SMALL + 1).count() <= SMALL:
        lengths = known.withColumn("n", F.explode(others(F.col("m"))))
        return asked.join(lengths, "n").select(F.col("__a").alias(column), "word")

    def listed(side: DataFrame, word: str, length: str) -> DataFrame:
        """(word, length, part): the subsequences by which a word can meet one of another length."""
        n = F.col(length)
        gone = F.array_distinct(F.transform(F.filter(others(n), lambda x: near(n, x)), lambda x: n - common(n, x)))
        parts = F.concat(*[F.when(F.array_contains("__gone", k), _without(F.col(word), k)).otherwise(F.array().cast("array<string>")) for k in range(4)])
        return side.withColumn("__gone", gone).select(word, length, F.explode(parts).alias("part"))

    meets = near(F.col("n"), F.col("m")) & (F.length("part") == common(F.col("n"), F.col("m")))
    close = listed(asked, "__a", "n").join(listed(known, "word", "m"), "part").where(meets).select("__a", "word")

    def ordered(side: DataFrame, word: str, length: str) -> DataFrame:
        """Words that meet others by pairs, with these (the rarest first; those that the dictionary lacks count so)."""
        n = F.col(length)
        lengths = F.filter(others(n), lambda x: F.coalesce(need(n, x) > 0, F.lit(False)))
        some = side.withColumn("lengths", lengths).where(F.size("lengths") > 0)
        # the longest prefix that any length of the other word asks for
        some = some.select(word, length, F.array_distinct(F.transform("lengths", _band)).alias("bands"), F.array_min(F.transform("lengths", lambda x: need(n, x))).alias("least"))
        each = some.select(word, F.explode(_grams(F.col(word))).alias("gram")).join(frequency, "gram", "left")
        gs = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram"))), lambda x: x["gram"])
        prefix = F.posexplode(F.slice("gs", F.lit(1), (n - F.col("least")).cast("int"))).alias(f"at_{word}", "gram")
        return some.join(each.groupBy(word).agg(gs.alias("gs")), word).select(word, length, "bands", prefix)

    frequency = known.select(F.explode(_grams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    left = ordered(asked, "__a", "n").select("__a", "n", "at___a", "gram", F.explode("bands").alias("band"))
    right = ordered(known, "word", "m").select("word", "m", "at_word", "gram", _band(F.col("m")).alias("band"))
    t = need(F.col("n"), F.col("m"))
    met = left.join(right, ["gram", "band"]).where((t > 0) & (F.col("at___a") < F.col("n") - t) & (F.col("at_word") < F.col("m") - t))
    met = met.select("__a", "word", "n", "m").distinct().where(F.size(F.array_intersect(_grams(F.col("__a")), _grams(F.col("word")))) >= t)
    lone = asked.select("__a", "n", F.explode(F.filter(others(F.col("n")), lambda x: F.coalesce(need(F.col("n"), x) <= 0, F.lit(False)))).alias("m"))
    by_length = lone.join(known, "m")
    same = asked.join(known, F.col("__a") == F.col("word"))
    return close.union(met.select("__a", "word")).union(by_length.select("__a", "word")).union(same.select("__a", "word")).distinct().withColumnRenamed("__a", column)


def best_match(words: DataFrame, column: str, dictionary: DataFrame, cutoff: float, exact_ratio: bool = True) -> DataFrame:
    """words (distinct) with the columns of the most similar dictionary row at or above the cutoff, and `ratio`.

    dictionary: `word` and other columns. Ties go to the first word by code point, then to the first row by its other
    columns. Only pairs of the index of candidates() are compared. Null and empty words have no match.
    """
    scored = candidates(words, column, dictionary, cutoff, exact_ratio)
    ratio = (indel_ratio if exact_ratio else levenshtein_ratio)(F.col(column), F.col("word"))
    scored = scored.withColumn("ratio", ratio).where(F.col("ratio") >= cutoff)
    rest = [c for c in dictionary.columns if c != "word"]
    # the smallest struct has the largest ratio, then the first word
    best = scored.groupBy(column).agg(F.min(F.struct((-F.col("ratio")).alias("low"), F.col("word"))).alias("best")).select(column, (-F.col("best.low")).alias("ratio"), "best.word")
    if not rest:
        return best
    rows = dictionary.groupBy("word").agg(F.min(F.struct(*rest)).alias("row"))
    return best.join(rows, "word").select(column, "ratio", "word", *[f"row.{c}" for c in rest])
