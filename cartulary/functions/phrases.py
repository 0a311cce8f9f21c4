"""The phrases of a table in whole texts: at each place the longest one, without overlaps, as an alternation of all
phrases, the longest first, would find them.

Phrases are sequences of words, as the paths of a trie whose first two levels are the key of a join: a place of a text
meets only the phrases that start with its word, if they have one, or with its next two words. So a frequent first
word doesn't bring all phrases that begin with it, and neither texts nor phrases have to fit in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Words of a phrase that are compared while a text is read; longer phrases meet their texts again.
AHEAD = 8


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _greedy(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Which of a chain of overlapping matches, in order, don't overlap the one taken before."""
    out = []
    for places, lengths in zip(starts, sizes, strict=True):
        end, taken = -1, []
        for at, n in zip(places, lengths, strict=True):
            taken.append(bool(at >= end))
            end = at + n if at >= end else end
        out.append(taken)
    return pd.Series(out)


def longest_matches(texts: DataFrame, keys: Sequence[str], tokens: str, phrases: DataFrame, words: str = "words") -> DataFrame:
    """(keys, at, n_words, other columns of phrases): matches in texts from left to right, none within another.

    tokens and words are arrays of strings; at counts from 0. Of the phrases at one place the longest counts, and
    the next one is looked for after its end. Of phrases of the same words the first by its other columns counts.
    Null words match nothing; phrases without words, and texts without tokens, give nothing. Phrases of any length
    are found: `texts` must be unique by keys.
    """
    rest = [c for c in phrases.columns if c != words]
    known = phrases.where((F.size(words) > 0) & ~F.exists(words, lambda w: w.isNull())).select(F.col(words).alias("__words"), F.size(words).alias("__size"), F.struct(*rest, F.lit(1).alias("__one")).alias("__of"))
    longest = known.agg(F.max("__size")).first()[0] or 0
    ahead = [f"__t{i}" for i in range(max(2, min(longest, AHEAD)))]
    # the words from each place on, side by side: a pass over the words that makes no array a place
    shown = texts.select(*keys, *[F.slice(tokens, i, F.greatest(F.size(tokens), F.lit(0))).alias(t) for i, t in enumerate(ahead, 1)])
    places = shown.select(*keys, F.posexplode(F.arrays_zip(*ahead)).alias("at", "__w")).select(*keys, "at", "__w.*")
    single = known.where("__size = 1").groupBy(F.get("__words", 0).alias("__word")).agg(F.min("__of").alias("__single"))
    several = known.where("__size > 1").select(F.get("__words", 0).alias("__first"), F.get("__words", 1).alias("__second"), "__words", "__size", "__of")
    met = places.join(single, F.col("__t0") == F.col("__word"), "left").join(several, (F.col("__t0") == F.col("__first")) & (F.col("__t1") == F.col("__second")), "left")
    met = met.where("__word IS NOT NULL OR __first IS NOT NULL")
    same = F.coalesce(F.slice(F.array(*ahead), 1, F.least("__size", F.lit(len(ahead)))) == F.slice("__words", 1, len(ahead)), F.lit(False))
    met = met.select(*keys, "at", "__single", "__size", "__of", "__words", same.alias("__same")).where("__same OR __single IS NOT NULL")
    if longest > len(ahead):
        # phrases that go on are held against the text itself
        on = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
        whole = texts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col(tokens).alias("__tokens"))
        rest_of = F.slice("__tokens", F.col("at") + 1, F.coalesce("__size", F.lit(1))) == F.col("__words")
        met = met.join(whole, reduce(lambda x, y: x & y, on)).withColumn("__same", F.col("__same") & F.coalesce(rest_of, F.lit(False))).where("__same OR __single IS NOT NULL")
    found = met.select(*keys, "at", F.when(F.col("__same"), F.col("__size")).otherwise(1).alias("n_words"), F.when(F.col("__same"), F.col("__of")).otherwise(F.col("__single")).alias("__of"))
    # dealt once; all that follows looks at one text in order
    found = found.repartition(*keys)
    best = F.row_number().over(W.Window.partitionBy(*keys, "at").orderBy(F.desc("n_words"), "__of"))
    first = found.withColumn("__rank", best).where("__rank = 1").drop("__rank")
    order = W.Window.partitionBy(*keys).orderBy("at")
    fresh = F.col("at") >= F.coalesce(F.max(F.col("at") + F.col("n_words")).over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    chained = first.withColumn("__fresh", fresh.cast("int")).withColumn("__chain", F.sum("__fresh").over(order))
    chains = chained.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(F.struct("at", "n_words", "__of"))).alias("ms"))

    alone = chains.where(F.size("ms") == 1).select(*keys, F.get("ms", 0).alias("m"))
    tangled = chains.where(F.size("ms") > 1).withColumn("__taken", _greedy("ms.at", "ms.n_words"))
    taken = tangled.select(*keys, F.explode(F.filter(F.transform("ms", lambda m, i: F.when(F.get("__taken", i), m)), lambda m: m.isNotNull())).alias("m"))
    return alone.unionByName(taken).select(*keys, "m.at", "m.n_words", *[F.col(f"m.__of.{c}").alias(c) for c in rest])
