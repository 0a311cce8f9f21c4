"""Place columns: cleaning, and a gazetteer in a table of its own."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.phrases import longest_matches
from cartulary.functions.similarity import best_match
from cartulary.functions.text import PLACE_STOP_WORDS, squeeze, without_accents

#: What is left of labels before a place.
PREFIXES = r"^(?:(?:MA|DE|DEL|EN|LA|EL|Y)\s+)+"
NO_PLACE = ("DE", "Y DE", "NATIONAL", "PERSONAL", "MA DE")
LETTERS = "A-ZÁÉÍÓÚÜÑa-záéíóúüñ"


def place_name(value: Column, stop_words: Sequence[str] = PLACE_STOP_WORDS, rejected: Sequence[str] = NO_PLACE) -> Column:
    """A place: the part before "(REGION)" if there is one, without stop words, other signs and leading particles.

    Null without a word of three letters, or if only a rejected phrase is left.
    """
    pair = rf"([{LETTERS}\s]{{3,30}})\s*\(\s*[{LETTERS}\s]{{3,30}}\s*\)"
    text = F.trim(value)
    named = F.when(text.rlike(pair), F.trim(F.regexp_extract(text, pair, 1))).otherwise(text)
    blanked = F.regexp_replace(named, rf"(?iu)(?<![{LETTERS}0-9_])({'|'.join(stop_words)})(?![{LETTERS}0-9_])", " ")
    plain = F.trim(F.regexp_replace(F.upper(squeeze(F.regexp_replace(blanked, rf"[^{LETTERS}\s]", " "))), PREFIXES, ""))
    real = F.exists(F.split(plain, " "), lambda w: F.length(w) >= 3)
    return F.when(real & ~plain.isin(*rejected), plain)


def raw_place(value: Column, regions: Sequence[str] = (), labels: Sequence[str] = PLACE_STOP_WORDS) -> Column:
    """Text for gazetteer search: no digits, months, labels or regions (the longest region first), letters only."""
    words = [*labels, "ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"]
    upper = F.regexp_replace(F.upper(value), "[0-9]", " ")
    upper = F.regexp_replace(upper, rf"\b({'|'.join(words)})\b", " ")
    long = [re.escape(r.upper()) for r in regions if len(r) >= 4]
    if long:
        upper = F.regexp_replace(upper, rf"\b({longest_first(long)})\b", " ")
    return squeeze(F.regexp_replace(upper, r"[^A-ZÁÉÍÓÚÜÑ\s]", " "))


def gazetteer(places: DataFrame) -> DataFrame:
    """(name, name_norm, is_region, canonical) from (name, is_region, alias_of); each name once, of its aliases the first by code point."""
    rows = places.select("name", without_accents(F.trim("name")).alias("name_norm"), F.coalesce("is_region", F.lit(False)).alias("is_region"), F.coalesce("alias_of", "name").alias("canonical"))
    return rows.groupBy("name_norm", "is_region").agg(F.min_by(F.struct("name", "canonical"), F.struct("canonical", "name")).alias("n")).select("n.name", "name_norm", "is_region", "n.canonical")


def resolve_places(values: DataFrame, column: str, places: DataFrame, cutoff: float = 80.0) -> DataFrame:
    """values with `place`: the gazetteer's canonical name for each text.

    An alias or exact name (accents don't count) decides; else the most similar name at or above the cutoff.
    If that is a region the result is null. Only distinct texts without an exact match are compared.
    """
    names = gazetteer(places)
    key = without_accents(F.trim(F.col(column)))
    # a region of the same spelling hides nothing: the place comes first
    exact = names.groupBy(F.col("name_norm").alias("__key")).agg(F.min_by("canonical", F.struct("is_region", "name")).alias("__name"), F.min("is_region").alias("__region"))
    keyed = values.withColumn("__key", F.when(F.length(key) >= 3, key))
    joined = keyed.join(exact, "__key", "left")
    rest = joined.where(F.col("__name").isNull() & F.col("__key").isNotNull()).select("__key").distinct()
    close = best_match(rest, "__key", names.select(F.col("name_norm").alias("word"), "canonical", F.col("is_region").alias("region")), cutoff)
    close = close.select("__key", F.col("canonical").alias("__close"), F.col("region").alias("__close_region"))
    out = joined.join(close, "__key", "left")
    place = F.when(F.col("__name").isNotNull() & ~F.col("__region"), F.col("__name")).when(F.col("__name").isNull() & ~F.col("__close_region"), F.col("__close"))
    return out.withColumn("place", place).drop("__key", "__name", "__region", "__close", "__close_region")


def longest_first(names: Sequence[str]) -> str:
    """An alternation of names, the longest first, so that a name within another doesn't hide it."""
    return "|".join(sorted(names, key=lambda n: (-len(n), n)))


def extract_places(lines: DataFrame, places: DataFrame, keys: Sequence[str] = ("document_id", "page_number"), label: str = "PLACE OF ISSUE", max_regions: int = 1000) -> DataFrame:
    """(keys, place, stage): each page's place by four stages in turn.

    Names of regions are blanked first, the longest first; a gazetteer has some dozens, at most `max_regions`.

    1 "NAME (REGION)" on any line: the most similar name from 78 on, else the name as it stands. 2 near a line
    with the label (1 before to 2 after): a gazetteer name, or a word of four letters similar from 84 on. 3 a
    gazetteer name that is no region anywhere. 4 a word of four letters similar from 85 on. Names of any number of
    words are found, the longest at each place; within a stage the first line counts, then the first place on it.
    """
    from pyspark.sql import window as W

    near = W.Window.partitionBy(*keys).orderBy("line_index").rowsBetween(-2, 1)
    marked = lines.withColumn("__near", F.max(F.upper("text").rlike(label)).over(near))
    names = gazetteer(places)
    regions = [r["name"] for r in names.where("is_region").select("name").limit(max_regions + 1).collect()]
    if len(regions) > max_regions:
        raise ValueError(f"the gazetteer has more than {max_regions} regions")
    # a name that is a place as well stays
    towns = {r["name"] for r in names.where(~F.col("is_region") & F.col("name").isin(regions)).select("name").collect()} if regions else set()
    clean = raw_place(F.col("text"), [r for r in regions if r not in towns])

    rows = marked.select(*keys, "line_index", "__near", F.get(F.array(place_in_parentheses(F.array("text"))), 0)["name"].alias("__pair"), F.filter(F.split(clean, " "), lambda w: w != "").alias("__w"))
    plain = rows.select(*keys, "line_index", "__near", F.transform("__w", without_accents).alias("__w"))
    towns_only = names.where(~F.col("is_region") & (F.length("name_norm") >= 3)).select(F.split("name_norm", r"\s+").alias("words"), "canonical")
    known = longest_matches(plain, [*keys, "line_index", "__near"], "__w", towns_only)
    exact = known.select(*keys, "line_index", F.when(F.col("__near"), 2).otherwise(3).alias("stage"), F.col("canonical").alias("place"), F.col("at").alias("n"))
    pairs = rows.where(F.col("__pair").isNotNull()).select(*keys, "line_index", "__pair")
    resolved = resolve_places(pairs, "__pair", places, 78.0).select(*keys, "line_index", F.lit(1).alias("stage"), F.coalesce("place", F.upper("__pair")).alias("place"), F.lit(0).alias("n"))
    words = plain.select(*keys, "line_index", "__near", F.posexplode("__w").alias("n", "__k")).where(F.length("__k") >= 4)
    close = best_match(words.select("__k").distinct(), "__k", names.select(F.col("name_norm").alias("word"), "canonical", F.col("is_region").alias("region")), 84.0).where(~F.col("region"))
    fuzzy = words.join(close, "__k").where(F.col("__near") | (F.col("ratio") >= 85)).select(*keys, "line_index", F.when(F.col("__near"), 2.5).otherwise(4).alias("stage"), F.col("canonical").alias("place"), "n")
    every = exact.withColumn("stage", F.col("stage").cast("double")).unionByName(resolved.withColumn("stage", F.lit(1.0))).unionByName(fuzzy.withColumn("stage", F.col("stage").cast("double")))
    best = F.min_by(F.struct("place", F.floor("stage").cast("int").alias("stage")), F.struct("stage", "line_index", "n", "place"))
    return every.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.place", "b.stage")


def place_in_parentheses(lines: Column) -> Column:
    """The first "NAME (REGION)" of any line, as struct<name, region>."""
    pattern = rf"([{LETTERS} ]{{3,30}}?)\s*\(\s*([{LETTERS} ]{{3,30}}?)\s*\)"
    found = F.filter(F.transform(F.filter(lines, lambda x: x.contains("(")), lambda x: F.struct(F.trim(F.regexp_extract(x, pattern, 1)).alias("name"), F.trim(F.regexp_extract(x, pattern, 2)).alias("region"))), lambda s: s["name"] != "")
    return F.get(found, 0)
