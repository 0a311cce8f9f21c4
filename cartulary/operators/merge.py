"""Merging records: the latest value of each field, the best evidence, and two sides of one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.ids import is_synthetic
from cartulary.functions.text import full_name

#: Fixed value: what stands for a name that has not been read.
UNREAD = "POR REVISAR"


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def is_record(id_number: str = "id_number", given: str = "given_names", surnames: str = "surnames") -> Column:
    """A row to store: it has a number that is not synthetic, or both names."""
    read = lambda c: _given(c) & (F.col(c) != UNREAD)
    return F.coalesce(_given(id_number) & ~F.col(id_number).startswith("SIN_ID"), F.lit(False)) | F.coalesce(read(given) & read(surnames), F.lit(False))


def needs_review(threshold: float = 0.70, fields: Sequence[str] = ("given_names", "surnames", "id_number", "issue_date", "issue_place")) -> Column:
    """Low confidence, a field that is missing, or a synthetic number."""
    missing = [~_given(f) for f in fields]
    out = F.coalesce(F.col("confidence"), F.lit(0.0)) < threshold * 100
    for m in missing:
        out = out | m
    return out | F.coalesce(is_synthetic(F.col("id_number")), F.lit(False))


def record_status(engine: Column, review: Column) -> Column:
    return F.when(engine == "tesseract_fallback", "FALLBACK_TESSERACT").when(review, "REVIEW_REQUIRED").otherwise("VALID")


def upsert(updates: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], score: str, carried: Sequence[str]) -> DataFrame:
    """One row a key: of each field the last value that is not null, and score with carried from the best row.

    Of equal scores the earliest counts: a later row must exceed. These are aggregates with partial results, so
    a key of any number of rows is combined before the shuffle.
    """
    at = F.struct(*[F.col(c) for c in order])
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    # the earliest of the best rows: with the score negated, the smallest
    best = F.min_by(F.struct(score, *carried), F.struct(F.col(score).isNull(), -F.col(score), at))
    return updates.groupBy(key).agg(*latest, best.alias("__best")).select(key, *fields, "__best.*")


def merge_into(store: DataFrame, updates: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], score: str, carried: Sequence[str]) -> DataFrame:
    """The store after updates, in the order of their columns; stored rows come before all updates."""
    columns = [key, *fields, score, *carried, *order]
    before = store.select(*columns).withColumn("__new", F.lit(0))
    return upsert(before.unionByName(updates.select(*columns).withColumn("__new", F.lit(1))), key, ["__new", *order], fields, score, carried)


def merged_field(front: Column, back: Column, prefer_back: bool = False) -> Column:
    """struct<value, confidence, status> of two struct<value, confidence>: agreement adds .05 (.99 at most),
    a conflict has .50 and needs review, one side is copied, none is missing."""
    first, second = (back, front) if prefer_back else (front, back)
    a, b = first["value"], second["value"]
    confidence = (
        F.when(a.isNotNull() & b.isNotNull() & (a == b), F.least(F.lit(0.99), F.greatest(first["confidence"], second["confidence"]) + 0.05))
        .when(a.isNotNull() & b.isNotNull(), 0.5)
        .when(a.isNotNull(), first["confidence"])
        .when(b.isNotNull(), second["confidence"])
        .otherwise(0.0)
    )
    status = F.when(a.isNull() & b.isNull(), "MISSING_DATA").when(a.isNotNull() & b.isNotNull() & (a != b), "REVIEW_REQUIRED").otherwise("VALID")
    return F.struct(F.coalesce(a, b).alias("value"), confidence.alias("confidence"), status.alias("status"))


def merge_sides(fronts: DataFrame, backs: DataFrame, key: str, fields: Sequence[str], from_back: Sequence[str] = ("issue_date", "issue_place")) -> DataFrame:
    """One row a group with each field merged; a group with only a back has no names."""
    f, b = fronts.alias("f"), backs.alias("b")
    joined = f.join(b, key, "full_outer")
    names = ("given_names", "surnames")
    only_back = F.coalesce(*[F.col(f"f.{x}") for x in fields]).isNull()
    merged = {x: merged_field(F.col(f"f.{x}"), F.col(f"b.{x}"), x in from_back) for x in fields}
    return joined.select(key, *[(F.when(~only_back, m) if x in names else m).alias(x) for x, m in merged.items()])


def mean_side_confidence(front: Column, back: Column) -> Column:
    return (F.coalesce(front, F.lit(70.0)) + F.coalesce(back, F.lit(70.0))) / 2


def field_status(df: DataFrame, key: str, fields: Sequence[str], critical: Sequence[str]) -> DataFrame:
    """(key, field, value, status): VALID with a value; else MISSING_DATA for critical fields and REVIEW_REQUIRED for others."""
    long = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], list(fields), "field", "value")
    status = F.when(F.coalesce("value", F.lit("")) != "", "VALID").when(F.col("field").isin(*critical), "MISSING_DATA").otherwise("REVIEW_REQUIRED")
    return long.withColumn("status", status)


def repaired_names(given: Column, surnames: Column, other_given: Column, other_surnames: Column) -> Column:
    """struct<given_names, surnames>: where both are the same text, another reading of one of them if it differs."""
    same = given == surnames
    return F.struct(
        F.when(same & (other_given != surnames), other_given).otherwise(given).alias("given_names"),
        F.when(same & (other_given == surnames) & (other_surnames != given), other_surnames).otherwise(surnames).alias("surnames"),
        full_name(given, surnames).alias("before"),
    )
