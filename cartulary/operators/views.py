"""Listings, searches, summary views and exports of stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equal_if_given(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows that equal every value that is not None; False and 0 are values."""
    return df.where(all_of([F.col(c) == v for c, v in values.items() if v is not None]))


def equal_if_truthy(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """As equal_if_given, but an empty value means no filter either."""
    return equal_if_given(df, {c: v or None for c, v in values.items()})


def escaped_pattern(query: str) -> str:
    """A pattern that finds the query as it stands."""
    return query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(df: DataFrame, query: str | None, columns: Sequence[str], escaped: bool = False) -> DataFrame:
    """Rows with the query, in any case, in one of the columns; % and _ are wildcards unless escaped."""
    if not query:
        return df
    text = escaped_pattern(query) if escaped else query
    return df.where(reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike(f"%{text}%") for c in columns]))


def loose_search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """As list filters do: dots and spaces leave the query and the ids; lower case; contained in a column."""
    q = query.replace(".", "").replace(" ", "").lower()
    return df.where(reduce(lambda a, b: a | b, [F.lower(F.translate(F.col(c).cast("string"), ".", "")).contains(q) for c in columns]))


def page(df: DataFrame, newest: str, tie: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the newest rows first (null times first of all); ties by another column, so pages don't overlap."""
    return df.orderBy(F.col(newest).desc_nulls_first(), F.col(tie)).offset(offset).limit(limit)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key).cast("string") == F.trim(F.lit(value))).limit(1)


def visible_to(df: DataFrame, owner: str, user: object, is_admin: bool) -> DataFrame:
    """An administrator's view of all rows, or a user's of their own."""
    return df if is_admin else df.where(F.col(owner) == user)


def active_user(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("active") & (F.lower("email") == email.lower()))


def updated(df: DataFrame, changes: Mapping[str, object], reviewed: Sequence[str] = ("given_names", "surnames")) -> DataFrame:
    """Rows with the changes that are not None, texts in upper case; changed reviewed fields join reviewed_fields once."""
    given = {c: v for c, v in changes.items() if v is not None}
    out = df.withColumns({c: F.upper(F.lit(v)) if isinstance(v, str) else F.lit(v) for c, v in given.items()})
    marked = [c for c in reviewed if c in given]
    return out.withColumn("reviewed_fields", F.array_union(F.coalesce("reviewed_fields", F.array().cast("array<string>")), F.array(*[F.lit(c) for c in marked]))) if marked else out


def deleted(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def of_stored(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Records whose document is stored, to be asked before records are written."""
    return records.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def document_summary(documents: DataFrame, users: DataFrame, records: DataFrame) -> DataFrame:
    """Documents with their user, number of records and of records under review; orphans stay.

    Records are counted before the join, so no document row is multiplied.
    """
    counts = records.groupBy(F.col("document_id").alias("__d")).agg(F.count("id").alias("records"), F.count_if("requires_review").alias("in_review"))
    owners = users.select(F.col("id").alias("__u"), F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    joined = documents.join(owners, F.col("user_id") == F.col("__u"), "left").join(counts, F.col("id") == F.col("__d"), "left")
    return joined.drop("__u", "__d").na.fill(0, ["records", "in_review"])


def statistics(documents: DataFrame, records: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Counters in one row; each table is read once."""
    status = lambda s: F.count_if(F.col("status") == s)
    d = documents.agg(
        F.count(F.lit(1)).alias("documents"), status("completado").alias("completed"), status("procesando").alias("in_process"), status("error").alias("failed"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")
    )
    r = records.agg(F.count(F.lit(1)).alias("records"), F.count_if("requires_review").alias("in_review"))
    return d.crossJoin(r).crossJoin(comparisons.agg(F.count(F.lit(1)).alias("comparisons")))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * done / total)).otherwise(0.0)


def is_complete(*columns: str) -> Column:
    """All columns have a value that is not empty."""
    return all_of([F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns])


def export(df: DataFrame, names: Mapping[str, str], flags: Sequence[str] = (), times: Sequence[str] = (), newest: str | None = None, then: Sequence[str] = ()) -> DataFrame:
    """Columns under their report names: flags as SÍ or NO, times as dd/MM/yyyy HH:mm; the newest first, if a column tells.

    Rows of one time are in the order of the columns `then`.
    """
    df = df.orderBy(F.col(newest).desc_nulls_first(), *then) if newest else df

    def shown(c: str) -> Column:
        if c in flags:
            return F.when(F.col(c), "SÍ").otherwise("NO")
        return F.date_format(c, "dd/MM/yyyy HH:mm") if c in times else F.col(c)

    return df.select(*[shown(c).alias(n) for c, n in names.items()])


def export_summary(df: DataFrame) -> DataFrame:
    """One row: how many rows an export has, and when it was made."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.current_timestamp(), "dd/MM/yyyy HH:mm").alias("made_at"))


def completion(records: DataFrame) -> DataFrame:
    """A document's completion row: pages, mean confidence to two places (0 without records), status."""
    return records.groupBy("document_id").agg(F.max("page_number").alias("pages"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 2).alias("mean_confidence"), F.lit("completado").alias("status"))
