"""Reconciliation of a record store with an external table: one full outer join on the key.

reconcile_to() needs that join, and one job, for everything: differences are written by kind while counters are
observed on the way; reports are then read from what was written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cartulary.functions.text import comparison_key
from cartulary.schemas import WHOLE_RECORD

#: What a report shows of a record that the store knows nothing of, and its line if all records agree.
REPORT_DEFAULTS = {"group_id": "DOC-001", "engine": "google_document_ai", "record_status": "REVIEW_REQUIRED"}
NO_DIFFERENCES = ("N/A", "-", "-", "-", "-", "-", "-", "SIN DIFERENCIAS", 100.0, "VALID", "-", "all records agree")
WRITTEN = "field string, store_value string, external_value string, comparison_id string, diff_kind string"


def matched(store: DataFrame, external: DataFrame, key: str, fields: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """One row a key: key, in_store, in_external, s, e, `differing`, the fields whose keys for comparison differ, and
    rows_s, rows_e, how many rows of either side bear the key.

    A repeated key counts once: its first row by the ordinal, or by its fields. A field that the external table
    lacks is empty there, so that any value in the store differs from it. Null keys match nothing: a row without key
    holds the number of such rows on its side and neither in_store nor in_external.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        picked = F.struct(*[(F.col(f) if f in df.columns else F.lit(None)).cast("string").alias(f) for f in fields])
        order = F.struct(F.col(ordinal)) if ordinal and ordinal in df.columns else picked
        return df.groupBy(key).agg(F.min_by(picked, order).alias(name), F.count(F.lit(1)).alias(f"rows_{name}")).withColumn(f"in_{name}", F.col(key).isNotNull())

    joined = side(store, "s").join(side(external, "e"), key, "full_outer")
    differs = [F.when(comparison_key(F.col(f"s.{f}")) != comparison_key(F.col(f"e.{f}")), F.lit(f)) for f in fields]
    both = F.coalesce(F.col("in_s") & F.col("in_e"), F.lit(False))
    differing = F.when(both, F.filter(F.array(*differs), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return joined.select(key, F.coalesce("in_s", F.lit(False)).alias("in_store"), F.coalesce("in_e", F.lit(False)).alias("in_external"), "s", "e", differing.alias("differing"), F.coalesce("rows_s", F.lit(0)).alias("rows_s"), F.coalesce("rows_e", F.lit(0)).alias("rows_e"))


def record_text(record: Column, fields: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(record[f], F.lit("")) for f in fields])


def differences(pairs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row a difference: key, field, store_value, external_value, diff_kind; equal records give none."""
    value = lambda side, f: F.nullif(F.col(f"{side}.{f}"), F.lit(""))
    each = F.array(*[F.struct(F.lit(f).alias("field"), value("s", f).alias("store_value"), value("e", f).alias("external_value"), F.lit("diferente").alias("diff_kind")) for f in fields])
    changed = F.filter(each, lambda x: F.array_contains(F.col("differing"), x["field"]))
    none = F.lit(None).cast("string")
    whole = lambda s, e, kind: F.array(F.struct(F.lit(WHOLE_RECORD).alias("field"), s.alias("store_value"), e.alias("external_value"), F.lit(kind).alias("diff_kind")))
    absent = whole(none, record_text(F.col("e"), fields), "faltante_bd")
    new = whole(record_text(F.col("s"), fields), none, "nuevo_bd")
    rows = F.when(~F.col("in_store"), absent).when(~F.col("in_external"), new).otherwise(changed)
    return pairs.where(F.col(key).isNotNull()).select(key, F.inline(rows))


def reconcile(store: DataFrame, external: DataFrame, key: str, fields: Sequence[str], ordinal: str | None = None) -> DataFrame:
    return differences(matched(store, external, key, fields, ordinal), key, fields)


def counters() -> list[Column]:
    """Aggregates over matched(): the six counters of a comparison.

    With an empty store every external row counts as missing, else every external key.
    """
    both, known = F.col("in_store") & F.col("in_external"), F.col("in_store") | F.col("in_external")
    same = F.size("differing") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    missing = F.when(total("rows_s") == 0, total("rows_e")).otherwise(F.count_if(known & ~F.col("in_store")))
    return [
        total("rows_s").alias("store_rows"), total("rows_e").alias("external_rows"), F.count_if(both & same).alias("equal"), F.count_if(both & ~same).alias("different"), missing.alias("missing_in_store"),
        F.count_if(known & ~F.col("in_external")).alias("new_in_store"),
    ]


def summary(pairs: DataFrame) -> DataFrame:
    """One row of counters, from matched() alone."""
    return pairs.agg(*counters())


def reconcile_to(store: DataFrame, external: DataFrame, key: str, fields: Sequence[str], path: str, comparison_id: str, ordinal: str | None = None) -> dict[str, int]:
    """Write the differences under path, a folder for each kind, and return the counters of the comparison.

    One job with one full outer join. The counters are observed in the tasks that write, of which each counts once
    however often it runs. Kinds without differences have no folder; what is at path before goes.
    """
    seen = Observation()
    pairs = matched(store, external, key, fields, ordinal).observe(seen, *counters())
    rows = differences(pairs, key, fields).withColumn("comparison_id", F.lit(comparison_id))
    rows.write.mode("overwrite").partitionBy("diff_kind").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def written_differences(spark, path: str, key: str, key_type: str = "string", kind: str | None = None) -> DataFrame:
    """The differences that reconcile_to() wrote; of one kind only its folder is read."""
    rows = spark.read.schema(f"`{key}` {key_type}, {WRITTEN}").parquet(path)
    return rows if kind is None else rows.where(F.col("diff_kind") == kind)


def metrics_long(counters: DataFrame) -> DataFrame:
    """A one-row frame of counters as (metric, value)."""
    return counters.unpivot([], counters.columns, "metric", "value")


def report(diffs: DataFrame, records: DataFrame, key: str, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Differences with what the store knows of their record, absent values replaced; one sentinel row if there are none.

    diffs: better a written table, as it is read again for the sentinel. records: key, group_id, front_page,
    back_page, page_number, engine, confidence, record_status. A left join replaces a look-up for each difference; of
    a repeated key the first row by these columns counts.
    """
    d = REPORT_DEFAULTS | dict(defaults or {})
    known = F.min(F.struct("group_id", "front_page", "back_page", "page_number", "engine", "confidence", "record_status")).alias("__known")
    joined = diffs.join(records.groupBy(key).agg(known).select(key, "__known.*"), key, "left")
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    reason = F.when(F.col("diff_kind") == "faltante_bd", "missing in the store").when(F.col("diff_kind") == "nuevo_bd", "missing in the external table").otherwise("values differ")
    rows = joined.select(
        F.col(key).cast("string").alias("id_number"),
        *[F.coalesce(text("group_id"), F.lit(d["group_id"])).alias("group_id")],
        F.coalesce(text("front_page"), text("page_number"), F.lit("1")).alias("front_page"),
        F.coalesce(text("back_page"), F.lit("-")).alias("back_page"),
        "field",
        F.coalesce("store_value", F.lit("")).alias("store_value"),
        F.coalesce("external_value", F.lit("")).alias("external_value"),
        F.upper("diff_kind").alias("diff_kind"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(text("record_status"), F.lit(d["record_status"])).alias("record_status"),
        F.coalesce(text("engine"), F.lit(d["engine"])).alias("engine"),
        reason.alias("reason"),
    )
    one = diffs.sparkSession.range(1)
    sentinel = one.select(*[F.lit(v).alias(c) for c, v in zip(rows.columns, NO_DIFFERENCES, strict=True)])
    some = diffs.limit(1).select(F.lit(1).alias("__some"))
    return rows.unionByName(sentinel.join(some, F.lit(True), "left_anti"))
