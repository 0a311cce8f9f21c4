"""Records that arrive as files, merged into a stored table batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cartulary.streaming import store as stored


def start_upserts(
    spark: SparkSession, source: str, schema, store: str, checkpoint: str, key: str, order: Sequence[str], fields: Sequence[str], score: str, carried: Sequence[str], files_per_batch: int = 100, parts: int = 64, keep: int = 2
):
    """Read Parquet files as they come, until none is left, and merge each batch into the store's key ranges.

    A batch rewrites only the ranges of its keys and is merge number `batch`: one that is repeated after a failure
    starts from the manifest before it and writes the same one, so nothing is merged twice. What no manifest of the
    newest `keep` names is deleted after each batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        stored.merge(batch, store, number, key, order, fields, score, carried, parts)
        stored.drop_old(batch.sparkSession, store, keep)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"upserts-{uuid.uuid4().hex}").start()


def latest_version(spark: SparkSession, store: str) -> DataFrame:
    """The store after the last batch."""
    return stored.read(spark, store)
