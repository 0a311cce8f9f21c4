"""Writing results: each is one distributed write; a stored table is replaced by a new version of itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_differences(diffs: DataFrame, path: str, comparison_id: str, rows_per_file: int = 1_000_000) -> None:
    diffs.withColumn("comparison_id", F.lit(comparison_id)).write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_by_kind(report: DataFrame, path: str, kind: str = "diff_kind") -> None:
    """One folder a kind of difference, as a workbook has one sheet; kinds without rows have none."""
    report.write.mode("overwrite").partitionBy(kind).parquet(path)


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace(df: DataFrame, path: str) -> None:
    """Write the next version of a table; df may read any other version, not this path."""
    df.write.mode("errorifexists").parquet(path)
