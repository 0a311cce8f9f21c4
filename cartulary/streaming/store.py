"""A stored table in key ranges: a merge rewrites only the ranges that it touches, and one small write switches to it.

    data/part=7/version=12/...     the rows of key range 7 as merge 12 wrote them
    manifest/number=12/...         one row a range: part, its lowest key, the version that holds its rows

The manifest of the highest number is the table. Each merge writes the touched ranges under its own number, then a
manifest of one file, which appears as a whole or not at all; so readers see the table before a merge or after it. A
merge that is repeated after a failure starts from the same manifest and writes the same paths again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.merge import merge_into, upsert

#: Ranges of a table at most: their lowest keys are held by the driver and in expressions.
MOST_PARTS = 4096


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests that are whole."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(part, low, version) of the newest table, or of the newest before a merge; None if there is none."""
    numbers = [n for n in _manifests(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/manifest/number={numbers[-1]}") if numbers else None


def _files(path: str, rows) -> list[str]:
    return [f"{path}/data/version={r.version}/part={r.part}" for r in rows]


def _range_of(key: Column, lows: Sequence) -> Column:
    """The place of the last range whose lowest key isn't above a key; keys below all, and null, are in the first."""
    if len(lows) < 2:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in lows[1:]]), lambda low: F.coalesce(low <= key, F.lit(False))))


def _commit(spark: SparkSession, path: str, number: int, rows: list[tuple], low_type: str) -> None:
    spark.createDataFrame(rows, f"part int, low {low_type}, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={number}")


def create(df: DataFrame, path: str, key: str, parts: int, number: int = 0) -> None:
    """Write df, one row a key, as a new table of at most `parts` ranges of about equally many keys."""
    parts = min(parts, MOST_PARTS)
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    target = f"{path}/data/version={number}"
    df.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(target)
    if df.limit(1).count():
        lows = spark.read.parquet(target).groupBy("part").agg(F.min(key).alias("low")).orderBy("part").collect()  # MOST_PARTS rows at most
    else:
        lows = []
        df.withColumn("part", F.lit(0)).drop("part").write.mode("overwrite").parquet(f"{target}/part=0")
    rows = [(r.part, r.low, number) for r in lows] or [(0, None, number)]
    _commit(spark, path, number, rows, kind)


def merge(updates: DataFrame, path: str, number: int, key: str, order: Sequence[str], fields: Sequence[str], score: str, carried: Sequence[str], parts: int = 64) -> list[int]:
    """Merge updates into the table as merge `number`, by the rules of operators.merge; the ranges that were written.

    A table's first merge makes it. Only the ranges that hold a key of the updates are read and written. Columns of
    the order are kept: they are those of a key's newest row. Null keys are one key.
    """
    spark = updates.sparkSession
    rows = updates.select(key, *order, *fields, score, *carried)
    newest = lambda df: df.groupBy(key).agg(F.max(F.struct(*order)).alias("__o"))

    def joined(merged: DataFrame, latest: DataFrame) -> DataFrame:
        named = latest.select(F.col(key).alias("__k"), "__o.*")
        return merged.join(named, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")

    current = manifest(spark, path, before=number)
    if current is None:
        create(joined(upsert(rows, key, order, fields, score, carried), newest(rows)), path, key, parts, number)
        return [r.part for r in manifest(spark, path).collect()]
    ranges = current.orderBy("part").collect()  # MOST_PARTS rows at most
    at = _range_of(F.col(key), [r.low for r in ranges])
    touched = sorted(r[0] for r in rows.select(at.alias("at")).distinct().collect())
    if touched:
        before = spark.read.parquet(*_files(path, [ranges[i] for i in touched]))
        merged = merge_into(before, rows, key, order, fields, score, carried)
        latest = newest(rows.select(key, *order).unionByName(before.select(key, *order)))
        # the range's own number, as ranges may be fewer than parts
        part = F.element_at(F.array(*[F.lit(r.part) for r in ranges]), at + 1)
        out = joined(merged, latest).withColumn("part", part)
        out.repartition(len(touched), "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={number}")
    changed = {ranges[i].part for i in touched}
    _commit(spark, path, number, [(r.part, r.low, number if r.part in changed else r.version) for r in ranges], dict(current.dtypes)["low"])
    return sorted(changed)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest manifest has it."""
    rows = manifest(spark, path).collect()
    return spark.read.parquet(*_files(path, rows))


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the ranges that none of the newest `keep` manifests names, and older manifests; how many ranges went.

    Readers of the newest manifests aren't disturbed; one that has been reading an older one for long is.
    """
    numbers = _manifests(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = set()
    for n in numbers[-keep:]:
        named |= set(_files(path, spark.read.parquet(f"{path}/manifest/number={n}").collect()))
    data = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs, gone = data.getFileSystem(conf), 0
    for version in fs.listStatus(data):
        if int(version.getPath().getName().split("=")[1]) > numbers[-1]:
            continue  # a merge that is under way
        parts = [p.getPath() for p in fs.listStatus(version.getPath()) if p.getPath().getName().startswith("part=")]
        old = [p for p in parts if f"{path}/data/{version.getPath().getName()}/{p.getName()}" not in named]
        for p in old:
            fs.delete(p, True)
        gone += len(old)
        if len(old) == len(parts):
            fs.delete(version.getPath(), True)
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/number={n}"), True)
    return gone
