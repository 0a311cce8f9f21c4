"""What the operators of this subpackage share: tables between stages, and word rules."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Sets of ids up to this size may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Spark's setting that deletes the shuffle files of a query when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark passes to Python at once: whole texts may be long, and each batch is held on both sides.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WHILE_WRITING = {FREE_SHUFFLES: "true", ARROW_ROWS: "2000"}

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cartulary-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame from materialize() that nothing reads any more."""
    path = getattr(df, "_cartulary_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the shared folder is cleaned by its owner
            return


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    Nothing reads the shuffles of the write once it has ended, so their files go then, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cartulary-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    was = {k: spark.conf.get(k) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cartulary_path = path
    return out


def small_or_shuffled(keys: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a written table of keys for broadcast if its checked size allows it; else leave the join to a shuffle."""
    return F.broadcast(keys) if keys.count() * row_bytes <= BROADCAST_BYTES else keys


def free_memory() -> None:
    """Give back what a task held: a Python worker outlives its task, and its allocators keep freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def row_hash(df: DataFrame, text: str = "text", source: str = "source") -> Column:
    """Tells rows of one id apart by their text, language and source; equal rows share it, and null is a value of its own."""
    held = [F.col(f"`{c}`") for c in (text, "lang", source) if c in df.columns]
    return F.xxhash64(*[x for c in held for x in (c.isNull(), c.cast("string"))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that df does not hold yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to write; in a clash the operator's column wins."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
