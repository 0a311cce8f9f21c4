"""The Spark session that tests and benchmarks use, and where lineage ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session with adaptive execution; on a cluster the submitter's settings win."""
    return (
        SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("cartulary")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in a folder of our own only in local mode, where that is unset."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{configured.rstrip('/')}/{name}-{uuid.uuid4().hex}" if configured else tempfile.mkdtemp(prefix=f"cartulary-{name}-")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir; one of our own only in local mode, where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cartulary-"))
    return df.checkpoint()
