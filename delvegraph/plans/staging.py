"""Staged tables for iterative plans.

A loop that joins its own result grows its lineage every round.  ``stage`` writes
a round's table into the folder that the cluster shares (``spark.checkpoint.dir``)
and reads it back, so a lost executor costs one round, not the whole loop.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: About the most rows of one part of a held table.
PART_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="delvegraph-"))
    return root.rstrip("/")


def stage(df: DataFrame, tag: str = "round", **measures: Column) -> DataFrame:
    """Write ``df`` and read it back.  ``measures`` are aggregates taken while it is
    written; ``measured`` of the result holds them, and ``rows`` the row count."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{tag}-{uuid.uuid4().hex[:12]}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items())).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path, out.measured = path, seen.get
    return out


def unstage(df: DataFrame) -> None:
    """Delete a stage that no later plan reads."""
    path = getattr(df, "stage_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hold(df: DataFrame, *keys: str, tag: str = "held") -> DataFrame:
    """Stage ``df`` and keep it dealt and sorted by ``keys``: rounds that join on them move
    only their other side.  What an executor loses is read again from the stage; a table
    that is held by these keys already is left as it is."""
    if getattr(df, "held_by", None) == keys:
        return df
    spark = df.sparkSession
    laid = df if getattr(df, "stage_path", None) else stage(df, tag)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(laid.measured["rows"] / PART_ROWS))
    out = laid.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    out.measured, out.held_by = laid.measured, keys
    return out
