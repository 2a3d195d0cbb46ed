"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    Where neither is set, a folder of our own is made, but only if driver and
    executors are one machine: elsewhere its files would be lost to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="delvegraph-"))
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd", **measures: Column) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without computing ``df`` again.  ``table_path`` names the folder;
    ``measures`` are aggregates taken while the table is written, which
    ``measured`` of the result holds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/delvegraph/{tag}-{uuid.uuid4().hex[:12]}"
    seen = Observation()
    watched = df.observe(seen, *(c.alias(n) for n, c in measures.items())) if measures else df
    watched.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path, out.measured = path, seen.get if measures else {}
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    path = getattr(df, "table_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
