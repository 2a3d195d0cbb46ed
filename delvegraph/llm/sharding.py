"""Contiguous byte-balanced shards from global prefix sums.

Rows are laid out in one global order (by ``doc_id``), each range partition
contributes one total, and the prefix sums of those totals give every row its
global byte offset.  Shard ``k`` takes the rows whose middle byte lies in the
``k``-th of ``n_shards`` equal slices of the whole, so shards are contiguous in
the order and their sizes differ by about one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.llm.storage import materialize, shuffle_partitions


def byte_balanced_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, start_byte.

    Null text counts no bytes (size 1).  Rows with equal ids keep a fixed order
    by size and checksum; rows equal in all three are interchangeable.  A null
    id sorts first.  An empty table gives an empty result.  Other columns of
    ``docs`` are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    laid = materialize(
        rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "shard-order",
    )
    # One row for each range partition: a bounded table, whatever the input.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        laid.withColumn("run", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")
        .select(
            *order,
            (F.col("bytes_before") + F.col("run") - F.col("size")).alias("start_byte"),
            (F.col("rows_before") + F.col("nth") - 1).alias("row_index"),
            "all_bytes",
        )
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * start_byte + size) * {n_shards}) div (2 * all_bytes)) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("row_index").alias("first_index"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(*order, "shard", (F.col("row_index") - F.col("first_index")).cast("long").alias("slot"), "start_byte")
