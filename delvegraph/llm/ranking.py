"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.llm.storage import materialize, shuffle_partitions


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the order of ``order``: ranges of rows
    are sorted apart and offset by the prefix sums of their counts.

    Nulls come first; rows equal in ``order`` are numbered in any order, once; an
    empty table stays empty.  Columns named ``__part``, ``__nth`` and ``__before``
    may not be there already.
    """
    spark = df.sparkSession
    laid = materialize(df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return laid.withColumn("__nth", F.row_number().over(inside)).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__nth") - 1).drop("__part", "__nth", "__before")
