"""Global row numbers and running sums without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.plans.staging import stage


def numbered(df: DataFrame, order: list[Column], name: str = "nth", running: Column | None = None, running_name: str = "run") -> DataFrame:
    """``df`` with a gapless number from 0 in ``order`` (which has to be total), and the
    sum of ``running`` up to and with each row.

    Ranges of rows are sorted apart; the prefix sums of what the ranges hold, one
    row for each, place them.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [f"__o{i}" for i in range(len(order))]
    # the order is computed before the rows are laid out, so that both passes sort by the same values
    plain, ways = zip(*((c[0], c[1]) if isinstance(c, tuple) else (c, True) for c in order), strict=True)
    cost = F.lit(0) if running is None else running
    rows = df.withColumns({**dict(zip(keys, plain, strict=True)), "__v": cost})
    by = [F.col(k).asc() if up else F.col(k).desc() for k, up in zip(keys, ways, strict=True)]
    laid = stage(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = laid.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("v"))
    starts = totals.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("__v0"))
    inside = Window.partitionBy("__p").orderBy(*by)
    out = laid.withColumn(name, F.row_number().over(inside)).withColumn("__r", F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(F.broadcast(starts), "__p")
    out = out.withColumn(name, F.col("__n0") + F.col(name) - 1)
    if running is not None:
        out = out.withColumn(running_name, F.col("__v0") + F.col("__r"))
    return out.drop("__p", "__v", "__r", "__n0", "__v0", *keys)
