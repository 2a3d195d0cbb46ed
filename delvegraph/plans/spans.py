"""Points in spans by equal joins: no point meets all spans of its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_span(points: DataFrame, spans: DataFrame, key: str, best: Column) -> DataFrame:
    """(key, at, best): for each distinct ``points(key, at)`` in some span, the largest ``best``
    of the ``spans(key, start, stop, ...)`` with start <= at < stop.

    A span is cut into blocks of 2^k at multiples of 2^k, two of a size at most; a point
    lies in one block of each size, so both sides are joined on (key, size, block).
    """
    s = spans.select(key, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), best.alias("best")).filter("start < stop")
    s = s.groupBy(key, "start", "stop").agg(F.max("best").alias("best"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("length(bin(stop - start)) - 1"))))
    s = s.withColumns({"l": F.expr("-shiftright(-start, k)"), "r": F.expr("shiftright(stop, k)")}).filter("l < r")
    s = s.select(key, "k", "best", F.explode(F.expr("filter(array(if(l & 1L = 1L, l, null), if(r & 1L = 1L, r - 1, null)), x -> x is not null)")).alias("block"))
    blocks = s.groupBy(key, "k", "block").agg(F.max("best").alias("best"))
    sizes = blocks.select("k").distinct()  # 64 at most
    p = points.select(key, F.col("at").cast("long").alias("at")).filter(f"{key} is not null and at is not null").distinct()
    p = p.crossJoin(F.broadcast(sizes)).withColumn("block", F.expr("shiftright(at, k)"))
    return p.join(blocks, [key, "k", "block"]).groupBy(key, "at").agg(F.max("best").alias("best"))
