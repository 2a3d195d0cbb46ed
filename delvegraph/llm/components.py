"""Connected components of link tables too large for one machine.

Links are first contracted inside every partition (a spanning forest has at most
one link for each node there); alternating large-star and small-star steps then
turn what is left into stars around the smallest id of each component.  Hubs are
handled by partial aggregation and a broadcast of a bounded number of them, never by
gathering their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvegraph.llm.storage import drop, materialize, shuffle_partitions
from delvegraph.llm.worker import tidy


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


@tidy("links")
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    nodes = list(forest.parent)
    for i in range(0, len(nodes), 100_000):
        some = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([forest.find(x) for x in some], pa.int64())], names=["u", "v"])


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table and a signature of its rows, taken while it is written."""
    out = materialize(edges, "links", n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    return out, (out.measured["n"], out.measured["mark"])


#: A node of fewer links is no hub.
LEAST_HUB = 256


def _with_least(rows: DataFrame, many: int) -> DataFrame:
    """``rows(u, v)`` with the least ``v`` of each ``u`` as ``m``.

    The rows of a node with over ``many`` of them stay where they are and meet its
    ``m`` by broadcast, as there are few such nodes; the others are joined.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > many).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= many).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest id reachable, for every node that has a link.

    Ids are longs; links with a null end or to oneself link nothing.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    edges, seen = _written(pairs.mapInArrow(_contract, "u long, v long").distinct())
    if not seen[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    parts = shuffle_partitions(links.sparkSession)
    for _ in range(max_rounds):
        many = max(LEAST_HUB, seen[0] // (2 * parts))  # so there are 4 * parts hubs at most
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, many).withColumn("m", F.least("u", "m")).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, many).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new, now = _written(small)
        drop(edges)
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
