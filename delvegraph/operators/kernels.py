"""Order-dependent kernels on bounded inputs: communities, terminal connection, bins.

These algorithms' results depend on the order of moves, so they run as one
kernel over a bounded graph: a whole one, one of its connected components, or what
a distributed contraction leaves of a component that is larger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvegraph.plans.ranking import numbered
from delvegraph.plans.staging import hold, stage

#: The most edges a kernel takes.
KERNEL_EDGES = 2_000_000


def louvain(adj: dict[int, dict[int, float]], passes: int = 16, total: float | None = None) -> dict[int, int]:
    """Local moving in id order; ties go to the lower community; communities are
    numbered as first seen.  ``total`` is the weight of the whole graph, both ways, if
    ``adj`` is a component of it: nothing else of the others matters to it."""
    if total is None:
        total = sum(sum(n.values()) for n in adj.values())
    degree = {v: sum(n.values()) for v, n in adj.items()}
    of = {v: v for v in adj}
    weight = dict(degree)
    for _ in range(passes):
        moved = False
        for v in sorted(adj):
            own = of[v]
            weight[own] -= degree[v]
            to: dict[int, float] = {}
            for u, w in adj[v].items():
                if u != v:
                    to[of[u]] = to.get(of[u], 0.0) + w
            gain = lambda c: to.get(c, 0.0) - degree[v] * weight[c] / total if total else 0.0  # noqa: E731, B023
            best = min(sorted({own, *to}), key=lambda c: (-gain(c), c != own, c))
            if gain(best) <= gain(own) + 1e-12:
                best = own
            weight[best] += degree[v]
            if best != own:
                of[v] = best
                moved = True
        if not moved:
            break
    names: dict[int, int] = {}
    return {v: names.setdefault(of[v], len(names)) for v in sorted(adj)}


def communities(edges: DataFrame, bound: int = KERNEL_EDGES) -> DataFrame:
    """(id, community) of the undirected unit-weight graph of ``edges(src, dst)``.

    A graph of over ``bound`` edges is taken apart into its connected components, which
    do not see each other, so each is moved by a kernel in a task of its own, with the
    same result.  A component of over ``bound`` edges is first contracted by moves
    of many nodes at once.
    """
    ends = edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    pairs = stage(ends.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "pairs")
    n = pairs.measured["rows"]
    if n <= bound:
        found = louvain(_unit_graph((r.a, r.b) for r in pairs.orderBy("a", "b").toLocalIterator()))
        return edges.sparkSession.createDataFrame(sorted(found.items()), "id long, community int")
    labels = components(pairs)
    own = stage(pairs.join(labels.withColumnRenamed("id", "a").hint("merge"), "a"), "pairs")
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = stage(sizes.filter(F.col("n") > bound), "large")
    small = own.join(large.select("component"), "component", "left_anti").select("component", "a", "b")
    held = small.repartition("component").sortWithinPartitions("component", "a", "b").mapInArrow(_moved_components(2.0 * n), "id long, first long")
    if large.measured["rows"]:
        held = held.unionByName(_contracted(own.join(large.select("component"), "component", "left_semi").select("a", "b"), 2.0 * n, bound))
    held = stage(held, "communities")
    order = numbered(held.select("first").distinct(), [F.col("first")], "community")  # as first seen in the order of ids
    return held.join(order, "first").select("id", F.col("community").cast("int").alias("community"))


def _unit_graph(pairs: Iterable[tuple[int, int]]) -> dict[int, dict[int, float]]:
    adj: dict[int, dict[int, float]] = {}
    for a, b in pairs:
        adj.setdefault(a, {})[b] = 1.0
        adj.setdefault(b, {})[a] = 1.0
    return adj


def _firsts(found: dict[int, int]) -> dict[int, int]:
    """Members to the smallest member of their community."""
    first: dict[int, int] = {}
    return {v: first.setdefault(c, v) for v, c in sorted(found.items())}


def _moved_components(total: float):
    """Sorted rows (component, a, b) to (id, first): a kernel for each component, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            first = _firsts(louvain(_unit_graph(zip(*(np.concatenate(c).tolist() for c in zip(*held, strict=True)), strict=True)), total=total))
            return pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array(list(first.values()), pa.int64())], names=["id", "first"])

        now, held = None, []
        for batch in batches:
            comp, a, b = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(comp[1:] != comp[:-1]) + 1).tolist(), len(comp)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and comp[lo] != now:
                    yield finish()
                    held = []
                now = comp[lo]
                held.append((a[lo:hi], b[lo:hi]))
        if held:
            yield finish()

    return run


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of the undirected graph of ``pairs(a, b)``: the smallest id that a node
    is joined to.  A round takes the least label around a node, then that label's own."""
    both = hold(pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("to"))), "id")
    labels = stage(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("component")), "labels")
    while True:
        near = both.join(labels.hint("merge"), "id").groupBy(F.col("to").alias("id")).agg(F.min("component").alias("near"))
        low = stage(labels.join(near.hint("merge"), "id").select("id", F.least("component", "near").alias("low"), "component"), "labels")
        up = low.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = stage(low.join(up.hint("merge"), "low").select("id", F.col("next").alias("component"), F.col("component").alias("was")), "labels", moved=F.count_if(F.col("component") != F.col("was")))
        labels = new.select("id", "component")
        if not new.measured["moved"]:
            both.unpersist()
            return labels


def _contracted(pairs: DataFrame, total: float, bound: int, rounds: int = 6) -> DataFrame:
    """(id, first) of a graph of any size: in a round the nodes of one half, by a hash, move
    at once to the community that they gain most by; communities then become nodes of a
    weighted graph, until a kernel can take it or nothing moves."""
    spark = pairs.sparkSession
    graph = stage(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1.0).alias("w"))), "links")
    member = stage(graph.select(F.col("src").alias("id")).distinct().withColumn("node", F.col("id")), "members")
    while graph.measured["rows"] > 2 * bound:
        links = hold(graph, "dst")
        degree = graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
        state = stage(degree.withColumn("c", F.col("id")), "moves")
        moves = 0
        for nth in range(rounds):
            near = links.filter("src <> dst").join(state.select(F.col("id").alias("dst"), "c").hint("merge"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("k"))
            weight = state.groupBy("c").agg(F.sum("deg").alias("wc"))
            own = state.select("id", F.col("c").alias("own"), "deg")
            options = near.unionByName(state.select("id", "c", F.lit(0.0).alias("k"))).groupBy("id", "c").agg(F.sum("k").alias("k")).join(own.hint("merge"), "id").join(weight.hint("merge"), "c")
            mine = F.col("c") == F.col("own")
            gain = F.col("k") - F.col("deg") * (F.col("wc") - F.when(mine, F.col("deg")).otherwise(0.0)) / total
            best = options.groupBy("id", "own", "deg").agg(F.max_by("c", F.struct(gain.alias("g"), mine.alias("m"), (-F.col("c")).alias("o"))).alias("best"))
            to = F.when(F.pmod(F.xxhash64("id", F.lit(nth // 2)) + nth, F.lit(2)) == 0, F.col("best")).otherwise(F.col("own"))
            state = stage(best.select("id", "deg", to.alias("c"), "own"), "moves", moved=F.count_if(F.col("c") != F.col("own")))
            moves += state.measured["moved"]
        links.unpersist()
        if not moves:
            break
        node = state.select("id", "c").join(state.groupBy("c").agg(F.min("id").alias("node")), "c").select(F.col("id").alias("old"), "node")
        member = stage(member.withColumnRenamed("node", "old").join(node.hint("merge"), "old").select("id", "node"), "members")
        ends = graph.join(node.select(F.col("old").alias("src"), F.col("node").alias("s")).hint("merge"), "src").join(node.select(F.col("old").alias("dst"), F.col("node").alias("d")).hint("merge"), "dst")
        graph = stage(ends.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "links")
    if graph.measured["rows"] <= 2 * bound:
        adj: dict[int, dict[int, float]] = {}
        for r in graph.orderBy("src", "dst").toLocalIterator():
            adj.setdefault(r.src, {})[r.dst] = r.w
        table = spark.createDataFrame(sorted(louvain(adj, total=total).items()), "node long, c long")
        member = member.join(table, "node").select("id", F.col("c").alias("node"))
    return member.join(member.groupBy("node").agg(F.min("id").alias("first")), "node").select("id", "first")


def zoom(edges: DataFrame, groups: int = 10, levels: int = 8, bound: int = KERNEL_EDGES) -> DataFrame:
    """(id, level, community): repeated contraction until ``groups`` or fewer are left."""
    edges = stage(edges.select("src", "dst"), "links")
    out, now = None, stage(communities(edges, bound), "zoom")
    for level in range(1, levels + 1):
        one = now.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
        n = now.select("community").distinct().count()
        if n <= groups:
            break
        between = edges.join(now.select(F.col("id").alias("src"), F.col("community").alias("a")).hint("merge"), "src").join(now.select(F.col("id").alias("dst"), F.col("community").alias("b")).hint("merge"), "dst").filter("a <> b").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")).distinct()
        up = stage(communities(between, bound).select(F.col("id").cast("int").alias("community"), F.col("community").alias("up")), "zoom")
        if up.select("up").distinct().count() >= n:
            break
        now = stage(now.join(up, "community", "left").select("id", F.coalesce("up", (F.col("community") + F.lit(up.measured["rows"])).cast("int")).alias("community")), "zoom")
    return out.select("id", "level", "community")


def connect(edges: DataFrame, terminals: list[int], radius: int = 6) -> list[tuple[int, int]]:
    """Undirected edges of a tree that joins 2 to 16 terminals within ``radius`` hops.

    Each terminal's bounded search is distributed; the minimum spanning tree over
    at most 16 terminals (ties: distance, smaller ids) is built on the driver.
    """
    from delvegraph.operators.graph import shortest_path

    terminals = sorted(set(terminals))
    if not 2 <= len(terminals) <= 16:
        raise ValueError("2 to 16 terminals")
    one_way = stage(edges.select("src", "dst"), "links")
    both = hold(one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "src")  # every search joins it
    spark = edges.sparkSession
    one = lambda t: spark.createDataFrame([(t,)], "id long")
    paths = {}
    for i, a in enumerate(terminals):
        for b in terminals[i + 1 :]:
            p = shortest_path(both, one(a), one(b), radius)
            if p:
                paths[a, b] = p
    both.unpersist()
    inside, out = {terminals[0]}, set()
    while True:
        options = [(len(p), a, b) for (a, b), p in paths.items() if (a in inside) != (b in inside)]
        if not options:
            break
        _, a, b = min(options)
        inside |= {a, b}
        p = paths[a, b]
        out |= {(min(x, y), max(x, y)) for x, y in zip(p, p[1:], strict=False)}
    return sorted(out)


def pack_bins(groups: list[tuple[int, int]], bins: int) -> dict[int, int]:
    """Community -> bin: largest first into the lightest bin, lower bin on ties."""
    load, out = [0] * bins, {}
    for community, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        k = min(range(bins), key=lambda i: (load[i], i))
        load[k] += size
        out[community] = k
    return out
