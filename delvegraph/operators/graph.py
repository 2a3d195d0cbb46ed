"""Graph operators over ``edges(src, dst, w)`` and ``nodes(id, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.plans.ranking import numbered
from delvegraph.plans.staging import hold, stage, unstage


class AmbiguousName(ValueError):
    """A selector matched nothing, or more than it may."""


def simple_edges(refs: DataFrame) -> DataFrame:
    """One weighted edge for each (src, dst): w = min(sqrt(references), 8); no self loops."""
    return refs.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_ref")).withColumn("w", F.least(F.sqrt("n_ref"), F.lit(8.0)))


def fan(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): distinct neighbours either way."""
    ends = edges.select("src", "dst").distinct()
    each = ends.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(ends.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return each.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def reach(edges: DataFrame, seeds: DataFrame, forward: bool = True, hops: int | None = None) -> DataFrame:
    """(id, hop) of all nodes within ``hops`` of the seeds (id), seeds excluded.

    Breadth first: a round joins only the frontier with the edges, which are held by
    the end it starts from, and removes what was visited; the loop ends with an empty
    frontier, so cycles are safe.  ``hops`` below 1 counts as 1; None goes to the fixpoint.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    limit = None if hops is None else max(1, hops)
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).distinct()
    if limit != 1:
        step = hold(step, "id")
    visited = stage(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier, hop = visited, 0
    while limit is None or hop < limit:
        hop += 1
        new = stage(frontier.join(step, "id").select(F.col("to").alias("id")).distinct().join(visited, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if not new.measured["rows"]:
            break
        visited = visited.unionByName(new)
        frontier = new
    step.unpersist()
    return visited.filter("hop > 0")


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, prior: DataFrame | None = None, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(id, rank).  r' = alpha * inflow + (alpha * dangling + 1 - alpha) * prior, from r = prior.

    Dangling mass goes where the prior points; stops when the L1 change is
    below ``tol`` or after ``max_iter`` rounds (``tol=0``: exactly that many).
    ``prior(id, p)`` sums to one; None is uniform.

    Edges are held by their source, so a round moves ranks and inflows only; what
    dangling nodes hold and the change are summed while the round is written.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    p = nodes.select("id", F.lit(1.0 / n).alias("p")) if prior is None else nodes.select("id").join(prior, "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    links = hold(edges.select("src", "dst", "w"), "src", tag="links")
    out = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("wout"))
    lost = F.coalesce(F.sum(F.when(F.col("wout").isNull(), F.col("rank"))), F.lit(0.0))
    state = stage(p.join(out, "id", "left").select("id", "p", "wout", F.col("p").alias("rank")), "rank", lost=lost)
    for _ in range(max_iter):
        giving = state.filter("wout is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("wout")).alias("give"))
        inflow = links.join(giving.hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("give")).alias("inflow"))
        rank = alpha * F.coalesce("inflow", F.lit(0.0)) + (alpha * state.measured["lost"] + (1 - alpha)) * F.col("p")
        new = state.withColumnRenamed("rank", "old").join(inflow.hint("merge"), "id", "left").select("id", "p", "wout", rank.alias("rank"), "old")
        new = stage(new, "rank", lost=lost, change=F.sum(F.abs(F.col("rank") - F.col("old"))))
        unstage(state)
        state = new.drop("old")
        state.stage_path, state.measured = new.stage_path, new.measured
        if state.measured["change"] < tol:
            break
    links.unpersist()
    return state.select("id", "rank")


def name_prior(nodes: DataFrame) -> DataFrame:
    """(id, p): uniform, halved for names of over 5 definitions and for a leading
    underscore, times 1.7 for names of 8 characters and 2 words or more; sums to 1."""
    defs = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("defs"))
    parts = F.size(F.filter(F.split(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+"), lambda s: s != ""))
    weight = (
        F.when(F.col("defs") > 5, 0.5).otherwise(1.0)
        * F.when(F.col("name").startswith("_"), 0.5).otherwise(1.0)
        * F.when((F.length("name") >= 8) & (parts >= 2), 1.7).otherwise(1.0)
    )
    raw = nodes.join(defs, "name").select("id", weight.alias("u"))
    total = raw.agg(F.sum("u").alias("t"))
    return raw.crossJoin(F.broadcast(total)).select("id", (F.col("u") / F.col("t")).alias("p"))


def teleport_prior(nodes: DataFrame, hot: DataFrame, beta: float = 0.7) -> DataFrame:
    """(id, p): share ``beta`` on the ``hot`` nodes (id), the rest on all; uniform without hot nodes."""
    n, h = nodes.count(), hot.select("id").distinct().join(nodes, "id", "left_semi").count()
    marked = nodes.select("id").join(hot.select("id").distinct().withColumn("hot", F.lit(1)), "id", "left")
    if not h:
        return marked.select("id", F.lit(1.0 / max(n, 1)).alias("p"))
    return marked.select("id", ((1 - beta) / n + F.when(F.col("hot") == 1, beta / h).otherwise(0.0)).alias("p"))


def hits(nodes: DataFrame, edges: DataFrame, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(id, authority, hub), each L2-normalised every round, from 1/sqrt(n).

    Edges are held by both their ends; a half round writes its raw sums and, with them,
    their squared norm, which the next one divides by.
    """
    n = nodes.count()
    links = stage(edges.select("src", "dst", "w"), "links")
    first = 1.0 / max(n, 1) ** 0.5
    hub = stage(nodes.select("id", F.lit(first).alias("v"), F.lit(first).alias("old")), "hits")
    auth, of_auth, of_hub = hub, F.col("v"), F.col("v")
    by_src, by_dst = hold(links, "src"), hold(links, "dst")

    def half(held: DataFrame, at: str, to: str, given: DataFrame, value: Column, before: DataFrame, old: Column) -> tuple[DataFrame, Column]:
        sums = held.join(given.select(F.col("id").alias(at), value.alias("x")).hint("merge"), at).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        raw = stage(before.select("id", old.alias("old")).join(sums.hint("merge"), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("v"), "old"), "hits", sq=F.sum(F.col("v") * F.col("v")))
        norm = (raw.measured["sq"] or 0.0) ** 0.5
        return raw, F.col("v") / norm if norm > 0 else F.lit(0.0)

    for _ in range(max_iter):
        a0, h0 = auth, hub
        auth, now_a = half(by_src, "src", "dst", hub, of_hub, auth, of_auth)
        hub, now_h = half(by_dst, "dst", "src", auth, now_a, hub, of_hub)
        of_auth, of_hub = now_a, now_h
        unstage(a0)
        unstage(h0)
        moved = auth.select(F.abs(of_auth - F.col("old")).alias("d")).unionByName(hub.select(F.abs(of_hub - F.col("old")).alias("d"))).agg(F.sum("d").alias("d")).first()["d"]
        if moved is None or moved < tol:
            break
    by_src.unpersist()
    by_dst.unpersist()
    return auth.select("id", of_auth.alias("authority")).join(hub.select("id", of_hub.alias("hub")), "id")


def fused_rank(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion, the sum of 1 / (k + place), places from 0."""
    out = None
    for r in rankings:
        place = numbered(r.select("id", "score"), [(F.col("score"), False), F.col("id")], "place")
        one = place.select("id", (1.0 / (k + F.col("place"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def blended(a: DataFrame, b: DataFrame, share: float = 0.30) -> DataFrame:
    """(id, score): (1 - share) * a / max(a) + share * b / max(b); a missing side counts 0."""
    tops = a.agg(F.max("score").alias("ma")).crossJoin(b.agg(F.max("score").alias("mb")))
    both = a.select("id", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id", "full")
    part = lambda c, m: F.when(F.col(m) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(m)).otherwise(0.0)
    return both.crossJoin(F.broadcast(tops)).select("id", ((1 - share) * part("a", "ma") + share * part("b", "mb")).alias("score"))


def ego(edges: DataFrame, centre: DataFrame, depth: int = 2, fan_out: int = 32) -> DataFrame:
    """(id, hop, direction): neighbours of the centre (id) by hop; every node passes on
    its ``fan_out`` heaviest edges (ties: smaller id).  Negative direction: callers."""
    links = stage(edges.select("src", "dst", "w"), "links")
    seen = stage(centre.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(0).alias("direction")))
    frontier = seen
    for hop in range(1, depth + 1):
        # only edges of the frontier are ranked
        sides = []
        for a, b, way in (("src", "dst", 1), ("dst", "src", -1)):
            front = frontier.filter(F.col("direction").isin(0, way)).select(F.col("id").alias(a))
            nth = F.row_number().over(Window.partitionBy(a).orderBy(F.desc("w"), b))
            sides.append(links.join(front, a).withColumn("nth", nth).filter(F.col("nth") <= fan_out).select(F.col(b).alias("id"), F.lit(way).alias("way")))
        new = sides[0].unionByName(sides[1]).groupBy("id").agg(F.max("way").alias("direction"))
        frontier = stage(new.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop"), "direction"))
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 64) -> list[int]:
    """Ids of one shortest directed path, [] if there is none.

    Each round keeps the smallest parent of every new node, so the path is the
    same every time.  Only the path itself comes to the driver.  Edges are held by
    their source; those that a caller holds are used as they are.
    """
    step = edges if getattr(edges, "held_by", None) == ("src",) else hold(edges.select("src", "dst").distinct(), "src")
    wanted = targets.select("id").distinct()
    seen = stage(sources.select("id").distinct().select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hop")))
    frontier, hop = seen, 0
    while True:
        hit = frontier.join(wanted, "id", "left_semi").orderBy("id").limit(1).collect()
        if hit:
            break
        if hop == max_hops:
            return []
        hop += 1
        new = frontier.select(F.col("id").alias("src")).join(step, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = stage(new.join(seen, "id", "left_anti").select("id", "parent", F.lit(hop).alias("hop")))
        if not frontier.measured["rows"]:
            return []
        seen = seen.unionByName(frontier)
    if step is not edges:
        step.unpersist()
    path, node = [], hit[0]
    while node is not None:
        path.append(node["id"])
        node = seen.filter(F.col("id") == node["parent"]).first() if node["parent"] is not None else None
    return path[::-1]


def cycles(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes in strongly connected components of two or more.

    Trim nodes that cannot be on a cycle, then colour: each node takes the largest
    id that reaches it; those that their colour's root reaches backwards form its
    component and leave the graph.  Repeats until nothing is left.
    """
    left = stage(edges.filter("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        while True:  # trim
            ends = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))
            kept = stage(left.join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi"))
            if kept.measured["rows"] == left.measured["rows"]:
                break
            left = kept
        if not left.measured["rows"]:
            break
        colour = stage(left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            best = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("c"))
            new = stage(colour.join(best, "id", "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("old")), moved=F.count_if(F.col("colour") != F.col("old")))
            colour = new.select("id", "colour")
            if not new.measured["moved"]:
                break
        inside = stage(
            left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("c"))
        )
        member = stage(colour.filter("id = colour").select("id", "colour"))
        frontier = member
        while True:
            new = stage(frontier.join(inside, (frontier["id"] == inside["dst"]) & (frontier["colour"] == inside["c"])).select(F.col("src").alias("id"), F.col("c").alias("colour")).distinct().join(member, ["id", "colour"], "left_anti"))
            if not new.measured["rows"]:
                break
            member = member.unionByName(new)
            frontier = new
        member = stage(member)
        found = member if found is None else found.unionByName(member)
        left = stage(left.join(member.select(F.col("id").alias("src")), "src", "left_anti").join(member.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    small = found.groupBy("colour").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(small, "colour").select("id", "component")


def closure_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_reached): nodes reachable from each, itself included.

    The pair table grows only by pairs first seen in the last round.
    """
    step = stage(edges.filter("src <> dst").select("src", "dst").distinct(), "links")
    pairs = stage(step.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    frontier = pairs
    while True:
        new = stage(frontier.join(step, frontier["b"] == step["src"]).select("a", F.col("dst").alias("b")).filter("a <> b").distinct().join(pairs, ["a", "b"], "left_anti"))
        if not new.measured["rows"]:
            break
        pairs = pairs.unionByName(new)
        frontier = new
    sizes = pairs.filter("a <> b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(sizes, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n_reached"))


def health(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n, ccd, acd, nccd, propagation; nccd is NULL where its formula is undefined."""
    t = closure_sizes(edges, nodes).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_reached"), F.lit(0)).alias("ccd"))
    n = F.col("n").cast("double")
    tree = (n + 1) * F.log2(n + 1) - n
    return t.select("n", "ccd", (F.col("ccd") / n).alias("acd"), F.when(tree > 0, F.col("ccd") / tree).alias("nccd"), (F.col("ccd") / (n * n)).alias("propagation"))


def is_test_path(path: Column) -> Column:
    """Test directories and file names by convention."""
    p = F.lower(path)
    return p.rlike(r"(^|/)(tests?|testing|spec|specs|__tests__|fixtures?)(/|$)") | p.rlike(r"(^|/)(test_[^/]*|[^/]*_test|[^/]*\.(test|spec))(\.[a-z0-9]+)?$")


def path_tier(path: Column) -> Column:
    """0 source, 1 test or benchmark, 2 documentation."""
    p = F.lower(path)
    return F.when(p.rlike(r"(^|/)docs?(/|$)|\.(md|rst|txt|adoc)$"), 2).when(is_test_path(path) | p.rlike(r"(^|/)(bench|benchmarks?)(/|$)"), 1).otherwise(0)
