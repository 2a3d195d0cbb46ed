"""Hand-computed graphs."""

import random

import pytest

from delvegraph.operators import graph as G
from delvegraph.operators import kernels
from delvegraph.plans.graphquery import QueryError, graph_query, page, parse


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")


def node_frame(spark, n, **over):
    return spark.createDataFrame([(i, over.get(f"n{i}", f"s{i}"), "fn", i, f"src/f{i % 3}.py") for i in range(n)], "id long, name string, kind string, cx int, file string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


CHAIN = [(0, 1), (1, 2), (2, 3), (4, 4)]


def test_chain_depths(spark):
    n, e = node_frame(spark, 5), frame(spark, CHAIN)
    for k in (1, 2, 3):
        assert len(ids(graph_query(f'callers(name("s3"), {k})', n, e))) == k
    assert len(ids(graph_query('callees(name("s0"), 3)', n, e))) == 3
    assert ids(graph_query("fanin(all, 1)", n, e)) == [1, 2, 3]  # the self call does not count


def test_cycle_terminates_and_excludes_seeds(spark):
    n, e = node_frame(spark, 4), frame(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert ids(G.reach(e, n.filter("id = 0"))) == [1, 2, 3]
    assert {(r.id, r.component) for r in G.cycles(e).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_empty_graph(spark):
    n, e = node_frame(spark, 2), frame(spark, [(0, 0)])
    assert ids(G.reach(e.limit(0), n)) == []
    assert G.cycles(e.limit(0)).count() == 0


def test_pagerank_sums_to_one_and_ranks_the_sink_first(spark):
    n, e = node_frame(spark, 5), frame(spark, [(1, 0), (2, 0), (3, 0), (4, 0)])
    r = {x.id: x.rank for x in G.personalized_pagerank(n, e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and max(r, key=r.get) == 0


def test_reach_equals_a_search_on_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
        seen, queue = {0}, [0]
        while queue:
            x = queue.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    queue.append(b)
        assert ids(G.reach(frame(spark, pairs), node_frame(spark, 12).filter("id = 0"))) == sorted(seen - {0})


def test_shortest_path_and_connect(spark):
    e = frame(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)])
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    assert G.shortest_path(e, one(0), one(4)) == [0, 1, 2, 4]
    assert G.shortest_path(e, one(4), one(0)) == []
    assert kernels.connect(e, [0, 4]) == [(0, 1), (1, 2), (2, 4)]


def test_query_errors_and_suggestions(spark):
    n, e = node_frame(spark, 3), frame(spark, CHAIN)
    for bad in ("and(all", "foo(all)", "kind(all, zebra)", "all all"):
        with pytest.raises(QueryError):
            parse(bad)
    with pytest.raises(G.AmbiguousName, match="did you mean s"):
        graph_query('name("sx")', n, e)


def test_page_discloses_its_window(spark):
    r = page(node_frame(spark, 5), ["id"], 1, 2).collect()
    assert [x.id for x in r] == [1, 2] and r[0].total == 5 and r[0].shown == 2 and r[0].capped


def test_louvain_splits_two_cliques():
    adj = {i: {} for i in range(6)}
    for a, b in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]:
        adj[a][b] = adj[b][a] = 1.0
    c = kernels.louvain(adj)
    assert c[0] == c[1] == c[2] != c[3] == c[4] == c[5]
