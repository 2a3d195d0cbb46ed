"""Loops read their edges once, however many rounds they take."""

import pytest

from delvegraph.operators import graph as G
from delvegraph.operators import bundles, kernels, quality

PAIRS = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (2, 5), (5, 6)]


@pytest.fixture
def counted(spark):
    """(edges, how many edge rows were computed so far)."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x[0], x[1], 1.0

    return spark.sparkContext.parallelize(PAIRS, 2).map(count).toDF("src long, dst long, w double"), lambda: seen.value


def test_reach(spark, counted):
    edges, n = counted
    assert {(r.id, r.hop) for r in G.reach(edges, spark.createDataFrame([(0,)], "id long")).collect()} == {(1, 1), (2, 2), (3, 3), (5, 3), (4, 4), (6, 4)}
    assert n() == len(PAIRS)


def test_class_cone(spark, counted):
    edges, n = counted
    inherits = edges.filter("dst > src").select(edges["src"].alias("derived"), edges["dst"].alias("base"))
    assert {r.id for r in bundles.class_cone(inherits, spark.createDataFrame([(2,)], "id long")).collect()} == set(range(7))
    assert n() == len(PAIRS)


def test_ego(spark, counted):
    edges, n = counted
    got = {(r.id, r.hop, r.direction) for r in G.ego(edges, spark.createDataFrame([(2,)], "id long"), depth=2, fan_out=8).collect()}
    assert got == {(3, 1, 1), (5, 1, 1), (1, 1, -1), (4, 2, 1), (6, 2, 1), (0, 2, -1)}
    assert n() == len(PAIRS)


def test_ego_passes_on_the_heaviest_edges(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (0, 3, 2.0), (2, 4, 1.0), (2, 5, 1.0), (2, 6, 1.0), (1, 7, 9.0), (8, 0, 1.0)], "src long, dst long, w double")
    got = {(r.id, r.hop, r.direction) for r in G.ego(e, spark.createDataFrame([(0,)], "id long"), depth=2, fan_out=2).collect()}
    assert got == {(2, 1, 1), (3, 1, 1), (8, 1, -1), (4, 2, 1), (5, 2, 1)}


def test_connect(spark, counted):
    edges, n = counted
    assert kernels.connect(edges, [0, 3, 6]) == [(0, 4), (2, 3), (2, 5), (3, 4), (5, 6)]
    assert n() == len(PAIRS)


@pytest.mark.parametrize("tol", [1e-6, 0])
def test_pagerank(spark, counted, tol):
    edges, n = counted
    nodes = spark.range(7)
    got = {r.id: r.rank for r in G.personalized_pagerank(nodes, edges, tol=tol, max_iter=30).collect()}
    assert n() == len(PAIRS)
    rank = dict.fromkeys(range(7), 1 / 7)
    out = {v: sum(a == v for a, _ in PAIRS) for v in range(7)}
    for _ in range(30):
        lost = sum(rank[v] for v in rank if not out[v])
        new = {v: 0.85 * sum(rank[a] / out[a] for a, b in PAIRS if b == v) + (0.85 * lost + 0.15) / 7 for v in rank}
        change, rank = sum(abs(new[v] - rank[v]) for v in rank), new
        if change < tol:
            break
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in rank)


def test_hits_write_each_half_round_once(spark, counted, monkeypatch):
    edges, n = counted
    written = []
    stage = G.stage
    monkeypatch.setattr(G, "stage", lambda df, tag="round", **m: written.append(tag) or stage(df, tag, **m))
    got = {r.id: (r.authority, r.hub) for r in G.hits(spark.range(7), edges, tol=0, max_iter=3).collect()}
    assert n() == len(PAIRS) and written.count("hits") == 1 + 2 * 3
    a = h = dict.fromkeys(range(7), 7**-0.5)
    unit = lambda v: {k: x / sum(y * y for y in v.values()) ** 0.5 for k, x in v.items()}
    for _ in range(3):
        a = unit({v: sum(h[s] for s, d in PAIRS if d == v) for v in range(7)})
        h = unit({v: sum(a[d] for s, d in PAIRS if s == v) for v in range(7)})
    assert all(abs(got[v][0] - a[v]) < 1e-12 and abs(got[v][1] - h[v]) < 1e-12 for v in range(7))


def test_bits_of_many_cells(spark, counted):
    edges, n = counted
    rows = [(v, f"c{v * 20 + k}", k % 2, None if k == 3 else 0) for v in (4, 6) for k in range(70)] + [(5, None, 1, 1)]
    access = spark.createDataFrame(rows, "id long, cell string, reads int, writes int")
    reach = {0: {1, 2, 3, 4, 5, 6}, 5: {6}, 6: set()}
    for v in (1, 2, 3, 4):
        reach[v] = {0, 1, 2, 3, 4, 5, 6}
    want = {}
    for v in range(7):
        for i, cell, r, w in rows:
            if i == v or i in reach[v]:
                old = want.get((v, cell), (r, w))
                want[v, cell] = (max(old[0], r), w if old[1] is None else max(old[1], w or 0))
    got = {(x.id, x.cell): (x.reads, x.writes) for x in quality.propagate_bits(edges, access).collect()}
    assert got == want and n() == len(PAIRS)
