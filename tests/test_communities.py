"""Graphs that no single kernel takes."""

import itertools
import random

import pytest

from delvegraph.operators import bundles, kernels


def cliques(n, size, joined=False):
    out = [(c * 100 + a, c * 100 + b) for c in range(n) for a, b in itertools.combinations(range(size), 2)]
    return out + [(c * 100, c * 100 + 101) for c in range(n - 1) if joined]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_move_as_in_one_kernel(spark):
    rng = random.Random(8)
    pairs = [(c * 50 + rng.randrange(25), c * 50 + rng.randrange(25)) for c in range(6) for _ in range(60)] + [(900, 901), (901, 900), (7, 7)]
    whole = {r.id: r.community for r in kernels.communities(frame(spark, pairs)).collect()}
    parts = {r.id: r.community for r in kernels.communities(frame(spark, pairs), bound=80).collect()}
    assert parts == whole and len(set(whole.values())) > 7


@pytest.mark.parametrize("bound", [30, 12])
def test_a_component_over_the_bound_is_contracted(spark, bound):
    pairs = cliques(6, 8, joined=True)
    got = {r.id: r.community for r in kernels.communities(frame(spark, pairs), bound=bound).collect()}
    assert set(got) == {v for p in pairs for v in p}
    assert len(set(got.values())) > 1 and all(got[a] == got[b] for a, b in cliques(6, 8))


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(3).shuffle(ids)
    pairs = list(zip(ids[:150], ids[1:150], strict=False)) + list(zip(ids[150:], ids[151:], strict=False))
    got = {r.id: r.component for r in kernels.components(frame(spark, pairs).toDF("a", "b")).collect()}
    assert got == {v: min(ids[:150]) if k < 150 else min(ids[150:]) for k, v in enumerate(ids)}


def test_zoom_over_the_bound(spark):
    e = frame(spark, cliques(12, 5, joined=True))
    whole = {(r.id, r.level): r.community for r in kernels.zoom(e, groups=4).collect()}
    got = {(r.id, r.level): r.community for r in kernels.zoom(e, groups=4, bound=40).collect()}
    assert {i for i, _ in got} == {i for i, _ in whole} and len({c for (_, k), c in got.items() if k == 1}) <= 12


def test_bundles_of_communities_over_the_bound(spark):
    sizes = spark.createDataFrame([(c * 100 + k, 2, 0) for c in range(6) for k in range(5)], "id long, size int, shared int")
    parts = kernels.communities(frame(spark, cliques(6, 5)), bound=15)
    got = {r.id: r.bin for r in bundles.partition_bins(sizes, parts, 3, core_share=0.0).collect()}
    assert len(got) == 30 and all(len({got[c * 100 + k] for k in range(5)}) == 1 for c in range(6)) and set(got.values()) == {0, 1, 2}
