"""Keys that very many rows share: pairs are made once and last, or not at all."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from delvegraph.operators import bundles as B
from delvegraph.operators import quality, resolve, serve
from delvegraph.operators import text as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def references(spark, n_refs=60, n_defs=40):
    sym = [(i, "get", f"s{i % 2}/f.py", f"s{i % 2}", "python", i % 3, True) for i in range(n_defs)] + [(900, "one", "z/z.py", "z", "python", 0, False), (901, "_far", "y/a.py", "y", "python", 0, True), (902, "_far", "y/b.py", "y", "python", 3, True)]
    symbols = spark.createDataFrame(sym, "sym_id int, name string, file string, dir string, lang string, params int, arity_exact boolean")
    ref = [(k, 500 + k % 7, "s0/f.py", "s0", "python", "get", 2) for k in range(n_refs)] + [(100, 5, "q/q.py", "q", "python", "get", 0), (101, 5, "q/q.py", "q", "python", "one", 9), (102, 5, None, None, "python", "one", None), (103, 5, "x/a.py", "x", "python", "_far", 2), (104, 5, "x/a.py", "x", "python", None, 2)]
    return spark.createDataFrame(ref, "ref_id int, from_sym int, file string, dir string, lang string, callee string, arg_count int"), symbols


def test_references_of_the_same_words_resolve_once(spark):
    refs, symbols = references(spark)
    got = {(r.ref_id, r.dst, r.conf, r.k) for r in resolve.resolve(refs, symbols).collect()}
    near = [i for i in range(0, 40, 2) if i % 3 >= 2]
    assert got == {(k, d, 1.0, len(near)) for k in range(60) for d in near} | {(101, 900, 0.2, 1), (103, 902, 0.2, 1)}
    found, classes = resolve.targets(refs, symbols)
    assert found.count() == 60 + 2  # no pairs yet
    assert classes.count() == 6 + 3


def test_gauges_make_no_pairs(spark):
    refs, symbols = references(spark)
    found = resolve.targets(refs, symbols)[0]
    got = {r.from_sym: (r.amb, r.unresolved) for r in resolve.gauges(refs, found).collect()}
    assert got == {500 + k: (sum(i % 7 == k for i in range(60)), 0) for k in range(7)} | {5: (0, 3)}
    assert "Generate" not in plan(resolve.gauges(refs, found))


def test_weights_are_summed_by_class(spark):
    refs, symbols = references(spark)
    got = sorted((r.src, r.dst, r.n_ref, round(r.w, 9), r.amb) for r in resolve.weighted_resolution(refs, symbols).collect())
    want = sorted((r.src, r.dst, r.n_ref, round(r.w, 9), r.amb) for r in resolve.weighted_edges(resolve.resolve(refs, symbols), symbols).collect())
    assert got == want and len(want) == 7 * 7 + 2


def test_precise_targets_replace_classes(spark):
    from delvegraph.sources import precise

    refs, symbols = references(spark)
    placed = refs.withColumn("line", F.col("ref_id"))
    pins = spark.createDataFrame([("s0/f.py", k, 77) for k in range(59)], "file string, line int, to_sym int")
    found, classes = resolve.targets(refs, symbols)
    got = {(r.ref_id, r.dst, r.conf) for r in precise.overlay(found, placed, pins, classes).collect()}
    assert got == {(k, 77, 1.0) for k in range(59)} | {(59, d, 1.0) for d in (2, 8, 14, 20, 26, 32, 38)} | {(101, 900, 0.2), (103, 902, 0.2)}


def test_foreign_edges_take_classes(spark):
    refs, symbols = references(spark)
    aliases = spark.createDataFrame([("get", "one", False), ("_far", "one", True)], "alias string, target string, low_conf boolean")
    got = [tuple(r) for r in B.foreign_edges(refs, resolve.targets(refs, symbols)[0], aliases, symbols).collect()]
    assert got == [(100, 5, 900, 0.2)]


def test_scopes_by_their_ends(spark):
    scopes = ["a::b::C", "C", "b::C", "x:::C", "BC", "", None]
    symbols = spark.createDataFrame([(i, "f", s, "a.cpp", "", "cpp", 0, False) for i, s in enumerate(scopes)], "sym_id int, name string, scope string, file string, dir string, lang string, params int, arity_exact boolean")
    hints = ["C", "b::C", ":C", "BC", "", "::C"]
    refs = spark.createDataFrame([(i, 9, "b.cpp", "x", "cpp", "f", 0, h, None, None) for i, h in enumerate(hints)], "ref_id int, from_sym int, file string, dir string, lang string, callee string, arg_count int, qualifier string, self_scope string, recv_type string")
    cones = spark.createDataFrame([], "type string, member string")
    got = {(r.ref_id, r.dst) for r in resolve.resolve_scoped(refs, symbols, cones).collect()}
    assert got == {(i, j) for i, h in enumerate(hints) for j, s in enumerate(scopes) if s is not None and (s == h or s.endswith("::" + h))}
    words = resolve._worded(refs.unionByName(refs.withColumn("ref_id", F.col("ref_id") + 50)), "qualifier", "self_scope", "recv_type").select("words").distinct()
    assert words.count() == len(hints)


def test_pairs_of_a_common_name_are_not_dealt_out(spark):
    sym = spark.createDataFrame([(i, "Base", "cls", "py") for i in range(300)] + [(7, "Other", "cls", "py"), (8, "Fn", "fn", "py")], "sym_id long, name string, kind string, lang string")
    refs = spark.createDataFrame([(s, n, "extends", "py") for s in (5, 7, 1000) for n in ("Base", "Base", "Other", "Fn", None)], "from_sym long, callee string, role string, lang string")
    df = B.inheritance(refs, sym)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == {(b, d) for b in range(300) for d in (5, 7, 1000) if b != d}
    assert plan(df).index("Generate") < plan(df).index("Exchange")


def test_member_types_of_a_common_name(spark):
    sym = spark.createDataFrame([(i, "T", "struct", "py") for i in range(200)], "sym_id long, name string, kind string, lang string")
    df = B.members(spark.createDataFrame([(3, "T"), (3, "T"), (900, "T"), (4, None)], "owner long, type_name string"), sym)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == {(o, m) for o in (3, 900) for m in range(200) if o != m}
    assert plan(df).index("Generate") < plan(df).index("Exchange")


def test_mentions_of_a_common_name(spark):
    docs = spark.createDataFrame([(1, "see `a.go` and `b.go()`"), (2, "`stop`"), (3, None)], "id long, text string")
    df = D.code_mentions(docs, spark.createDataFrame([(i, "go") for i in range(150)] + [(3, "stop")], "sym_id long, name string"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, i) for i in range(150)} | {(2, 3)}
    assert plan(df).index("Generate") < plan(df).index("Exchange")


def test_points_meet_no_span_that_does_not_hold_them(spark):
    rng = random.Random(4)
    spans = [(i, rng.choice("fg"), a := rng.randrange(-40, 300), a + rng.choice([0, 1, 2, 3, 4, 7, 8, 15, 16, 64, 255])) for i in range(300)] + [(900, "f", 0, 1 << 40), (901, None, 0, 9), (902, "g", None, 9)]
    points = [(i, rng.choice("fg"), rng.randrange(-60, 600)) for i in range(500)] + [(600, "f", 1 << 39), (601, None, 3), (602, "g", None)]
    df = resolve.enclosing(spark.createDataFrame(points, "point_id long, file string, at long"), spark.createDataFrame(spans, "sym_id long, file string, start long, stop long"))
    want = {}
    for p, f, at in points:
        hit = [(a, s) for s, g, a, b in spans if None not in (f, g, a, at) and f == g and a <= at < b]
        want[p] = max(hit)[1] if hit else None
    assert {r.point_id: r.sym_id for r in df.collect()} == want
    assert not re.search(r"at#\d+L? >= start", plan(df))


def test_frames_bind_by_equal_joins(spark):
    frames = spark.createDataFrame([(1, 1, "/x/a.py", 5, "f"), (1, 2, "a.py", 7, None), (1, 3, "b.py", 7, "f"), (1, 4, "a.py", 99, "g")], "id long, nth long, path string, line int, func string")
    symbols = spark.createDataFrame([(1, "f", "src/a.py", 4, 7), (2, "g", "src/a.py", 6, 6), (3, "f", "a.py", 20, 30), (4, "h", "a.py", 7, 7)], "sym_id long, name string, file string, first int, last int")
    df = D.bind_frames(frames, symbols)
    assert {r.nth: (r.sym_id, r.how) for r in df.collect()} == {1: (1, "name"), 2: (4, "line"), 3: (None, None), 4: (2, "name")}
    assert " >= " not in plan(df)


def test_equal_notes_have_an_order(spark):
    rng = random.Random(1)
    day = lambda k: datetime.date(2020, 1, 1 + k)
    notes = [("a", day(rng.randrange(5)), rng.choice("xyz")) for _ in range(2000)]
    rows = B.with_notes(spark.createDataFrame([("a",), ("b",)], "canon string"), spark.createDataFrame(notes, "target string, date date, text string")).collect()
    got = {r.canon: r.notes and [(x.date, x.text) for x in r.notes] for r in rows}
    assert got == {"a": sorted(((d, t) for _, d, t in notes), key=lambda x: (-x[0].toordinal(), x[1])), "b": None}


def test_each_held_entry_stays(spark):
    found = spark.createDataFrame([(1, "ccx", 9), (2, "loc", 5)], "canon long, kind string, now int")
    held = spark.createDataFrame([(1, "ccx", 12), (1, "ccx", 7), (3, "loc", 8)], "canon long, kind string, now int")
    assert sorted(tuple(r) for r in serve.updated_baseline(found, held).collect()) == [(1, "ccx", 7), (1, "ccx", 9)]
    assert sorted(tuple(r) for r in serve.updated_baseline(found, held, accept_new=True).collect()) == [(1, "ccx", 9), (2, "loc", 5)]


@pytest.mark.parametrize("batch", [2, 10000])
def test_classes_by_the_run_of_their_rows(spark, batch):
    rng = random.Random(2)
    m = [(f"c{c}", f"m{k}") for c in range(40) for k in range(rng.randrange(1, 6))]
    u = [(c, k, f"f{rng.randrange(4)}") for c, k in m if rng.random() < 0.7] + [("none", "m", "f")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = quality.lcom4(spark.createDataFrame(m, "cls string, method string"), spark.createDataFrame(u, "cls string, method string, field string"), spark.createDataFrame([("c1", "m0", "m0")], "cls string, a string, b string"))
        got = {r.cls: r.lcom4 for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {"none": None}
    for c in {c for c, _ in m}:
        part = {k: {k} for d, k in m if d == c}
        for f in {f for d, _, f in u if d == c}:
            joined = set().union(*(part[k] for d, k, g in u if d == c and g == f))
            for k in joined:
                part[k] = joined
        want[c] = len({frozenset(x) for x in part.values()})
    assert got == want and "FlatMapGroupsInPandas" not in plan(df)
