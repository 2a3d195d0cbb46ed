"""Joins and bundles on authored rows."""

from pyspark.sql import functions as F

from delvegraph.operators import bundles as B
from delvegraph.operators import resolve as R


def test_inheritance_and_cone(spark):
    sym = spark.createDataFrame([(1, "Base", "cls", "py"), (2, "Mid", "cls", "py"), (3, "Leaf", "cls", "py"), (4, "Side", "cls", "py")], "sym_id long, name string, kind string, lang string")
    refs = spark.createDataFrame([(2, "Base", "extends", "py"), (3, "Mid", "extends", "py"), (4, "Base", "extends", "py"), (4, "None", "extends", "py")], "from_sym long, callee string, role string, lang string")
    inh = B.inheritance(refs, sym)
    assert {tuple(r) for r in inh.collect()} == {(1, 2), (2, 3), (1, 4)}
    assert {r.id for r in B.class_cone(inh, spark.createDataFrame([(2,)], "id long")).collect()} == {1, 2, 3}


def test_foreign_edges_only_for_unresolved(spark):
    sym = spark.createDataFrame([(7, "native_add")], "sym_id long, name string")
    refs = spark.createDataFrame([(1, 5, "add"), (2, 5, "add")], "ref_id long, from_sym long, callee string")
    done = spark.createDataFrame([(1,)], "ref_id long")
    al = spark.createDataFrame([("add", "native_add", True)], "alias string, target string, low_conf boolean")
    assert [tuple(r) for r in B.foreign_edges(refs, done, al, sym).collect()] == [(2, 5, 7, 0.1)]
    assert spark.range(1).select(B.jni_alias(F.lit("Java_com_acme_Util_do_1it"))).first()[0] == "do_it"


def test_selectors_signatures_and_compress(spark):
    code = "int f(int a,\n      int b) {\n  // note\n  return a;\n}\n"
    files = spark.createDataFrame([("src/a.c", code)], "path string, content string")
    sym = spark.createDataFrame([(1, "f", "src/a.c", 1, 0, len(code))], "sym_id long, name string, file string, line int, start int, stop int")
    assert B.select_bodies(sym, files, "a.c:1:f").first().body == code
    assert B.select_bodies(sym, files, "f:4-4").first().body == "  return a;"
    assert B.signatures(sym, files).first().signature == "int f(int a, int b)"
    assert "note" not in files.select(B.compress(F.col("content"))).first()[0]


def test_rename_pairs_and_numstat(spark):
    old = spark.createDataFrame([(1, 1, "x = load(cfg)"), (1, 2, "y = 1")], "hunk int, nth int, body string")
    new = spark.createDataFrame([(1, 1, "x = load(conf)"), (1, 2, "z + 1")], "hunk int, nth int, body string")
    assert [tuple(r) for r in B.rename_pairs(old, new).collect()] == [("cfg", "conf", 1)]
    ns = spark.createDataFrame([("1\t2\ta.py",), ("0\t0\tmode.sh",), ("3\t0\tsrc/{old => new}/b.py",), ("-\t-\tbin.png",)], "value string")
    assert {r.path for r in B.git_changed(ns).collect()} == {"a.py", "src/new/b.py", "bin.png"}


def test_cochange_boost_stays_below_the_seed(spark):
    scores = spark.createDataFrame([(1, 10.0), (2, 4.0)], "id long, score double")
    files = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, file string")
    pairs = spark.createDataFrame([("a", "b", 1.0, 0.5)], "a string, b string, conf_a double, conf_b double")
    got = {r.id: r.score for r in B.cochange_boost(scores, files, pairs).collect()}
    assert got[1] == 10.0 and 0 < got[3] < 4.0


def test_routes_need_one_handler(spark):
    defs = spark.createDataFrame([(1, "GET", "/users/{id}"), (2, "POST", "/users/{id}"), (3, None, "/a/:x"), (4, None, "/a/:y")], "def_id int, method string, template string")
    uses = spark.createDataFrame([(1, "GET", "/users/7"), (2, None, "/users/7"), (3, "GET", "/a/1"), (4, "GET", "/users/7/x")], "use_id int, method string, path string")
    assert [tuple(r) for r in R.route_edges(defs, uses).collect()] == [(1, 1)]


def test_includes_prefer_the_nearest(spark):
    inc = spark.createDataFrame([(1, "a/x.c", "util.h"), (2, "b/y.c", "util.h"), (3, "b/y.c", "none.h")], "include_id int, src_file string, target string")
    files = spark.createDataFrame([("a/util.h",), ("b/util.h",), ("c/deep/util.h",)], "path string")
    assert {(r.src_file, r.dst_file) for r in R.include_edges(inc, files).collect()} == {("a/x.c", "a/util.h"), ("b/y.c", "b/util.h")}


def test_abi_and_notes_and_heat(spark):
    now = spark.createDataFrame([("s", 8, 4, [0, 4]), ("n", 4, 4, [0])], "agg string, size long, align long, offsets array<long>")
    head = spark.createDataFrame([("s", 8, 4, [0, 2]), ("g", 1, 1, [0])], "agg string, size long, align long, offsets array<long>")
    assert {(r.agg, r.verdict) for r in B.abi_drift(now, head).collect()} == {("s", "fields-moved"), ("n", "added"), ("g", "removed")}
    notes = spark.sql("select 'k' target, date'2024-01-01' date, 'old' text union all select 'k', date'2024-02-01', 'new'")
    assert [n.text for n in B.with_notes(spark.createDataFrame([("k",)], "canon string"), notes).first().notes] == ["new", "old"]
    prof = spark.createDataFrame([("f", 2, 1.5), ("f", 1, 0.5)], "scope string, calls long, total_ms double")
    got = {r.name: (r.calls, r.total_ms) for r in B.heat(spark.createDataFrame([("f",), ("g",)], "name string"), prof).collect()}
    assert got == {"f": (3, 2.0), "g": (None, None)}
