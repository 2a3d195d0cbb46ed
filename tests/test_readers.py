"""Git, precise indexes and captures."""

import subprocess

import pytest
from pyspark.sql import functions as F

from delvegraph.operators import history
from delvegraph.sources import captures as C
from delvegraph.sources import git as G
from delvegraph.sources import precise as P


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=a", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (d / "a.py").write_text("def needle():\n    pass\n")
    run("add", ".")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "side")
    (d / "ü b.py").write_text("needle()\nneedle()\n")
    run("add", ".")
    run("commit", "-qm", "two")
    return str(d)


def test_git_tables(spark, repo):
    commits, files = G.log(spark, repo)
    assert commits.count() == 2 and {r.file for r in files.collect()} == {"a.py", "ü b.py"}
    assert G.log(spark, repo, "main")[0].count() == 1
    refs = G.refs(spark, repo)
    tree = G.tree(refs, repo)
    assert {(r.ref, r.path) for r in tree.collect()} == {("main", "a.py"), ("side", "a.py"), ("side", "ü b.py")}
    blobs = G.blobs(tree, repo).select("sha", F.col("content").cast("string").alias("text"))
    assert {(r.ref, r.path, r.n_lines) for r in history.where_is(refs, tree, blobs, "needle").collect()} == {("main", "a.py", 1), ("side", "a.py", 1), ("side", "ü b.py", 2)}


def test_suffix_binding_leaves_out_what_is_ambiguous(spark):
    paths = spark.createDataFrame([("root/src/a.py",), ("x/b.py",)], "path string")
    files = spark.createDataFrame([("src/a.py",), ("b.py",), ("y/x/b.py",)], "path string")
    assert [tuple(r) for r in G.suffix_bind(paths, files).collect()] == [("root/src/a.py", "src/a.py")]


def message(*parts):
    out = b""
    for n, v in parts:
        out += bytes([n << 3, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v
    return out


def test_precise_index_pins_references(spark):
    occ = lambda line, roles: message((1, bytes([line, 4, 8])), (2, b"pkg f()."), (3, roles))
    raw = message((2, message((1, b"a.py"), (2, occ(0, 1)))), (2, message((1, b"b.py"), (2, occ(6, 0)))))
    idx = P.read_index(spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:7]),)], "content binary"))
    assert {tuple(r) for r in idx.collect()} == {("a.py", 1, 4, "pkg f().", True), ("b.py", 7, 4, "pkg f().", False)}
    sym = spark.createDataFrame([(11, "a.py", 1)], "sym_id long, file string, line int")
    t = P.targets(idx, sym)
    refs = spark.createDataFrame([(1, 5, "b.py", 7), (2, 5, "b.py", 8)], "ref_id long, from_sym long, file string, line int")
    old = spark.createDataFrame([(1, 5, 3, 0.2, 1), (2, 5, 4, 0.2, 1)], "ref_id long, src long, dst long, conf double, k long")
    assert {(r.ref_id, r.dst, r.conf) for r in P.overlay(old, refs, t).collect()} == {(1, 11, 1.0), (2, 4, 0.2)}


def test_captures(spark):
    rows = ['@app.get("/users/{id}")', 'requests.post("http://h/users/7?x=1")', 'fetch(`/a/b`)', 'm.def("add", &ns::native_add);', "lib.mul.restype = c_int", "    Widget* w;", "  if (x) {"]
    lines = spark.createDataFrame([("f", i, b) for i, b in enumerate(rows)], "file string, line int, body string")
    assert [(r.method, r.template) for r in C.route_definitions(lines).collect()] == [("GET", "/users/{id}")]
    assert [(r.method, r.path) for r in C.route_uses(lines).orderBy("line").collect()] == [("POST", "/users/7"), (None, "/a/b")]
    assert {(r.kind, r.alias, r.target, r.low_conf) for r in C.foreign_aliases(lines).collect()} == {("pybind", "add", "native_add", False), ("ctypes", "mul", "mul", True)}
    assert [(r.type_name, r.field) for r in C.member_fields(lines).collect()] == [("Widget", "w")]
    assert [(r.depth, r.head) for r in C.outline(lines).collect()] == [(1, "if (x) {")]
