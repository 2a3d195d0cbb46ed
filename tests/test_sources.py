"""Crawling and extraction of authored files, resolution of what they hold."""

from delvegraph.operators import resolve as R
from delvegraph.sources import extract as X
from delvegraph.sources import rules
from delvegraph.sources.crawl import changed_since, crawl

CODE = '''import os
from pkg import util

class Base:
    pass

class Shape(Base):
    def area(self, k):
        if k > 1 and k < 5:
            for i in range(k):
                helper(i)
        return k

def helper(x):
    return x
'''


def test_crawl_extract_resolve(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_text(CODE)
    (tmp_path / "pkg" / "b.cpp").write_text('#include "a.h"\nint twice(int x, int y) {\n  return helper(x);\n}\n')
    (tmp_path / "pkg" / "bin.py").write_bytes(b"x = 1\x00")
    (tmp_path / "node_modules" / "c.js").write_text("function no() {}")
    (tmp_path / "data.json").write_text('{"k": {"inner": 1}}')
    files, skipped = crawl(spark, f"file://{tmp_path}")
    assert [r.path for r in files.orderBy("file_id").collect()] == ["data.json", "pkg/a.py", "pkg/b.cpp"]
    assert [(r.path, r.reason) for r in skipped.collect()] == [("pkg/bin.py", "binary")]
    assert changed_since(files, files).count() == 0
    rows = X.extract(files).cache()
    symbols, refs, imports = X.corpus_tables(rows)
    s = {r.name: r for r in symbols.collect()}
    assert s["area"].kind == "method" and s["area"].params == 1 and s["area"].cx == 4 and s["area"].max_nest == 2
    assert s["twice"].params == 2 and s["Shape"].kind == "cls"
    assert {r.target for r in imports.collect()} == {"os", "pkg", "a.h"}
    calls = refs.filter("role = 'call'")
    got = R.resolve(calls, symbols).collect()
    assert (s["area"].sym_id, s["helper"].sym_id, 1.0) in {(r.src, r.dst, r.conf) for r in got}
    assert sorted((r.name, r.depth) for r in X.json_keys(files).collect()) == [("inner", 2), ("k", 1)]


def test_resolution_ladder_splits_and_drops(spark):
    sym = spark.createDataFrame(
        [(1, "f", "a/x.py", "a", "python", 1, True), (2, "f", "a/y.py", "a", "python", 2, True), (3, "g", "b/z.py", "b", "python", 0, True), (4, "h", "b/z.py", "b", "python", 0, False), (5, "h", "c/z.py", "c", "python", 0, False)],
        "sym_id long, name string, file string, dir string, lang string, params int, arity_exact boolean",
    )
    ref = spark.createDataFrame(
        [(1, 9, "a/q.py", "a", "python", "f", None), (2, 9, "a/q.py", "a", "python", "f", 2), (3, 9, "a/q.py", "a", "python", "g", 0), (4, 9, "a/q.py", "a", "python", "h", 0), (5, 9, "a/q.py", "a", "cpp", "f", 1)],
        "ref_id long, from_sym long, file string, dir string, lang string, callee string, arg_count int",
    )
    got = {(r.ref_id, r.dst, r.conf, r.k) for r in R.resolve(ref, sym).collect()}
    assert got == {(1, 1, 0.5, 2), (1, 2, 0.5, 2), (2, 2, 0.5, 1), (3, 3, 0.2, 1)}


def test_rules():
    r = rules.arch_rules("layer ui = ui/, web/\ndeny ui -> /db.*/\n# note\n")
    assert r == [("deny ui -> /db.*/", "deny", "(ui/|web/)", "db.*")]
    assert rules.lint_rules("- id: a\n  query: x\n")[0] == {"id": "a", "query": "x"}


def test_lint_pack(spark):
    lines = spark.createDataFrame([("a.c", "c", 1, "strcpy(a, b);"), ("a.c", "c", 2, "  goto out;"), ("a.c", "c", 3, "int x = 1000;")], "path string, lang string, line int, body string")
    assert {(r.line, r.rule) for r in rules.lint(lines, rules.BUILTIN).collect()} == {(1, "unsafe-c-fn"), (2, "goto")}
