"""Definitions, references, imports and metrics from source text.

Python is parsed exactly with the standard library.  C-like and other languages
use a line-and-brace reading, marked ``approx``: definitions, calls and imports
only, as no parser for them is at hand.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = (
    "row string, path string, lang string, extractor string, name string, scope string, kind string, line int, start int, stop int, "
    "cx int, ccx int, loc int, max_nest int, params int, arity_exact boolean, locals int, callee string, recv string, arg_count int, role string, target string, type_name string"
)
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension)


def _row(**x) -> dict:
    return {c: x.get(c) for c in _COLUMNS}


def _metrics(fn: ast.AST) -> dict:
    """Cyclomatic and cognitive complexity, nesting, locals of one function."""
    out = {"cx": 1, "ccx": 0, "max_nest": 0}
    names: set[str] = set()

    def walk(node: ast.AST, nest: int) -> None:
        for child in ast.iter_child_nodes(node):
            deeper = nest
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
                deeper = nest + 1
            if isinstance(child, _BRANCH):
                out["cx"] += 1
            if isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)):
                out["ccx"] += 1 + nest
                deeper = nest + 1
                out["max_nest"] = max(out["max_nest"], deeper)
            if isinstance(child, ast.BoolOp):
                out["cx"] += len(child.values) - 1
                out["ccx"] += 1
            if isinstance(child, ast.match_case):
                out["cx"] += 1
            if isinstance(child, ast.Name) and isinstance(child.ctx, ast.Store):
                names.add(child.id)
            walk(child, deeper)

    walk(fn, 0)
    return out | {"locals": len(names)}


def python_rows(path: str, text: str) -> list[dict]:
    """Rows of one Python file; a file that does not parse gives an ``error`` row."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [_row(row="error", path=path, lang="python", extractor="exact", name=type(e).__name__)]
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    at = [0]
    for b in lines:
        at.append(at[-1] + len(b) + 1)
    span = lambda n: (at[n.lineno - 1] + n.col_offset, at[n.end_lineno - 1] + n.end_col_offset)
    rows: list[dict] = []
    base = {"path": path, "lang": "python", "extractor": "exact"}

    def name_of(f: ast.AST) -> tuple[str | None, str | None]:
        if isinstance(f, ast.Name):
            return f.id, None
        if isinstance(f, ast.Attribute):
            return f.attr, f.value.id if isinstance(f.value, ast.Name) else ""
        return None, None

    def walk(node: ast.AST, scope: list[str], owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, own = scope, owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start, stop = span(child)
                common = base | {"name": child.name, "scope": ".".join(scope), "line": child.lineno, "start": start, "stop": stop, "loc": child.end_lineno - child.lineno + 1}
                if isinstance(child, ast.ClassDef):
                    rows.append(_row(row="symbol", kind="cls", **common))
                    for b in child.bases:
                        n, _ = name_of(b)
                        if n:
                            rows.append(_row(row="ref", role="extends", callee=n, line=b.lineno, start=span(b)[0], **base))
                else:
                    a = child.args
                    params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs)
                    method = bool(scope) and isinstance(node, ast.ClassDef)
                    exact = not (a.vararg or a.kwarg or a.defaults or a.kw_defaults)
                    rows.append(_row(row="symbol", kind="method" if method else "fn", params=params - (1 if method and (a.args or a.posonlyargs) else 0), arity_exact=exact, **common, **_metrics(child)))
                inner, own = [*scope, child.name], child.name
            elif isinstance(child, ast.Call):
                n, recv = name_of(child.func)
                if n:
                    known = not any(isinstance(x, ast.Starred) for x in child.args) and not any(k.arg is None for k in child.keywords)
                    rows.append(_row(row="ref", role="call", callee=n, recv=recv, arg_count=len(child.args) + len(child.keywords) if known else None, line=child.lineno, start=span(child)[0], **base))
            elif isinstance(child, ast.Import):
                rows.extend(_row(row="import", target=x.name, line=child.lineno, **base) for x in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append(_row(row="import", target="." * child.level + (child.module or ""), line=child.lineno, **base))
            elif isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and len(child.targets) == 1 and isinstance(child.targets[0], ast.Name):
                n, _ = name_of(child.value.func)
                if n and n[:1].isupper():
                    rows.append(_row(row="binding", name=child.targets[0].id, type_name=n, line=child.lineno, start=span(child)[0], **base))
            elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name) and isinstance(child.annotation, ast.Name):
                rows.append(_row(row="binding", name=child.target.id, type_name=child.annotation.id, line=child.lineno, start=span(child)[0], **base))
            elif isinstance(child, ast.Name):
                rows.append(_row(row="ref", role="write" if isinstance(child.ctx, ast.Store) else "read", callee=child.id, line=child.lineno, start=span(child)[0], **base))
            walk(child, inner, own)

    walk(tree, [], None)
    return rows


_DEFS = {
    "go": [("fn", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("iface", r"^type\s+(\w+)\s+interface\b")],
    "rust": [("fn", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)[^(]*\(([^)]*)\)"), ("struct", r"^\s*(?:pub\s+)?(?:struct|enum)\s+(\w+)"), ("iface", r"^\s*(?:pub\s+)?trait\s+(\w+)")],
    "bash": [("fn", r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)()")],
    "ruby": [("fn", r"^\s*def\s+(?:self\.)?([\w?!]+)\s*\(?([^)]*)\)?"), ("cls", r"^\s*(?:class|module)\s+(\w+)")],
    "": [
        ("cls", r"^\s*(?:export\s+|public\s+|private\s+|abstract\s+|final\s+|default\s+|open\s+)*class\s+(\w+)"),
        ("iface", r"^\s*(?:export\s+|public\s+)*(?:interface|protocol)\s+(\w+)"),
        ("struct", r"^\s*(?:typedef\s+|export\s+|public\s+)*(?:struct|enum)\s+(?:class\s+)?(\w+)"),
        ("fn", r"^\s*(?:export\s+|async\s+|public\s+|private\s+|static\s+)*(?:function|func)\s+(\w+)\s*\(([^)]*)\)"),
        ("fn", r"^(?!\s*(?:return|else|if|for|while|switch|throw|new|delete)\b)\s*(?:[\w:<>,*&\[\]~]+\s+)+[*&]*((?:\w+::)*~?\w+)\s*\(([^;{}]*)\)\s*(?:const|noexcept|override|final|\s)*\{"),
    ],
}
_IMPORT = re.compile(r"""^\s*(?:#\s*(?:include|import)\s*([<"][^>"]+)|import\s+(?:.*?from\s+)?["']?([\w./@-]+)|using\s+([\w.:]+)|use\s+([\w:]+)|require(?:_relative)?\s*\(?["']([^"']+))""", re.M)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_WORDS = frozenset("if for while switch return sizeof catch function func def fn new else elif match and or not in do".split())


def approx_rows(path: str, lang: str, text: str) -> list[dict]:
    """Definitions, calls and imports by lines and braces."""
    base = {"path": path, "lang": lang, "extractor": "approx"}
    rows, at, defs = [], 0, set()
    lines = text.split("\n")
    # of every line: how it changes the depth, whether it may end a definition, its bytes with the line feed
    shape = [(x.count("{") - x.count("}"), "}" in x or ";" in x or lang in ("ruby", "bash"), len(x.encode()) + 1) for x in lines]
    for no, line in enumerate(lines, 1):
        for kind, rx in _DEFS.get(lang, _DEFS[""]):
            m = re.match(rx, line)
            if m:
                start = at + len(line[: m.start(1)].encode())
                depth = loc = 0
                stop = at + shape[no - 1][2] - 1
                for k in range(no - 1, len(lines)):
                    turn, ends, n = shape[k]
                    depth += turn
                    loc += 1
                    if depth <= 0 and (ends or depth < 0):
                        break
                    stop += n
                full = m.group(1).split("::")
                args = m.group(2) if m.lastindex and m.lastindex > 1 else ""
                defs.add((no, full[-1]))
                rows.append(_row(row="symbol", kind="method" if len(full) > 1 and kind == "fn" else kind, name=full[-1], scope="::".join(full[:-1]), line=no, start=start, stop=stop, loc=loc, cx=1, ccx=0, max_nest=0, params=len([x for x in args.split(",") if x.strip()]), arity_exact=False, locals=0, **base))
                break
        for m in _CALL.finditer(line):
            if m.group(1) not in _WORDS and (no, m.group(1)) not in defs:
                rows.append(_row(row="ref", role="call", callee=m.group(1), line=no, start=at + len(line[: m.start()].encode()), **base))
        m = _IMPORT.match(line)
        if m:
            rows.append(_row(row="import", target=next(g for g in m.groups() if g).lstrip('<"'), line=no, **base))
        at += shape[no - 1][2]
    return rows


def extract(files: DataFrame) -> DataFrame:
    """One tagged table of rows (symbol, ref, import, binding, error) of ``files(path, lang, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict] = []
            for path, lang, content in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                rows += python_rows(path, text) if lang == "python" else approx_rows(path, lang, text)
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("line", "start", "stop", "cx", "ccx", "loc", "max_nest", "params", "locals", "arg_count"):
                out[c] = out[c].astype("Int32")
            out["arity_exact"] = out["arity_exact"].astype("boolean")
            yield out

    code = files.filter(~F.col("lang").isin("json", "markdown", "notebook", "html", "csv")).select("path", "lang", "content")
    return code.mapInPandas(run, ROW)


def corpus_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, refs, imports).  Symbols are numbered in (path, line, name) order and
    deduplicated by span; a reference belongs to the innermost symbol around it."""
    from pyspark.sql import Window

    from delvegraph.operators.resolve import enclosing

    s = rows.filter("row = 'symbol'").dropDuplicates(["path", "start", "stop", "name"])
    dir_ = F.regexp_replace("path", "/?[^/]*$", "")
    ids = F.row_number().over(Window.orderBy("path", "line", "start", "name"))
    symbols = s.select((ids - 1).cast("long").alias("sym_id"), "name", "scope", "kind", "lang", F.col("path").alias("file"), dir_.alias("dir"), "line", "start", "stop", "cx", "ccx", "loc", "max_nest", "params", "arity_exact", "locals")
    r = rows.filter("row = 'ref'").withColumn("ref_id", F.row_number().over(Window.orderBy("path", "start", "callee", "role")).cast("long"))
    points = r.select(F.col("ref_id").alias("point_id"), F.col("path").alias("file"), F.col("start").alias("at"))
    owner = enclosing(points, symbols.filter("kind in ('fn', 'method')").select("sym_id", "file", "start", "stop")).select(F.col("point_id").alias("ref_id"), F.col("sym_id").alias("from_sym"))
    refs = r.join(owner, "ref_id", "left").select("ref_id", "from_sym", F.col("path").alias("file"), dir_.alias("dir"), "lang", "callee", "recv", "arg_count", "role", "line")
    imports = rows.filter("row = 'import'").select(F.col("path").alias("file"), "lang", "target", "line")
    return symbols, refs, imports


def json_keys(files: DataFrame) -> DataFrame:
    """(path, name, depth): keys of the first two levels of json files; they have no edges."""
    text = files.filter("lang = 'json'").select("path", F.from_json(F.col("content").cast("string"), "map<string,string>").alias("m"))
    top = text.select("path", F.explode("m").alias("name", "value"))
    second = top.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("name", "value")).select("path", "name", F.lit(2).alias("depth"))
    return top.select("path", "name", F.lit(1).alias("depth")).unionByName(second)
