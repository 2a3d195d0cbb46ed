"""The composable node-set language: parser, syntax tree and compiler.

    and(callers(name("f"), 2), kind(all, fn))

Text becomes a tree of frozen nodes; ``compile_query`` turns the tree into
DataFrame plans over ``nodes(id, name, kind, cx, file)`` and ``edges(src, dst)``.
Sets are single-column tables of ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvegraph.functions.text import nearest_names
from delvegraph.operators.graph import AmbiguousName, reach

KINDS = ("fn", "method", "cls", "struct", "iface", "var", "sec", "other")
#: Functions of the language: the kinds of their arguments (s: set, n: number, k: kind word, r: quoted text).
SIGNATURES = {"name": "r", "kind": "sk", "cx": "sn", "fanin": "sn", "file": "sr", "callers": "sn", "callees": "sn", "and": "ss", "or": "ss", "not": "ss"}
_TOKEN = re.compile(r'\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<num>\d+)|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<mark>[(),]))')


class QueryError(ValueError):
    """The text is not a query; the message says where."""


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


def parse(text: str) -> All | Call:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character at {at}")
        tokens.append((m.lastgroup, m.group(m.lastgroup), m.start()))
        at = m.end()
    tree, rest = _expression(tokens, 0)
    if rest != len(tokens):
        raise QueryError(f"unexpected text at {tokens[rest][2]}")
    return tree


def _take(tokens: list, i: int, kind: str, value: str | None = None) -> str:
    if i >= len(tokens):
        raise QueryError("the query ends too early")
    k, v, at = tokens[i]
    if k != kind or (value is not None and v != value):
        raise QueryError(f"expected {value or kind} at {at}")
    return v


def _expression(tokens: list, i: int) -> tuple[All | Call, int]:
    op = _take(tokens, i, "word")
    if op == "all":
        return All(), i + 1
    if op not in SIGNATURES:
        raise QueryError(f"no function {op}")
    _take(tokens, i + 1, "mark", "(")
    i, args = i + 2, []
    for n, kind in enumerate(SIGNATURES[op]):
        if n:
            _take(tokens, i, "mark", ",")
            i += 1
        if kind == "s":
            value, i = _expression(tokens, i)
        else:
            value = _take(tokens, i, {"n": "num", "k": "word", "r": "text"}[kind])
            i += 1
            if kind == "n":
                value = int(value)
            elif kind == "k" and value not in KINDS:
                raise QueryError(f"no kind {value}")
            elif kind == "r":
                value = re.sub(r"\\(.)", r"\1", value) if op == "name" else value.replace('\\"', '"')
        args.append(value)
    _take(tokens, i, "mark", ")")
    return Call(op, tuple(args)), i + 1


def compile_query(tree: All | Call, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The set's plan; closures run their loops here, everything else stays lazy."""
    if isinstance(tree, All):
        return nodes.select("id")
    op, args = tree.op, tree.args
    if op == "name":
        found = nodes.filter(F.col("name") == args[0]).select("id")
        if found.isEmpty():
            near = nearest_names(nodes.select("name"), args[0])
            raise AmbiguousName(f"no symbol {args[0]}" + (f"; did you mean {near[0]}?" if near else ""))
        return found
    if op in ("and", "or", "not"):
        a, b = (compile_query(x, nodes, edges) for x in args)
        return a.intersect(b) if op == "and" else a.union(b).distinct() if op == "or" else a.subtract(b)
    inner = compile_query(args[0], nodes, edges)
    if op in ("callers", "callees"):
        return reach(edges, inner, forward=op == "callees", hops=args[1]).select("id").join(nodes.select("id"), "id", "left_semi")
    if op == "fanin":
        wide = edges.filter("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).count().filter(F.col("count") >= args[1])
        return inner if args[1] <= 0 else inner.join(wide, "id", "left_semi")
    test = {"kind": lambda v: F.col("kind") == v, "cx": lambda v: F.col("cx") >= v, "file": lambda v: F.col("file").rlike(v)}[op](args[1])
    return inner.join(nodes.filter(test).select("id"), "id", "left_semi")


def graph_query(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``nodes`` in the set that ``text`` describes."""
    return nodes.join(compile_query(parse(text), nodes, edges).distinct(), "id", "left_semi")


def page(df: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A window of a totally ordered result with ``total``, ``shown`` and ``capped``."""
    total = df.count()
    stop = total if limit is None else min(total, offset + limit)
    shown = max(0, stop - offset)
    out = df.orderBy(*order).offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.withColumns({"total": F.lit(total), "shown": F.lit(shown), "capped": F.lit(shown < total)})
