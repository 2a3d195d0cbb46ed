"""Small rule files read on the driver: architecture rules, lint rules, field notes, labels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule file that cannot be read; the message names the line."""


def arch_rules(text: str) -> list[tuple[str, str, str, str]]:
    """(rule, verdict, src_rx, dst_rx) of ``layer name = part, part`` and ``deny|allow a -> b``
    lines; names of layers stand for their parts, ``/rx/`` is a path pattern."""
    layers: dict[str, str] = {}
    rules = []

    def side(s: str) -> str:
        s = s.strip()
        return s[1:-1] if len(s) > 1 and s[0] == s[-1] == "/" else layers.get(s, re.escape(s))

    for no, line in enumerate(text.split("\n"), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if m := re.fullmatch(r"layer\s+(\w+)\s*=\s*(.+)", line):
            layers[m[1]] = "(" + "|".join(re.escape(p.strip()) for p in m[2].split(",")) + ")"
        elif m := re.fullmatch(r"(deny|allow)\s+(.+?)\s*->\s*(.+)", line):
            rules.append((line, m[1], side(m[2]), side(m[3])))
        else:
            raise RuleError(f"line {no}: {line}")
    return rules


def rules_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(arch_rules(text), "rule string, verdict string, src_rx string, dst_rx string")


def lint_rules(text: str) -> list[dict]:
    """Rules of a flat YAML list: id, language, severity, message, query, inside, not-inside, not-matches."""
    out: list[dict] = []
    for no, line in enumerate(text.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.fullmatch(r"(\s*-\s*|\s+)([a-z-]+):\s*(.*)", line)
        if not m:
            raise RuleError(f"line {no}: {line}")
        if "-" in m[1]:
            out.append({})
        if not out:
            raise RuleError(f"line {no}: no rule begun")
        out[-1][m[2]] = m[3].strip().strip("\"'")
    for r in out:
        if not {"id", "query"} <= set(r):
            raise RuleError(f"rule {r} lacks id or query")
    return out


def lint(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """(path, line, rule, severity) of ``lines(path, lang, line, body)``: query patterns less
    not-matches; ``inside``/``not-inside`` test the nearest block opener above."""
    out = None
    from pyspark.sql import Window

    opener = F.last(F.when(F.col("body").rlike(r"(\{|:)\s*$"), F.col("body")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    src = lines.withColumn("opener", F.coalesce(opener, F.lit("")))
    for r in rules:
        hit = src.filter(F.col("body").rlike(r["query"]))
        if "language" in r:
            hit = hit.filter(F.col("lang") == r["language"])
        if "not-matches" in r:
            hit = hit.filter(~F.col("body").rlike(r["not-matches"]))
        if "inside" in r:
            hit = hit.filter(F.col("opener").rlike(r["inside"]))
        if "not-inside" in r:
            hit = hit.filter(~F.col("opener").rlike(r["not-inside"]))
        one = hit.select("path", "line", F.lit(r["id"]).alias("rule"), F.lit(r.get("severity", "warning")).alias("severity"))
        out = one if out is None else out.unionByName(one)
    return out


def tallied(findings: DataFrame, cap: int) -> DataFrame:
    """(path, line, rule, severity, nth, total): the first ``cap`` findings of each rule by
    place, with the rule's whole count, so that what a cap hides is known."""
    from pyspark.sql import Window

    total = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("path", "line"))
    return findings.withColumn("nth", nth).filter(F.col("nth") <= cap).join(F.broadcast(total), "rule").select("path", "line", "rule", "severity", "nth", "total")


#: A built-in pack of line rules.
BUILTIN = [
    {"id": "goto", "query": r"^\s*goto\s+\w+\s*;"},
    {"id": "unsafe-c-fn", "query": r"\b(strcpy|strcat|sprintf|gets)\s*\(", "severity": "error"},
    {"id": "weak-crypto", "query": r"(?i)\b(md5|sha1|des|rc4)\s*\(", "severity": "error"},
    {"id": "empty-catch", "query": r"(catch\s*\([^)]*\)\s*\{\s*\}|except[^:]*:\s*pass\s*$)"},
    {"id": "self-assign", "query": r"^\s*(\w+)\s*=\s*\1\s*;?\s*$"},
    {"id": "suspicious-semicolon", "query": r"\b(if|while|for)\s*\([^;]*\)\s*;\s*$", "not-matches": r"\bdo\b"},
    {"id": "typedef-over-using", "query": r"^\s*typedef\s+(?!struct|enum|union)"},
    {"id": "magic-number", "query": r"[^\w.\[]([2-9]\d{2,}|[1-9]\d{3,})[^\w.\]]", "not-matches": r"(const|define|enum|=)"},
]


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(target, date, text, sha, branch) of a tab-separated notes file."""
    t = F.split("value", "\t")
    cell = lambda i: F.nullif(F.get(t, F.lit(i)), F.lit(""))
    return spark.read.text(path).filter("value <> '' and not startswith(value, '#')").select(cell(0).alias("target"), F.to_date(cell(1)).alias("date"), cell(2).alias("text"), cell(3).alias("sha"), cell(4).alias("branch"))


def profile(lines: DataFrame) -> DataFrame:
    """(scope, file, line, calls, total_ms) between #PROF_TSV markers of ``lines(line_no, value)``."""
    from pyspark.sql import Window

    inside = F.sum(F.when(F.col("value").startswith("#PROF_TSV"), 1).otherwise(0)).over(Window.orderBy("line_no"))
    t = F.split("value", "\t")
    return lines.withColumn("n", inside).filter((F.col("n") % 2 == 1) & ~F.col("value").startswith("#")).filter(F.size(t) >= 5).select(t[0].alias("scope"), t[1].alias("file"), t[2].cast("int").alias("line"), t[3].cast("long").alias("calls"), t[4].cast("double").alias("total_ms"))


#: Constructs that are often misread.
ATOMS = [
    {"id": "octal-literal", "query": r"[^\w.]0[0-7]+[^\w.]"},
    {"id": "nested-ternary", "query": r"\?[^?;]*\?[^;]*:[^;]*:"},
    {"id": "comma-operator", "query": r"=\s*\([^()]*,[^()]*\)\s*;"},
    {"id": "assignment-in-condition", "query": r"\b(if|while)\s*\([^=!<>()]*[^=!<>]=[^=]"},
    {"id": "pre-post-increment", "query": r"[=(,]\s*(\w+(\+\+|--)|(\+\+|--)\w+)"},
    {"id": "reversed-subscript", "query": r"\b\d+\[\w+\]"},
    {"id": "logic-as-control", "query": r"^\s*[\w.]+(\([^)]*\))?\s*(&&|\|\|)\s*[\w.]+\([^)]*\)\s*;"},
]
#: Patterns that are unkind to caches, inside loops.
CACHE = [
    {"id": "map-in-loop", "query": r"\bstd::(map|unordered_map|list|set)<", "inside": r"\b(for|while)\b"},
    {"id": "pointer-chase", "query": r"->\w+->\w+->", "inside": r"\b(for|while)\b"},
    {"id": "virtual-in-loop", "query": r"->\w+\s*\(", "inside": r"\bfor\b"},
    {"id": "alloc-in-loop", "query": r"\b(new\s+\w|malloc\s*\(|make_(unique|shared)<)", "inside": r"\b(for|while)\b"},
    {"id": "column-walk", "query": r"\[\w+\]\[\w+\]", "inside": r"\bfor\b"},
]
