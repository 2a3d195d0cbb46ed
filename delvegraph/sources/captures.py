"""Route, foreign-function and field facts by line patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Method names and the shapes that register or call a route.
METHODS = "get|post|put|delete|patch|head|options"
SERVER = [rf"""@\w+\.({METHODS})\(\s*["']([^"']+)""", rf"""\b(?:app|router|server)\.({METHODS})\(\s*["'`](/[^"'`]*)""", r"""(\b)HandleFunc\(\s*"([^"]+)""", r"""@(?:Request)?(Get|Post|Put|Delete|Patch)?Mapping\(\s*"([^"]+)"""]
CLIENT = [rf"""\b(?:requests|axios|http|client|session)\.({METHODS})\(\s*[rf]?["'`](?:https?://[^/"'`]+)?(/[^"'`?]*)""", r"""(\b)fetch\(\s*["'`](?:https?://[^/"'`]+)?(/[^"'`?]*)"""]


def _routes(lines: DataFrame, shapes: list[str], path: str) -> DataFrame:
    b = F.col("body")
    hit = F.coalesce(*(F.when(b.rlike(rx), F.struct(F.nullif(F.upper(F.regexp_extract(b, rx, 1)), F.lit("")).alias("method"), F.regexp_extract(b, rx, 2).alias(path))) for rx in shapes))
    return lines.withColumn("h", hit).filter("h is not null").select("file", "line", "h.method", f"h.{path}")


def route_definitions(lines: DataFrame) -> DataFrame:
    """(file, line, method, template) of ``lines(file, line, body)``; an unknown method is NULL."""
    return _routes(lines, SERVER, "template")


def route_uses(lines: DataFrame) -> DataFrame:
    """(file, line, method, path) of client calls."""
    return _routes(lines, CLIENT, "path")


def foreign_aliases(lines: DataFrame) -> DataFrame:
    """(file, kind, alias, target, low_conf): pybind, ctypes and exported C names."""
    b = F.col("body")
    shapes = [
        ("pybind", r"""\.def\(\s*"(\w+)"\s*,\s*&?(?:\w+::)*(\w+)""", 1, 2, False),
        ("ctypes", r"""\b(?:lib|dll|cdll|_lib)\.(\w+)\.(?:argtypes|restype)\b""", 1, 1, True),
        ("extern-c", r"""^\s*extern\s+"C"\s+[\w\s*]+?(\w+)\s*\(""", 1, 1, False),
    ]
    hit = F.coalesce(*(F.when(b.rlike(rx), F.struct(F.lit(k).alias("kind"), F.regexp_extract(b, rx, a).alias("alias"), F.regexp_extract(b, rx, t).alias("target"), F.lit(low).alias("low_conf"))) for k, rx, a, t, low in shapes))
    return lines.withColumn("h", hit).filter("h is not null").select("file", "h.kind", "h.alias", "h.target", "h.low_conf")


def member_fields(lines: DataFrame) -> DataFrame:
    """(file, line, type_name, field): member declarations of a class type."""
    rx = r"^\s+(?:private|public|protected|readonly|final|const|static|mutable|\s)*(?:std::(?:unique_ptr|shared_ptr|vector|optional)<)?([A-Z]\w*)[>*&]*\s+(\w+)\s*(?:;|=|\{)"
    return lines.filter(F.col("body").rlike(rx)).select("file", "line", F.regexp_extract("body", rx, 1).alias("type_name"), F.regexp_extract("body", rx, 2).alias("field"))


def outline(lines: DataFrame) -> DataFrame:
    """(file, line, depth, head): control-flow lines with their indentation depth."""
    rx = r"^\s*(?:\}\s*)?(if|else|elif|for|while|switch|case|try|catch|except|finally|return|with|match|do|def|class|fn|func|function)\b"
    return lines.filter(F.col("body").rlike(rx)).select("file", "line", F.floor(F.length(F.regexp_extract(F.replace("body", F.lit("\t"), F.lit("    ")), "^( *)", 1)) / 2).cast("int").alias("depth"), F.trim("body").alias("head"))
