"""Document text: html, notebooks, csv, markdown, mentions and drift of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.plans.fanout import each_with
from delvegraph.plans.spans import best_span


def html_text(html: Column) -> Column:
    """Visible text: script and style elements go, tags become spaces, five entities are
    decoded (others become a space), white space collapses to a newline or a space."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    t = F.regexp_replace(t, r"&(?!amp;)[#A-Za-z0-9]{1,8};", " ")
    t = F.replace(t, F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(t, r"[ \t\r\f]*\n\s*", "\n")
    return F.trim(F.regexp_replace(t, r"[ \t\r\f]+", " "), F.lit(" \n"))


def notebook_text(source: Column) -> Column:
    """Cell sources of a notebook, one after the other."""
    cells = F.from_json(source, "struct<cells:array<struct<cell_type:string,source:array<string>>>>")["cells"]
    return F.array_join(F.transform(cells, lambda c: F.array_join(c["source"], "")), "\n")


def csv_text(source: Column, sample: int = 3) -> Column:
    """Header names and the first rows of a csv file."""
    return F.array_join(F.slice(F.split(source, "\r?\n"), 1, sample + 1), "\n")


def headings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line, level, title): ATX headings outside fences."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("p", "body"))
    fence = F.sum(F.when(F.col("body").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)).over(Window.partitionBy("id").orderBy("p"))
    hit = lines.withColumn("open", fence % 2).filter((F.col("open") == 0) & F.col("body").rlike(r"^#{1,6}\s+\S"))
    return hit.select("id", (F.col("p") + 1).alias("line"), F.length(F.regexp_extract("body", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("body", r"^#+\s+(.*?)\s*#*\s*$", 1)).alias("title"))


def wikilinks(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, target) of [[target]] and [[target|label]] links."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("target")).select("id", F.trim("target").alias("target")).distinct()


def code_mentions(docs: DataFrame, symbols: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, sym_id): names in backticks that are defined."""
    names = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("`([A-Za-z_][A-Za-z0-9_.:]*)(?:\\(\\))?`"), F.lit(1)))).alias("full"))
    last = names.withColumn("name", F.element_at(F.split("full", r"[.:]+"), -1))
    return each_with(last.select("id", "name"), symbols.select("sym_id", "name"), ["name"], "sym_id")


def line_anchors(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, path, line): path:line references in documents."""
    rx = r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+:\d+)"
    a = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(rx), F.lit(1)))).alias("a"))
    return a.select("id", F.regexp_extract("a", r"^(.*):(\d+)$", 1).alias("path"), F.regexp_extract("a", r"^(.*):(\d+)$", 2).cast("int").alias("line"))


def drift(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, line, verdict) of anchors that no longer hold: missing-file or past-eof.
    ``files(path, n_lines)``."""
    j = anchors.join(files.select("path", "n_lines"), "path", "left")
    verdict = F.when(F.col("n_lines").isNull(), "missing-file").when(F.col("line") > F.col("n_lines"), "past-eof").otherwise("holds")
    return j.select("id", "path", "line", verdict.alias("verdict")).filter("verdict <> 'holds'")


def generated(docs: DataFrame, share: float = 0.6, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id): documents with a generated-by marker or mostly fenced lines."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("p", "body"))
    mark = F.col("body").rlike(r"^\s*(```|~~~)")
    fence = F.sum(F.when(mark, 1).otherwise(0)).over(Window.partitionBy("id").orderBy("p"))
    t = lines.withColumn("inside", (fence % 2 == 1) & ~mark).groupBy("id").agg(F.avg(F.col("inside").cast("int")).alias("f"), F.max((F.col("body").rlike(r"(?i)(auto-?generated|generated by|do not edit)")).cast("int")).alias("m"))
    return t.filter((F.col("m") == 1) | (F.col("f") >= share)).select("id")


def trace_frames(lines: DataFrame) -> DataFrame:
    """(id, nth, format, path, line, func) of stack-trace lines(id, nth, value): Python,
    sanitizer, node, compiler and plain path:line frames; the first pattern wins."""
    v = F.col("value")
    shapes = [
        ("python", r'^\s*File "([^"]+)", line (\d+)(?:, in (.*))?', (1, 2, 3)),
        ("asan", r"^\s*#\d+ 0x[0-9a-f]+ in (\S+).* (\S+?):(\d+)(?::\d+)?$", (2, 3, 1)),
        ("node", r"^\s*at (?:(\S+) \()?([^():]+):(\d+):\d+\)?$", (2, 3, 1)),
        ("compiler", r"^([^\s:]+):(\d+):\d+: (?:error|warning|note)", (1, 2, 0)),
        ("generic", r"([A-Za-z0-9_./-]+\.[A-Za-z]+):(\d+)", (1, 2, 0)),
    ]
    frame = F.coalesce(
        *(
            F.when(v.rlike(rx), F.struct(F.lit(n).alias("format"), F.regexp_extract(v, rx, p).alias("path"), F.regexp_extract(v, rx, k).cast("int").alias("line"), (F.nullif(F.regexp_extract(v, rx, f), F.lit("")) if f else F.lit(None).cast("string")).alias("func")))
            for n, rx, (p, k, f) in shapes
        )
    )
    return lines.withColumn("f", frame).filter("f is not null").select("id", "nth", "f.format", "f.path", "f.line", "f.func")


def bind_frames(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """Frames with sym_id and ``how``: by name within the file, else by the innermost line span.
    ``symbols(sym_id, name, file, first, last)``."""
    f = frames.withColumn("file", F.element_at(F.split("path", "/"), -1))
    s = symbols.select("sym_id", "name", F.element_at(F.split("file", "/"), -1).alias("file"), F.col("first").alias("start"), (F.col("last") + 1).alias("stop"))
    by_name = s.groupBy("file", F.col("name").alias("func")).agg(F.min("sym_id").alias("by_name"))
    inner = best_span(f.withColumnRenamed("line", "at"), s, "file", F.struct("start", "sym_id"))
    by_line = inner.select("file", F.col("at").alias("line"), F.col("best.sym_id").alias("by_line"))
    j = f.join(by_name, ["file", "func"], "left").join(by_line, ["file", "line"], "left")
    how = F.when(F.col("by_name").isNotNull(), F.when(F.col("by_line").isNotNull() & (F.col("by_line") != F.col("by_name")), "name-disagrees").otherwise("name")).when(F.col("by_line").isNotNull(), "line")
    return j.select("id", "nth", "path", "line", "func", F.coalesce("by_name", "by_line").alias("sym_id"), how.alias("how"))


def gates(lines: DataFrame) -> DataFrame:
    """(file, line, gate, kind, default) of conditional-compilation and option lines(file, line, body)."""
    b = F.col("body")
    shapes = [
        ("option", r"(?i)^\s*option\(\s*(\w+)\s+\"[^\"]*\"\s*(ON|OFF)?", 1, 2),
        ("ifdef", r"^\s*#\s*if(?:n?def)?\s+(?:defined\s*\(?\s*)?([A-Za-z_]\w*)", 1, 0),
        ("define", r"^\s*#\s*define\s+([A-Z][A-Z0-9_]{2,})(?:\s+([01]))?\s*$", 1, 2),
        ("getenv", r"getenv\(\s*\"([A-Z0-9_]+)\"", 1, 0),
    ]
    hit = F.coalesce(*(F.when(b.rlike(rx), F.struct(F.regexp_extract(b, rx, g).alias("gate"), F.lit(k).alias("kind"), (F.nullif(F.regexp_extract(b, rx, d), F.lit("")) if d else F.lit(None).cast("string")).alias("default"))) for k, rx, g, d in shapes))
    return lines.withColumn("g", hit).filter("g is not null").select("file", "line", "g.gate", "g.kind", "g.default")


def url_template(url: Column) -> Column:
    """Path of a URL without query and fragment, numbers as {id}."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.regexp_replace(F.regexp_replace(path, r"/\d+(?=/|$)", "/{id}"), r"(.)/$", "$1")
