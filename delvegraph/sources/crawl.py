"""Crawling source trees into ``files`` and ``skipped`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delvegraph.operators.graph import is_test_path

MAX_BYTES, MAX_JSON = 4 << 20, 256 << 10
# Folders that hold no sources, names of generated files, languages by extension.
PRUNED = (".git", ".hg", ".svn", "node_modules", "vendor", "third_party", "build", "dist", "target", "__pycache__", ".venv", "venv")
GENERATED = r"(\.min\.(js|css)|_pb2(_grpc)?\.py|\.pb\.(cc|h|go)|\.generated\.[a-z]+|\.lock)$"
LANGUAGES = {
    "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "inl": "cpp", "metal": "cpp", "cu": "cpp", "m": "objc", "mm": "objc",
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "java": "java", "rb": "ruby",
    "sh": "bash", "bash": "bash", "go": "go", "rs": "rust", "swift": "swift", "cs": "csharp", "json": "json", "md": "markdown", "ipynb": "notebook", "html": "html", "csv": "csv",
}


def language(path: Column) -> Column:
    """Language by extension; NULL for others."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def _drop_reason(max_bytes: int) -> Column:
    size, path = F.col("n_bytes"), F.col("path")
    return (
        F.when(size > max_bytes, "oversize")
        .when((F.col("lang") == "json") & (size > MAX_JSON), "large-json")
        .when(F.lower(path).rlike(GENERATED), "generated")
        .when(F.position(F.lit(b"\x00"), F.substring("content", 1, 4096)) > 0, "binary")
    )


def crawl(spark: SparkSession, roots: str | list[str], exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES, ignore_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of up to 16 roots.

    ``files(file_id, root, path, lang, n_bytes, content_hash, content)``: ids are
    places in the byte order of (root, path).  ``skipped`` has every dropped file
    with its reason and size; ``content`` is read only for what stays.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    if not 1 <= len(roots) <= 16:
        raise ValueError("1 to 16 roots")
    found = None
    for k, root in enumerate(roots):
        base = "/" + root.split("://", 1)[-1].strip("/") + "/"
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        # the part of the path after the root
        rel = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
        one = one.select(F.lit(k).alias("root"), rel.alias("path"), F.col("length").alias("n_bytes"), "content")
        found = one if found is None else found.unionByName(one)
    inside = F.split("path", "/")
    found = found.filter(~F.arrays_overlap(inside, F.array(*(F.lit(p) for p in PRUNED)))).withColumn("lang", language(F.col("path"))).filter("lang is not null")
    for part in exclude:
        found = found.filter(~F.col("path").contains(part))
    if ignore_tests:
        found = found.filter(~is_test_path(F.col("path")))
    marked = found.withColumn("reason", _drop_reason(max_bytes))
    skipped = marked.filter("reason is not null").select("root", "path", "n_bytes", "reason")
    kept = marked.filter("reason is null").withColumn("content_hash", F.xxhash64("content"))
    ids = kept.select("root", "path").withColumn("file_id", F.row_number().over(Window.orderBy("root", "path")) - 1)  # paths only
    return kept.join(ids, ["root", "path"]).select("file_id", "root", "path", "lang", "n_bytes", "content_hash", "content"), skipped


def changed_since(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, content_hash) the known index lacks."""
    return files.join(known.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")
