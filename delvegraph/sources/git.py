"""Git history, refs, trees and blobs as tables.

Repositories are read by the git program where a task runs, so the path must be
one that every executor sees; each ref or blob batch is a partition of its own.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delvegraph.operators.mining import parse_git_log

LOG = ["log", "--name-only", "--no-renames", "--format=@%H|%ct|%ae"]


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", repo, *args], input=data, capture_output=True, check=True).stdout


def log(spark: SparkSession, repo: str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files), newest first; ``since`` is a revision or a date."""
    extra: list[str] = []
    if since:
        try:
            git(repo, "rev-parse", "--verify", "--quiet", f"{since}^{{commit}}")
            extra = [f"{since}..HEAD"]
        except subprocess.CalledProcessError:
            extra = [f"--since={since}"]
    lines = git(repo, *LOG, *extra).decode("utf-8", "replace").split("\n")
    return parse_git_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))


def refs(spark: SparkSession, repo: str) -> DataFrame:
    """(ref, sha) of branches and tags."""
    rows = [x.split(" ") for x in git(repo, "for-each-ref", "--format=%(refname:short) %(objectname)", "refs/heads", "refs/tags").decode().split("\n") if x]
    return spark.createDataFrame(rows or [("", "")], "ref string, sha string").filter("ref <> ''")


def tree(refs_: DataFrame, repo: str) -> DataFrame:
    """(ref, path, sha): files of each ref's tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ref in pdf["ref"]:
                rows = [(ref, x.split("\t", 1)[1], x.split(" ")[2].split("\t")[0]) for x in git(repo, "ls-tree", "-r", "-z", ref).decode("utf-8", "replace").split("\0") if " blob " in x]
                yield pd.DataFrame(rows, columns=["ref", "path", "sha"])

    return refs_.select("ref").repartition("ref").mapInPandas(run, "ref string, path string, sha string")


def blobs(shas: DataFrame, repo: str) -> DataFrame:
    """(sha, content): each distinct blob once, read in batches by one process a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf["sha"].iloc[i : i + 256].tolist()
                raw, at, rows = git(repo, "cat-file", "--batch", data="\n".join(part).encode() + b"\n"), 0, []
                for sha in part:
                    end = raw.index(b"\n", at)
                    size = int(raw[at:end].split(b" ")[2])
                    rows.append((sha, raw[end + 1 : end + 1 + size]))
                    at = end + size + 2
                yield pd.DataFrame(rows, columns=["sha", "content"])

    return shas.select("sha").distinct().mapInPandas(run, "sha string, content binary")


def suffix_bind(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): history paths bound to indexed files by the one file whose path ends
    with them or that they end with; ambiguous paths are left out."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    p, f = paths.select("path", base("path").alias("base")).distinct(), files.select(F.col("path").alias("file"), base("path").alias("base"))
    at = lambda long, short: (long == short) | long.endswith(F.concat(F.lit("/"), short))
    hit = p.join(f, "base").filter(at(F.col("path"), F.col("file")) | at(F.col("file"), F.col("path")))
    return hit.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).filter("n = 1").select("path", "file")
