"""Which tests a change needs, what tests exercise, and seams no test reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvegraph.operators.graph import is_test_path, reach


def _tests(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_test_path(F.col("file")))


def tested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): symbols that a test reaches."""
    return reach(edges, _tests(nodes), forward=True).select("id")


def gate(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, untested): test files (with symbols) that reach the change, and non-test
    symbols in its radius that no test reaches.  The radius excludes the change."""
    radius = reach(edges, changed, forward=False).select("id").join(nodes, "id")
    is_test = is_test_path(F.col("file"))
    tests = radius.filter(is_test).groupBy("file").agg(F.count(F.lit(1)).alias("symbols"))
    covered = tested(nodes, edges).union(_tests(nodes).select("id"))
    return tests, radius.filter(~is_test).join(covered, "id", "left_anti").select("id", "name", "file", "cx")


def exercised(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(id): non-test symbols that the given test symbols reach."""
    return reach(edges, _tests(tests), forward=True).select("id").join(nodes.filter(~is_test_path(F.col("file"))), "id", "left_semi")


def module_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_file, dst_file, calls) between different files."""
    return _by_file(nodes, edges).groupBy("src_file", "dst_file").agg(F.sum("n_ref").alias("calls"))


def seams(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_file, dst_file, n_edges): calls between files whose target no test reaches."""
    covered = tested(nodes, edges).union(_tests(nodes).select("id")).select(F.col("id").alias("dst"))
    return _by_file(nodes, edges.join(covered, "dst", "left_anti")).groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("n_edges"))


def _by_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", "file")
    e = edges.join(n.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return e.filter("src_file <> dst_file")
