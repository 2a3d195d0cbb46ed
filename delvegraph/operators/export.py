"""Result forms: flat candidates, columnar arrays with a path dictionary, per-file metrics, graph markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(nodes: DataFrame, score: str, limit: int = 200) -> DataFrame:
    """(rank, score, name, id, kind, path) of the best rows, ties by id."""
    top = nodes.orderBy(F.desc(score), "id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc(score), "id")).alias("rank"), F.col(score).alias("score"), "name", "id", "kind", F.col("file").alias("path"))


def path_table(nodes: DataFrame) -> DataFrame:
    """(file, path_id): paths numbered in byte order."""
    return nodes.select("file").distinct().withColumn("path_id", F.row_number().over(Window.orderBy("file")) - 1)


def columnar(nodes: DataFrame, by: str) -> DataFrame:
    """Parallel arrays (ids, names, path_ids) for each value of ``by``, in id order."""
    rows = nodes.join(F.broadcast(path_table(nodes)), "file").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "name", "path_id"))).alias("r"))
    return rows.select(by, F.col("r.id").alias("ids"), F.col("r.name").alias("names"), F.col("r.path_id").alias("path_ids"))


def file_metrics(nodes: DataFrame) -> DataFrame:
    """(path, functions, complexity, max_function_complexity)."""
    return nodes.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("functions"), F.sum("cx").alias("complexity"), F.max("cx").alias("max_function_complexity"))


def metrics_json(nodes: DataFrame) -> DataFrame:
    """One JSON document for each file."""
    return file_metrics(nodes).select("path", F.to_json(F.struct("functions", "complexity", "max_function_complexity")).alias("attributes"))


def mermaid(edges: DataFrame, limit: int = 200) -> str:
    """The heaviest edges(src, dst, w) as a Mermaid graph."""
    rows = edges.orderBy(F.desc("w"), "src", "dst").limit(limit).collect()
    return "\n".join(["graph LR", *(f'  n{r["src"]}["{r["src"]}"] --> n{r["dst"]}["{r["dst"]}"]' for r in rows)])


def html_graph(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> str:
    """A standalone page with the heaviest edges as an adjacency list."""
    import html
    import json

    rows = edges.orderBy(F.desc("w"), "src", "dst").limit(limit).collect()
    names = {r["id"]: r["name"] for r in nodes.join(edges.sparkSession.createDataFrame([(x,) for r in rows for x in (r["src"], r["dst"])] or [(-1,)], "id long").distinct(), "id").collect()}
    data = [{"from": names.get(r["src"], str(r["src"])), "to": names.get(r["dst"], str(r["dst"])), "w": float(r["w"])} for r in rows]
    items = "".join(f"<li>{html.escape(d['from'])} &rarr; {html.escape(d['to'])}</li>" for d in data)
    return f"<!DOCTYPE html><html><body><ul>{items}</ul><script type='application/json' id='graph'>{json.dumps(data).replace('</', '<\\/')}</script></body></html>"
