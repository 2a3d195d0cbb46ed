"""The registry, and the adapters that read the test tables as relations of a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parts are symbols: the type gives the kind, the size the complexity, the brand the file.
KIND = {"ECONOMY": "fn", "STANDARD": "method", "MEDIUM": "cls", "PROMO": "struct", "LARGE": "iface", "SMALL": "var"}
NODES = (
    "nodes AS (SELECT p_partkey AS id, p_name AS name, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items())
    + " ELSE 'other' END AS kind, p_size AS cx, CASE WHEN p_brand LIKE '%5' THEN 'tests/' ELSE 'src/' END || lower(replace(p_brand, '#', '')) || '.py' AS file FROM part)"
)
#: Consecutive parts of an order are calls.
REFS = (
    "refs AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) "
    "WHERE dst IS NOT NULL AND src <> dst)"
)
EDGES = "edges AS (SELECT src, dst, count(*) AS n_ref, least(sqrt(count(*)), 8.0) AS w FROM refs GROUP BY src, dst)"
GRAPH = f"WITH RECURSIVE {NODES}, {REFS}, {EDGES}"
#: Calls that repeat: a sparse graph.
OFTEN = f"{GRAPH}, often AS (SELECT * FROM edges WHERE n_ref >= 2)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for kv in KIND.items() for x in kv))[F.col("p_type")]
    folder = F.when(F.col("p_brand").like("%5"), "tests/").otherwise("src/")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.coalesce(kind, F.lit("other")).alias("kind"), F.col("p_size").alias("cx"), F.concat(folder, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".py")).alias("file")
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst is not null and src <> dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.operators.graph import simple_edges

    return simple_edges(refs(spark, sf_dir))


def often(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("n_ref >= 2")


# Orders are commits by their customers, parts the files they touch.
COMMITS = "WITH RECURSIVE commits AS (SELECT o_orderkey AS commit_id, o_orderdate AS ts, o_custkey AS author, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS ordinal FROM orders), cf AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem)"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.plans.ranking import numbered

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"))
    placed = numbered(rows, [(F.col("ts"), False), (F.col("commit_id"), False)], "ordinal")
    return placed.withColumn("ordinal", (F.col("ordinal") + 1).cast("int"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file")).distinct()


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
