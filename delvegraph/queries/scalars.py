"""Scalar functions, JSON and time windows over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from delvegraph.functions import text as T
from delvegraph.queries.registry import query, rounded, table


def _names(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    snake = F.replace(n, F.lit(" "), F.lit("_"))
    first = F.split_part(n, F.lit(" "), F.lit(1))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, snake).when(k == 1, F.upper(snake)).when(k == 2, F.concat(first, F.lit("Part"))).otherwise(first).alias("name"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'snake' WHEN 1 THEN 'screaming' WHEN 2 THEN 'camel' END AS style FROM part")
def case_styles(spark, sf):
    return _names(spark, sf).select("id", T.case_style(F.col("name")).alias("style"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 2 THEN lower(split_part(p_name, ' ', 1)) || ' part' WHEN 3 THEN lower(split_part(p_name, ' ', 1)) ELSE lower(p_name) END AS words FROM part")
def identifier_words(spark, sf):
    return _names(spark, sf).select("id", F.array_join(T.identifier_words(F.col("name")), " ").alias("words"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/', '') AS path FROM pages WHERE NOT regexp_matches(url, '//.*//')")
def normal_paths(spark, sf):
    p = table(spark, sf, "pages").filter("not url rlike '//.*//'")
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return p.select("page_id", T.normal_path(F.concat(F.lit("/./"), bare)).alias("path"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, min((props->>'$.k')::BIGINT) AS least, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def event_properties(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"), F.avg("value").alias("mean")), "mean")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """The batch form of the streaming extension's tumbling windows."""
    return table(spark, sf, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT user_id, ts AS first_ts, event_type AS first_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_event_by_user(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by(F.struct("ts", "event_type"), F.struct("ts", "event_id")).alias("f")).select("user_id", F.col("f.ts").alias("first_ts"), F.col("f.event_type").alias("first_type"))


@query("SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name")
def dimension_rollup(spark, sf):
    """Dimension tables joined to a fact by broadcast-sized keys."""
    region = table(spark, sf, "region")
    first = region.agg(F.min("r_name").alias("r_name"))
    n = table(spark, sf, "nation").join(region.join(first, "r_name"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return rounded(c.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance")), "balance", digits=2)
