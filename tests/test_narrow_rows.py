"""What does not need to leave its row, or be told apart, stays where it is."""

import pytest
from pyspark.sql import functions as F

from delvegraph.operators import quality
from delvegraph.operators import retrieval as R


def test_postings_of_the_asked_terms(spark):
    docs = spark.createDataFrame([(1, "red widget Red", "widget"), (2, "blue gear a", None), (3, None, "red"), (3, "red again", ""), (4, "", "")], "id long, text string, name string")
    fields = {"text": 1, "name": 3}
    whole = R.postings(docs, fields)
    index, dl = R.asked_postings(docs, fields, "red Red gear none")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(index) == rows(whole.filter(F.col("term").isin("red", "gear", "none")))
    assert rows(dl.filter("dl > 0")) == rows(whole.groupBy("id").agg(F.sum("tf").alias("dl")))
    score = lambda df: {r.id: pytest.approx(r.score, 1e-12) for r in df.collect()}
    assert score(R.bm25(index, 5, "red Red gear none", dl)) == score(R.bm25(whole, 5, "red Red gear none"))


def test_context_ratio_of_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1), (4, 9)], "src long, dst long")
    symbols = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 3), (3, "b", 3), (3, "c", 2), (4, "d", 1)], "id long, file string, tokens int")
    uses = edges.join(symbols.select(F.col("id").alias("src"), "file"), "src").join(symbols.select(F.col("id").alias("dst"), F.col("file").alias("def_file"), "tokens"), "dst").select(F.col("src").alias("id"), "file", F.col("dst").alias("def_id"), "def_file", "tokens")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "outside_tokens", "outside", "total_tokens", "ratio").collect())
    df = quality.context_ratio_of(edges, symbols)
    assert rows(df) == rows(quality.context_ratio(uses)) == [(1, 5, 2, 12, 5 / 12), (2, 0, 0, 5, 0.0)]
