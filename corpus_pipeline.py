"""A training-data pipeline of five operators, each working on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Further columns, whatever their names, pass
through the first four stages as they are; an empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delvegraph.llm.decontaminate import remove_overlap
from delvegraph.llm.language_id import UNKNOWN, fit_on, identify
from delvegraph.llm.minhash_dedup import keep_one
from delvegraph.llm.packing import pack
from delvegraph.llm.secret_scan import blob_hits, mask_hits, scan_new_blobs, versions_of
from delvegraph.llm.storage import drop, materialize

#: A document whose best language has a smaller share of its words is rejected.
LEAST_SHARE = 0.4


def _row(docs: DataFrame):
    """All columns as one, so that none meets a column of a stage."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _columns(rows: DataFrame, like: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``like`` from ``row``, with another text and its length where ``text`` names a column."""
    new = {} if text is None else {"text": F.col(text), "n_chars": F.length(text)}
    return rows.select(*((new[c].cast(t) if c in new else F.col("row").getField(c)).alias(c) for c, t in like.dtypes))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language that holds ``LEAST_SHARE`` of their words or more.

    Null texts and texts without a letter go; so do all where no row has a language
    to learn from.  Repeated rows are judged one by one.
    """
    model = fit_on(docs, F.lit(True))
    found = identify(docs.select(_row(docs), "text"), model, keep=["row", "text"])
    return _columns(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Null, empty and wordless texts and rows without an id stay; rows that repeat an
    id stay or go together.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more is benchmark text; rarer runs are cut out.

    Null texts stay null; an empty benchmark changes nothing.
    """
    cleaned = remove_overlap(docs.select(_row(docs), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(cleaned, docs, "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark of its kind.

    A document is joined with the findings of its content, so repeated ids do no
    harm; null texts stay null.
    """
    versions = versions_of(docs.select(_row(docs), "text"), path_col="row")
    ledger = scan_new_blobs(versions.select("blob", "text"))
    hits = materialize(blob_hits(ledger), "hits")
    none = F.array().cast(dict(hits.dtypes)["hits"])
    joined = versions.join(hits, "blob", "left").select(F.col("path").alias("row"), F.coalesce("hits", none).alias("hits"))
    text = F.col("row").getField("text")
    return _columns(joined.withColumn("masked", F.when(text.isNotNull(), mask_hits(text, F.col("hits")))), docs, "masked")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with the tokens' ids (32 bits each).

    Null texts are empty and hold the end id only.
    """
    return pack(docs, 4096)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: The language model and the vocabulary are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            drop(done)
    return docs
