"""The thin ``opN_*`` queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delvegraph.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hnsw_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.embed_dedup import near_vectors

    found = near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.suffix_dedup import n_removed, remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"), 100)
    return found.select("doc_id", "n_bytes", n_removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.language_id import fit_on, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit_on(docs, ~held_out(F.col("doc_id")))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.sharding import byte_balanced_shards

    out = byte_balanced_shards(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of two versions of the corpus: half of its rows, then all of them, which
    scans only blobs that the first lacked; all findings come from the ledger."""
    from uuid import uuid4

    from delvegraph.llm.secret_scan import Ledger, findings, span_text, versions_of
    from delvegraph.llm.storage import shared_dir

    versions = versions_of(_table(spark, sf_dir, "documents"))
    ledger = Ledger(spark, f"{shared_dir(spark)}/delvegraph/secret-ledger-{uuid4().hex[:12]}")
    ledger.commit(versions.filter(F.substring("blob", 1, 1) < "8"))
    ledger.commit(versions)
    paths = findings(versions, ledger.rows())
    hits, base = F.col("hits"), ("assign", "access", "hex")
    count = lambda kind: F.size(F.filter(hits, lambda h: h["kind"] == kind)).cast("long")
    return paths.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(span_text(hits, base).cast("binary"), 256).alias("base_sha256"),
        span_text(hits).alias("spans"),
    )


def op6_suffix_automaton_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.decontaminate import find_overlap, is_contaminated, n_hit

    found = find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", n_hit(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op7_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.lm_score import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op8_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.minhash_dedup import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), 4096).drop("ids")


def op10_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from delvegraph.llm.token_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hnsw_near_vectors, op2_deep_shallow_repeats, op3_crf_language, op4_byte_balanced_shards, op5_secret_ledger, op6_suffix_automaton_overlap, op7_attention_scores, op8_odd_sketch_dedup, op9_concatenate_and_cut, op10_resync_token_counts)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
