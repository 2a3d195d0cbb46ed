"""Lexical retrieval: field-weighted BM25, routing, cuts, boosts and document recall."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.functions.text import pinned, subtokens
from delvegraph.plans.ranking import numbered
from delvegraph.plans.staging import stage

K1, B = 1.5, 0.75
#: Field weights of a symbol's text.
WEIGHTS = {"name": 3, "callees": 1, "doc": 2, "body": 1}
#: Words that carry no content in a query.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "where", "which", "with")


def asked_terms(query: str) -> list[str]:
    """The terms of a query, as often as it has them."""
    return [t.lower() for t in re.findall("[A-Z]?[a-z0-9]+", query) if len(t) >= 2]


def postings(docs: DataFrame, fields: dict[str, int], id_col: str = "id") -> DataFrame:
    """(term, id, tf): weighted term frequencies; empty fields add nothing."""
    parts = None
    for c, w in fields.items():
        one = docs.select(F.col(id_col).alias("id"), F.explode(subtokens(F.col(c))).alias("term")).withColumn("w", F.lit(w))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("term", "id").agg(F.sum("w").alias("tf"))


def asked_postings(docs: DataFrame, fields: dict[str, int], query: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(postings of the query's terms, lengths(id, dl) of all documents), from one scan: other
    tokens are counted within their document and do not leave it."""
    asked = F.array(*(F.lit(t) for t in sorted(set(asked_terms(query)))))
    rows = pinned(docs.select(F.col(id_col).alias("id"), F.struct(*(subtokens(F.col(c)).alias(f"f{i}") for i, c in enumerate(fields))).alias("tok")), "tok")
    size = sum((w * F.greatest(F.coalesce(F.size(f"tok.f{i}"), F.lit(0)), F.lit(0)) for i, w in enumerate(fields.values())), F.lit(0))
    held = [F.filter(f"tok.f{i}", lambda t: F.array_contains(asked, t)).alias(f"h{i}") for i in range(len(fields))]
    table = stage(rows.select("id", size.cast("long").alias("dl"), *held), "postings")
    parts = None
    for i, w in enumerate(fields.values()):
        one = table.select("id", F.explode(f"h{i}").alias("term"), F.lit(w).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("term", "id").agg(F.sum("w").alias("tf")), table.groupBy("id").agg(F.sum("dl").alias("dl"))


def bm25(index: DataFrame, n_docs: int, query: str, lengths: DataFrame | None = None) -> DataFrame:
    """(id, score) of the documents that hold a query term; a term counts as often as
    the query has it.  ``n_docs`` counts all documents, those without text included."""
    terms = asked_terms(query)
    spark = index.sparkSession
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    asked = spark.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, times int")
    dl = index.groupBy("id").agg(F.sum("tf").alias("dl")) if lengths is None else lengths
    total = dl.agg((F.sum("dl") / F.lit(float(max(n_docs, 1)))).alias("avgdl"))
    hit = index.join(F.broadcast(asked), "term")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.ln((F.lit(float(n_docs)) - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    tf = F.col("tf")
    part = F.col("times") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.join(F.broadcast(df), "term").join(dl, "id").crossJoin(F.broadcast(total)).groupBy("id").agg(F.sum(part).alias("score"))


def score_documents(docs: DataFrame, fields: dict[str, int], query: str, id_col: str = "id") -> DataFrame:
    """(id, score) as ``bm25`` over ``postings`` gives, for one query in one scan.

    Each document keeps its weighted length and the frequencies of the asked terms;
    corpus statistics are taken while that small table is written, and the scores
    need no join.
    """
    terms = asked_terms(query)
    asked = sorted(set(terms))
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*(subtokens(F.col(c)).alias(f"f{i}") for i, c in enumerate(fields))).alias("tok"))
    rows = pinned(rows, "tok")
    weights = list(fields.values())
    size = lambda i: F.coalesce(F.size(F.col(f"tok.f{i}")), F.lit(0))
    tf = lambda t: sum((w * F.coalesce(F.size(F.filter(F.col(f"tok.f{i}"), lambda x: x == t)), F.lit(0)) for i, w in enumerate(weights)), F.lit(0))
    table = rows.select("id", sum((w * F.greatest(size(i), F.lit(0)) for i, w in enumerate(weights)), F.lit(0)).alias("dl"), *(F.greatest(tf(t), F.lit(0)).alias(f"t{k}") for k, t in enumerate(asked)))
    table = stage(table, "scores", total=F.sum("dl"), **{f"d{k}": F.count_if(F.col(f"t{k}") > 0) for k in range(len(asked))})
    n, total = table.measured["rows"], table.measured["total"] or 0
    if not n or not total or not asked:
        return table.select("id", F.lit(0.0).alias("score")).limit(0)
    score, any_ = F.lit(0.0), F.lit(False)
    for k, t in enumerate(asked):
        d, f = table.measured[f"d{k}"], F.col(f"t{k}")
        idf = math.log((n - d + 0.5) / (d + 0.5) + 1)
        score = score + F.when(f > 0, terms.count(t) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / (total / n)))).otherwise(0.0)
        any_ = any_ | (f > 0)
    return table.filter(any_).select("id", score.alias("score"))


def tiered(scores: DataFrame, tiers: DataFrame, section: float = 0.30, low: float = 0.35) -> DataFrame:
    """Scores times 0.30 for document sections and 0.35 for test, bench and demo paths.
    ``tiers(id, kind, tier)``."""
    return scores.join(tiers, "id").select("id", (F.col("score") * F.when(F.col("kind") == "sec", section).otherwise(1.0) * F.when(F.col("tier") == 1, low).otherwise(1.0)).alias("score"))


def adaptive_cut(scores: DataFrame, ceiling: int = 200, least_drop: float = 0.20, floor: int = 5) -> DataFrame:
    """(id, score, place) kept: the largest relative drop of 20 % or more within the
    ceiling ends the list, though not before ``floor``; the first of equal drops wins."""
    top = scores.filter("score > 0").orderBy(F.desc("score"), "id").limit(ceiling + 1)
    order = Window.orderBy(F.desc("score"), "id")
    ranked = top.withColumn("place", F.row_number().over(order) - 1).withColumn("prev", F.lag("score").over(order))
    ranked = ranked.withColumn("drop", F.when(F.col("place") > 0, (F.col("prev") - F.col("score")) / F.col("prev")))
    n = F.least(F.lit(ceiling), F.count(F.lit(1)))
    best = ranked.agg(F.max_by(F.struct("place", "drop"), F.when(F.col("place") < ceiling, F.struct(F.col("drop"), -F.col("place")))).alias("b"), n.alias("n"))
    keep = best.select(F.when(F.col("b.drop") >= least_drop, F.greatest(F.col("b.place"), F.lit(floor))).otherwise(F.col("n")).alias("keep"))
    return ranked.crossJoin(F.broadcast(keep)).filter("place < keep").select("id", "score", "place")


def route(query: str, names: DataFrame) -> str:
    """'name' (exact-name lane) or 'body': names win for a compound word with at most two
    content words, or when every content word is a defined name."""
    content = [w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query) if w.lower() not in STOPWORDS]
    compound = [w for w in content if "_" in w.strip("_") or re.search("[a-z0-9][A-Z]", w)]
    if compound and len(content) <= 2:
        return "name"
    if not content:
        return "body"
    plain = [w for w in content if w not in compound]
    found = {r[0] for r in names.filter(F.col("name").isin(*plain)).select("name").distinct().limit(len(plain)).collect()} if plain else set()
    return "name" if all(w in found for w in plain) else "body"


def name_lane(nodes: DataFrame, query: str) -> DataFrame:
    """(id, score): symbols whose whole name is a query word, by the name's rarity."""
    words = sorted(set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query)))
    hit = nodes.filter(F.col("name").isin(*words))
    n = nodes.agg(F.count(F.lit(1)).alias("total"))
    df = hit.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(F.broadcast(df), "name").crossJoin(F.broadcast(n)).select("id", F.ln((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1).alias("score"))


def mention_boost(scores: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Rows of ``mentioned(id, nth)`` rise to top * (1 - 0.05 * (nth + 1)) if that is more."""
    top = scores.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("top"))
    lift = mentioned.groupBy("id").agg(F.min("nth").alias("nth")).crossJoin(F.broadcast(top)).select("id", (F.col("top") * (1 - 0.05 * (F.col("nth") + 1))).alias("lift"))
    return scores.join(lift, "id", "full").select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("lift", F.lit(0.0))).alias("score"))


def recall_documents(scores: DataFrame, sections: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """(path, score, place): best section of each file, generated files last, then path.
    ``sections(id, path)``; ``generated(path)``."""
    best = scores.join(sections, "id").groupBy("path").agg(F.max("score").alias("score")).filter("score > 0")
    late = best.withColumn("generated", F.lit(0)) if generated is None else best.join(generated.select("path", F.lit(1).alias("generated")).distinct(), "path", "left").fillna(0, ["generated"])
    placed = numbered(late, [F.col("generated"), (F.col("score"), False), F.col("path")], "place")
    return placed.select("path", "score", (F.col("place") + 1).cast("int").alias("place"))


def within_budget(rows: DataFrame, order: list[Column | tuple[Column, bool]], cost: Column, budget: float) -> DataFrame:
    """The longest prefix of ``rows`` in ``order`` (a column, or a column and whether it
    ascends) whose summed cost stays within the budget."""
    run = numbered(rows, order, "__nth", cost, "cost_so_far")
    return run.filter(F.col("cost_so_far") <= budget).drop("__nth")


def retrieval_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row: recall_at_k, hit_at_k, mrr.  ``ranked(query, id, place)`` from 1, ``labels(query, id)``."""
    hit = labels.join(ranked, ["query", "id"], "left")
    each = hit.groupBy("query").agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.col("place") <= k).alias("found"), F.min("place").alias("first"))
    return each.agg(F.avg(F.col("found") / F.col("gold")).alias("recall_at_k"), F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)).alias("hit_at_k"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def auc(scored: DataFrame) -> DataFrame:
    """One row: area under the ROC curve of ``scored(score, label)``; ties count half, NULL if a class is empty.

    Rank sums over distinct scores, so only score histograms meet in a window.
    """
    h = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = h.withColumn("below", below).agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n"))).alias("auc"))
