"""Clone detection on normalised token streams, and containment of blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvegraph.functions.text import pinned
from delvegraph.plans.staging import stage

# Words that stay verbatim in a normalised stream.
KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue def del do elif else enum except export extends false finally fn for from "
    "func function global goto if impl import in int interface is lambda let match new none not null or pass private public raise return self "
    "static struct super switch this throw true try type union use var void while with yield".split()
)
_SCAN = re.compile(r"""//[^\n]*|/\*.*?\*/|#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|\d[\w.]*|\S""", re.S)


def normal_tokens(code: str, hash_comments: bool = True) -> list[str]:
    """Identifiers become $I, numbers $N, strings $S; comments vanish."""
    out = []
    for t in _SCAN.findall(code):
        if t.startswith(("//", "/*")) or (t[0] == "#" and hash_comments and len(t) > 1):
            continue
        if t[0] in "\"'" and len(t) > 1:
            out.append("$S")
        elif t[0].isalpha() or t[0] == "_":
            out.append(t if t.lower() in KEYWORDS else "$I")
        elif t[0].isdigit():
            out.append("$N")
        else:
            out.append(t)
    return out


def token_streams(units: DataFrame, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """(id, stream): normalised tokens of each unit as an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "stream": [normal_tokens(c or "") for c in pdf["code"]]})

    src = units.select(F.col(id_col).alias("id"), F.col(code_col).alias("code"))
    return src.mapInPandas(run, f"id {dict(src.dtypes)['id']}, stream array<string>")


def exact_clones(streams: DataFrame, least: int = 18) -> DataFrame:
    """(stream_key, ids, n_tokens): units of equal streams of ``least`` tokens or more."""
    key = F.sha2(F.array_join("stream", "\x1f"), 256)
    return (
        streams.filter(F.size("stream") >= least)
        .groupBy(key.alias("stream_key"))
        .agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first(F.size("stream")).alias("n_tokens"))
        .filter(F.size("ids") > 1)
    )


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, one machine word of rows at a time."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for t in b:
        x = row | where.get(t, 0)
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def near_clones(streams: DataFrame, gram: int = 5, bucket: int = 1024, band: float = 0.70, least: float = 0.80, least_tokens: int = 18) -> DataFrame:
    """(a, b, ratio): pairs with 2 * LCS / (|a| + |b|) in [least, 1).

    Units of equal streams are compared once.  Pairs meet in buckets of shared token
    grams; a unit brings its rarest grams only, as many as make sure that it meets every
    unit that passes the gate.  Units of a gram of over ``bucket`` are compared block by
    block.  Cheap tests (length band, overlap of all grams) come before the LCS.
    """
    s = pinned(streams.select("id", "stream"), "stream").filter(F.size("stream") >= least_tokens).withColumn("n", F.size("stream"))
    s = stage(s.withColumn("key", F.sha2(F.to_json(F.struct("stream")), 256)))
    same = s.groupBy("key").agg(F.min("id").alias("first"))
    members = s.select("id", "key").join(same, "key").select("first", "id")
    s = s.join(same.select(F.col("first").alias("id")), "id", "left_semi")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - gram + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("stream", i, gram))))
    s = stage(s.select("id", "stream", "n", grams.alias("grams")))
    g = s.select("id", "n", F.explode("grams").alias("g"))
    g = g.join(g.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "g")
    # a pair in the length band shares this many grams at least, so one of them is in this prefix of both
    shared = F.greatest(F.ceil(0.25 * band * F.col("n") - gram - 1e-6), F.lit(1))
    rare = g.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("cg"))
    rare = rare.select("id", "n", F.explode(F.slice("cg", F.lit(1), F.greatest(F.size("cg") - shared + 1, F.lit(0)).cast("int"))).alias("x")).filter("x.c > 1")
    blocks = F.ceil(F.col("x.c") / bucket).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    each = rare.select("id", "n", F.col("x.g").alias("g"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("to"))
    each = each.select("id", "n", "g", "own", F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"))
    left = each.select("g", "p", "q", F.col("id").alias("a"), F.col("n").alias("na"), F.col("own").alias("oa"))
    right = each.select("g", "p", "q", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"))
    both = left.join(right, ["g", "p", "q"]).filter("a < b and (p = q or oa <> ob)").filter(F.least("na", "nb") >= band * F.greatest("na", "nb")).select("a", "b").distinct()
    side = lambda x: s.select(F.col("id").alias(x), F.col("stream").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}"))
    full = both.join(side("a"), "a").join(side("b"), "b").filter(F.size(F.array_intersect("ga", "gb")) >= 0.25 * F.least("na", "nb") - gram)

    @F.pandas_udf("double")
    def ratio(sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([2.0 * lcs_length(list(x), list(y)) / (len(x) + len(y)) for x, y in zip(sa, sb, strict=True)])

    near = full.select("a", "b", ratio("sa", "sb").alias("ratio")).filter((F.col("ratio") >= least) & (F.col("ratio") < 1))
    near = near.join(members.select(F.col("first").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("first").alias("b"), F.col("id").alias("y")), "b")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ratio")


def containment(left: DataFrame, right: DataFrame, shingle: int = 5, bottom: int | None = 128) -> DataFrame:
    """(a, b, containment): share of a's bottom hashes that b holds, for pairs that share one;
    without ``bottom``, of all its hashes.

    ``left(id, words)``, ``right(id, words)``.
    """

    def sketch(df: DataFrame, name: str) -> DataFrame:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - shingle + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, shingle)))
        return pinned(df.select("id", "words"), "words").filter(F.size("words") >= shingle).select(F.col("id").alias(name), (F.array_distinct(hashes) if bottom is None else F.slice(F.array_sort(F.array_distinct(hashes)), 1, bottom)).alias("s"))

    a = sketch(left, "a").select("a", F.size("s").alias("n"), F.explode("s").alias("h"))
    b = sketch(right, "b").select("b", F.explode("s").alias("h"))
    return a.join(b, "h").groupBy("a", "b").agg((F.count(F.lit(1)) / F.max("n")).alias("containment"))
