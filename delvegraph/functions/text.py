"""String functions built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def subtokens(text: Column) -> Column:
    """Lower-cased ASCII subtokens of two bytes or more; every capital begins one,
    so a run of capitals leaves only what follows its last letter."""
    parts = F.regexp_extract_all(text, F.lit("[A-Z]?[a-z0-9]+"), F.lit(0))
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 2)


def identifier_words(name: Column) -> Column:
    """Words of a snake_case or camelCase name."""
    cut = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda s: s != "")


def case_style(name: Column) -> Column:
    """snake, screaming, camel, pascal or NULL for names without a case signal."""
    return (
        F.when(name.rlike("^_*[a-z0-9]+(_[a-z0-9]+)+_*$"), "snake")
        .when(name.rlike("^_*[A-Z0-9]+(_[A-Z0-9]+)+_*$"), "screaming")
        .when(name.rlike("^_*[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel")
        .when(name.rlike("^_*([A-Z][a-z0-9]+){2,}$"), "pascal")
    )


def escape_xml(text: Column) -> Column:
    out = text
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def normal_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, no ./ segments, no leading slash."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), "^/", "")


def utf8_prefix(text: Column, n_bytes: int) -> Column:
    """The longest prefix of whole characters within ``n_bytes`` bytes."""
    low = F.aggregate(
        F.slice(F.split(text, ""), 1, n_bytes),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, c: F.when(a["open"] & (a["n"] + F.octet_length(c) <= n_bytes), F.struct(F.concat(a["s"], c).alias("s"), (a["n"] + F.octet_length(c)).alias("n"), F.lit(True).alias("open"))).otherwise(
            F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(False).alias("open"))
        ),
        lambda a: a["s"],
    )
    return F.when(F.octet_length(text) <= n_bytes, text).otherwise(low)


def token_estimate(n_bytes: Column, lang: Column) -> Column:
    """Tokens by the bytes that one takes in each language."""
    rate = F.when(lang.isin("md", "txt"), 4.0).when(lang.isin("json", "csv"), 2.8).otherwise(3.2)
    return F.ceil(n_bytes / rate).cast("long")


def nearest_names(names: DataFrame, wanted: str, most: int = 1, bound: int = 3) -> list[str]:
    """The closest names within ``bound`` edits, by (distance, name)."""
    near = names.distinct().withColumn("d", F.levenshtein("name", F.lit(wanted), bound)).filter("d >= 0").orderBy("d", "name").limit(most)
    return [r["name"] for r in near.collect()]


def pinned(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` computed once for each row.

    A projection that uses a column inside a lambda would otherwise have the
    column's whole expression copied into the lambda and run for every element;
    a generator of one row keeps the two projections apart.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(column)).alias(column))


def register_functions(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION subtokens(x STRING) RETURNS ARRAY<STRING> "
        "RETURN filter(transform(regexp_extract_all(x, '[A-Z]?[a-z0-9]+', 0), t -> lower(t)), t -> length(t) >= 2)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION escape_xml(x STRING) RETURNS STRING RETURN replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")
