"""Secret scanning over an incremental, content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger holds one row per (blob, rule, rule version) that was ever scanned with
the spans found there, none included.  A run scans only the pairs the ledger
does not know and joins all findings back to every path.  DataFrame functions
only; text is moved once, one row per distinct blob and task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delvegraph.llm.storage import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match then has to
    hold ``min_length`` characters in its group ``group`` (0: the whole)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_length: int = 1
    base: bool = True


# The three base rules and their lengths.
ASSIGN = Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]{14,}")
HEX = Rule("hex", 1, r"[0-9a-f]{16,}")
# Spans that this scanner adds to the base ones.
PEM = Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False)
FORGE = Rule("forge", 1, r"(?:gh[posur]_|github_pat_)[A-Za-z0-9_]{20,}", base=False)
CHAT = Rule("chat", 1, r"xox[baprs]-[A-Za-z0-9-]{10,}", base=False)
RULES = (ASSIGN, ACCESS, HEX, PEM, FORGE, CHAT)

SPAN = "array<struct<start:int,stop:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPAN}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


#: Elements of an array that are run through at a time.
RUN = 256


def running(x: Column, op, zero: int = 0) -> Column:
    """``op`` of each element of an array of ints and all before it.

    Arrays cannot grow in place, so the array goes in runs: a long one costs
    about ``RUN / 2`` copies for each element, not one for each pair of elements.
    """

    def inside(run: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, v: Column) -> Column:
            now = op(acc["at"], v).cast("int")
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(run, start, step, lambda acc: acc["out"])

    def whole(a: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda k: F.slice(a, k * RUN + 1, RUN))

        def joined(cut: Column) -> Column:
            of_each = F.transform(cut, lambda r: F.aggregate(r, F.lit(zero), lambda acc, v: op(acc, v).cast("int")))
            before = F.concat(F.array(F.lit(zero)), inside(of_each, F.lit(zero)))
            return F.flatten(F.zip_with(cut, F.slice(before, 1, F.size(cut)), inside))

        return F.when(F.size(a) > 0, _let(runs, joined)).otherwise(F.array().cast("array<int>"))

    return _let(x, whole)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of ``rule`` in code points, end exclusive, in order; none for a null or empty text.

    The pieces between matches and the matches alternate, so their running
    lengths are the positions.  A text without a match is read once.
    """
    shown = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    found = F.struct(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("n"), (shown(m) >= rule.min_length).alias("ok"))).alias("hit"),
    )

    def spans(s: Column) -> Column:
        stops = running(F.zip_with(F.slice(s["gap"], 1, F.size(s["hit"])), s["hit"], lambda gap, h: gap + h["n"]), lambda a, b: a + b)
        each = F.zip_with(s["hit"], stops, lambda h, stop: F.when(h["ok"], F.struct((stop - h["n"]).alias("start"), stop.alias("stop"))))
        return F.filter(each, lambda x: x.isNotNull()).cast(SPAN)

    return F.when(text.rlike(rule.pattern), _let(found, spans)).otherwise(F.array().cast(SPAN))


def scan_new_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule, version) pairs that ``ledger`` lacks.

    ``versions`` has ``blob`` and ``text``; equal blobs are scanned once.  Without
    versions, or with a ledger that knows all, there are no rows.
    """
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        todo = {r.kind: F.lit(True) for r in rules}
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("known"))
        blobs = blobs.join(known, "blob", "left")
        todo = {r.kind: ~F.coalesce(F.array_contains("known", f"{r.kind}@{r.version}"), F.lit(False)) for r in rules}
    found = F.array(
        *(
            F.when(todo[r.kind], F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), rule_spans(F.col("text"), r).alias("spans")))
            for r in rules
        )
    )
    return blobs.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule", "f.version", "f.spans")


def blob_hits(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, hits) of the blobs in which one of ``rules`` found something.

    Ledger rows that repeat, of other rules, or without spans (null or empty) add nothing.
    """
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}@{r.version}"), F.lit(i))))
    return (
        ledger.filter(F.size("spans") > 0)
        .dropDuplicates(["blob", "rule", "version"])
        .withColumn("ord", ranks[F.concat_ws("@", "rule", "version")])
        .filter(F.col("ord").isNotNull())
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("ord").alias("ord"), s["stop"].alias("stop"), F.col("rule").alias("kind"))).alias("hit"))
        .groupBy("blob")  # at most one row for each rule
        .agg(F.array_sort(F.flatten(F.collect_list("hit"))).alias("hits"))
    )


def versions_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text) of every row; null text is the empty blob."""
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), F.sha2(content.cast("binary"), 256).alias("blob"), content.alias("text"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each version: path, blob and hits, an array of (start, ord, stop, kind)
    sorted by start and then by the rules' order, from what the ledger knows of its blob."""
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")
    hits = materialize(blob_hits(ledger, rules), "hits")  # a side that is a plain exchange lets a blob of many paths be split
    return versions.select("path", "blob").join(hits, "blob", "left").select("path", "blob", F.coalesce("hits", none).alias("hits"))


class Ledger:
    """A ledger kept as a table at ``path`` in a folder that the cluster shares.

    A commit reads it, scans the pairs of blob and rule version that it lacks,
    and appends them; scanning the same content again appends nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """Its rows, or None before the first commit."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def commit(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        scan_new_blobs(versions, self.rows(), rules).write.mode("append").parquet(self.path)


def scan_history(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings by path, new ledger rows); the new rows are written, so that appending
    them to a ledger does not scan again.

    Null text is the empty blob; rows with equal paths are versions and each
    gets its row; an empty table gives empty results.
    """
    versions = versions_of(docs, path_col, text_col)
    fresh = materialize(scan_new_blobs(versions, ledger, rules), "ledger")
    current = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "version", "spans"))
    return findings(versions, current, rules), fresh


def span_text(hits: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:stop`` of the hits (of some kinds), joined by commas."""
    kept = hits if kinds is None else F.filter(hits, lambda h: h["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda h: F.concat_ws(":", h["kind"], h["start"], h["stop"])), ",")


def mask_hits(text: Column, hits: Column) -> Column:
    """``text`` with every hit replaced by ``[REDACTED:kind]``; null stays null.

    Hits come sorted by start.  One that starts inside text already replaced
    only lengthens what is removed.
    """
    wide = "utf-32"  # four bytes for each code point, so that a part is found without reading what is before it
    lead = F.lit("x")  # keeps a mark of byte order at the start of a part a character like others

    def masked(x: Column) -> Column:
        part = lambda a, n: F.substring(F.decode(F.concat(F.encode(lead, wide), F.substring(x["raw"], a * 4 + 1, n * 4)), wide), F.lit(2), n)
        until = running(F.transform(x["hits"], lambda h: h["stop"]), F.greatest)
        ends = F.concat(F.array(F.lit(0)), F.slice(until, 1, F.size(until) - 1))  # where what came before a hit ends
        each = F.zip_with(x["hits"], ends, lambda h, end: F.when(h["start"] >= end, F.concat(part(end, h["start"] - end), F.lit("[REDACTED:"), h["kind"], F.lit("]"))))
        return F.concat(F.array_join(F.filter(each, lambda p: p.isNotNull()), ""), _let(F.array_max(until), lambda end: part(end, F.length(x["raw"]))))

    some = F.struct(F.encode(text, wide).alias("raw"), hits.alias("hits"))
    return F.when(F.size(hits) > 0, _let(some, masked)).otherwise(text)
