"""Cross-branch content: authored lines, landing order, name history, struct layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.plans.ranking import numbered


def absent_lines(authored: DataFrame, head: DataFrame) -> DataFrame:
    """(ref, path, n_stray): authored lines(ref, path, line) that HEAD(path, line) lacks, as multisets."""
    a = authored.groupBy("ref", "path", "line").agg(F.count(F.lit(1)).alias("n"))
    h = head.groupBy("path", "line").agg(F.count(F.lit(1)).alias("m"))
    return a.join(h, ["path", "line"], "left").withColumn("gone", F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).groupBy("ref", "path").agg(F.sum("gone").alias("n_stray"), F.sum("n").alias("n_authored"))


def stray_verdict(rows: DataFrame) -> DataFrame:
    """``rows(…, n_stray, deleted, redone, touched, containment)`` with ``verdict``."""
    v = (
        F.when(F.col("n_stray") == 0, "merged")
        .when((F.col("deleted") > 0) & (F.col("redone") / F.col("deleted") >= 0.60), "superseded")
        .when((F.col("deleted") == 0) & F.col("touched") & (F.col("containment") >= 0.90) & (F.col("n_stray") >= 8), "superseded")
        .otherwise("unmerged")
    )
    return rows.withColumn("verdict", v)


def where_is(refs: DataFrame, tree: DataFrame, blobs: DataFrame, needle: str) -> DataFrame:
    """(ref, path, n_lines): ref trees whose blob mentions ``needle``; each blob is read once.
    ``tree(ref, path, sha)``, ``blobs(sha, text)``."""
    hit = blobs.dropDuplicates(["sha"]).filter(F.col("text").contains(needle)).select("sha", F.size(F.filter(F.split("text", "\n"), lambda s: s.contains(needle))).alias("n_lines"))
    return tree.join(refs.select("ref"), "ref", "left_semi").join(hit, "sha").select("ref", "path", "n_lines")


def conflicts(changed: DataFrame) -> DataFrame:
    """(a, b, symbols, files): arms that changed the same symbol; only-file overlaps are risks.
    ``changed(arm, file, symbol)``."""
    c = changed.select("arm", "file", "symbol").distinct()

    def met(on: list[str], count: str) -> DataFrame:
        each = c.select("arm", *on).distinct()
        return each.withColumnRenamed("arm", "a").join(each.withColumnRenamed("arm", "b"), on).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias(count))

    both = met(["file"], "files").join(met(["file", "symbol"], "symbols"), ["a", "b"], "left")
    return both.select("a", "b", F.coalesce("symbols", F.lit(0)).alias("symbols"), "files")


def landing_order(arms: list[str], clash: set[tuple[str, str]]) -> list[str]:
    """Repeatedly the arm that conflicts with the fewest remaining arms, ties by name."""
    left, out = sorted(set(arms)), []
    while left:
        best = min(left, key=lambda a: (sum((a, b) in clash or (b, a) in clash for b in left if b != a), a))
        out.append(best)
        left.remove(best)
    return out


def last_seen(removed: DataFrame) -> DataFrame:
    """(name, commit_id): newest commit that removed a line with the name.  ``removed(ordinal, commit_id, body)``,
    ordinal 1 is newest."""
    t = removed.select("ordinal", "commit_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("body"), F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))).alias("name"))
    return t.groupBy("name").agg(F.min_by("commit_id", "ordinal").alias("commit_id"))


def struct_layout(fields: DataFrame) -> DataFrame:
    """(agg, size, align, padding, offsets) of ``fields(agg, nth, name, size, align)``.

    Offsets are an ordered fold over each aggregate's own fields; an aggregate
    with a field of unknown size is not modelled (NULL).
    """
    f = fields.groupBy("agg").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "size", "align"))).alias("fs"))
    up = lambda n, a: F.ceil(n / a) * a
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(1).cast("long").alias("align"), F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("offs"))

    def step(s, x):
        at = up(s["end"], x["align"]).cast("long")
        return F.struct((at + x["size"]).cast("long").alias("end"), F.greatest(s["align"], x["align"].cast("long")).alias("align"), (s["used"] + x["size"]).cast("long").alias("used"), F.concat(s["offs"], F.array(at)).alias("offs"))

    known = F.forall("fs", lambda x: x["size"].isNotNull() & x["align"].isNotNull())
    done = f.withColumn("r", F.when(known, F.aggregate("fs", zero, step)))
    size = up(F.greatest(F.col("r.end"), F.lit(1)), F.col("r.align")).cast("long")
    return done.select("agg", size.alias("size"), F.col("r.align").alias("align"), (size - F.col("r.used")).alias("padding"), F.col("r.offs").alias("offsets"))


def mirror_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(agg, nth, left_name, right_name): same-named aggregates whose fields differ by ordinal."""
    both = left.select("agg", "nth", F.col("name").alias("left_name"), F.col("size").alias("ls")).join(right.select("agg", "nth", F.col("name").alias("right_name"), F.col("size").alias("rs")), ["agg", "nth"], "full")
    shared = left.select("agg").intersect(right.select("agg"))
    return both.join(shared, "agg", "left_semi").filter(~(F.col("left_name").eqNullSafe(F.col("right_name")) & F.col("ls").eqNullSafe(F.col("rs")))).select("agg", "nth", "left_name", "right_name")


def field_affinity(accesses: DataFrame, order: DataFrame) -> DataFrame:
    """(agg, a, b, together, weight): fields that functions use together, weighted by how far
    apart they lie: together * (64 - min(distance, 64)) / 64.
    ``accesses(fn, agg, field)``, ``order(agg, field, offset)``."""
    x = accesses.distinct()
    pairs = x.select("fn", "agg", F.col("field").alias("a")).join(x.select("fn", "agg", F.col("field").alias("b")), ["fn", "agg"]).filter("a < b").groupBy("agg", "a", "b").agg(F.count(F.lit(1)).alias("together"))
    o = order.select("agg", "field", "offset")
    j = pairs.join(o.select("agg", F.col("field").alias("a"), F.col("offset").alias("oa")), ["agg", "a"]).join(o.select("agg", F.col("field").alias("b"), F.col("offset").alias("ob")), ["agg", "b"])
    return j.select("agg", "a", "b", "together", (F.col("together") * (64 - F.least(F.abs(F.col("oa") - F.col("ob")), F.lit(64))) / 64).alias("weight"))


def gate_masters(links: DataFrame, defaults: DataFrame, levels: int = 8) -> DataFrame:
    """(gate, master, default): alias links(gate, target) followed up to ``levels`` steps; an
    alias inherits its master's default.  ``defaults(gate, default)``."""
    at = defaults.select("gate").unionByName(links.select("gate")).distinct().select("gate", F.col("gate").alias("master"))
    step = links.select(F.col("gate").alias("master"), "target").dropDuplicates(["master"])
    for _ in range(levels):
        at = at.join(step, "master", "left").select("gate", F.coalesce("target", "master").alias("master"))
    return at.join(defaults.select(F.col("gate").alias("master"), "default").dropDuplicates(["master"]), "master", "left").select("gate", "master", "default")


def newest_first_windows(commits: DataFrame, k: int = 3) -> DataFrame:
    """(commit_id, slot): equal-count windows by ordinal."""
    placed = numbered(commits.select("commit_id", "ordinal"), [F.col("ordinal"), F.col("commit_id")], "nth")
    n = commits.count()
    small, more = divmod(n, k)  # the first ``more`` windows hold one commit more
    edge = more * (small + 1)
    slot = F.when(F.col("nth") < edge, F.floor(F.col("nth") / (small + 1))).otherwise(F.lit(more) + F.floor((F.col("nth") - edge) / max(small, 1)))
    return placed.select("commit_id", (slot + 1).cast("int").alias("slot"))
