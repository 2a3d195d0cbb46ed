"""Bundles for a task or a change, and the joins that feed them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.operators import graph as G
from delvegraph.operators.retrieval import within_budget
from delvegraph.plans.fanout import each_with
from delvegraph.plans.staging import stage


def inheritance(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(base, derived): extends references joined to class-like definitions."""
    base = symbols.filter(F.col("kind").isin("cls", "struct", "iface")).select(F.col("sym_id").alias("base"), F.col("name").alias("callee"), "lang")
    derived = refs.filter("role = 'extends' and from_sym is not null").select(F.col("from_sym").alias("derived"), "callee", "lang")
    return each_with(derived, base, ["callee", "lang"], "base").filter("base <> derived").select("base", "derived")


def class_cone(inherits: DataFrame, cls: DataFrame) -> DataFrame:
    """(id): a class (id), its ancestors and its descendants, but no siblings."""
    e = stage(inherits.select(F.col("derived").alias("src"), F.col("base").alias("dst")).distinct(), "inherits")
    return cls.select("id").union(G.reach(e, cls, forward=True).select("id")).union(G.reach(e, cls, forward=False).select("id")).distinct()


def members(fields: DataFrame, symbols: DataFrame) -> DataFrame:
    """(owner, member): field types (owner, type_name) joined to classes."""
    c = symbols.filter(F.col("kind").isin("cls", "struct", "iface")).select(F.col("sym_id").alias("member"), F.col("name").alias("type_name"))
    return each_with(fields.select("owner", "type_name"), c, ["type_name"], "member").filter("owner <> member").select("owner", "member")


def use_sites(refs: DataFrame, name: str) -> DataFrame:
    """All references to a name with their roles, in a total order."""
    return refs.filter(F.col("callee") == name).orderBy("file", "line", "role", "ref_id")


def foreign_edges(refs: DataFrame, resolved: DataFrame, aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, src, dst, conf): references without a target joined through foreign-function
    aliases(alias, target, low_conf); 0.2, or 0.1 for weak ones.  ``resolved(ref_id)`` may be
    ``resolve.targets`` or ``resolve.resolve``."""
    left = refs.join(resolved.select("ref_id").distinct(), "ref_id", "left_anti")
    to = aliases.join(symbols.select(F.col("sym_id").alias("dst"), F.col("name").alias("target")), "target")
    return left.join(to, left["callee"] == to["alias"]).select("ref_id", F.col("from_sym").alias("src"), "dst", F.when(F.col("low_conf"), 0.1).otherwise(0.2).alias("conf")).distinct()


def jni_alias(name: Column) -> Column:
    """Method name of a Java native symbol; NULL for other names."""
    return F.when(name.startswith("Java_"), F.replace(F.regexp_extract(F.regexp_replace(name, "_1", "\x01"), "_([^_]+)$", 1), F.lit("\x01"), F.lit("_")))


def impure(symbols: DataFrame, edges: DataFrame, io_names: str = r"(?i)^(print|write|read|open|send|recv|log|exec|system|connect)") -> DataFrame:
    """(id): symbols with an I/O-like name and all that call them."""
    seed = symbols.filter(F.col("name").rlike(io_names)).select("id")
    return seed.union(G.reach(edges, seed, forward=False).select("id")).distinct()


def public_api(name: Column, lang: Column) -> Column:
    """Public by convention: no leading underscore, capitalised in Go."""
    return F.when(lang == "go", name.rlike("^[A-Z]")).otherwise(~name.startswith("_"))


def rank_by(nodes: DataFrame, edges: DataFrame, how: str, prior: DataFrame | None = None) -> DataFrame:
    """(id, score) by pagerank, authority, hub, rrf (of the three) or churn (a pagerank with that prior)."""
    if how in ("pagerank", "churn"):
        return G.personalized_pagerank(nodes, edges, prior).select("id", F.col("rank").alias("score"))
    if how in ("authority", "hub"):
        return G.hits(nodes, edges).select("id", F.col(how).alias("score"))
    if how == "rrf":
        h = G.hits(nodes, edges)
        return G.fused_rank([rank_by(nodes, edges, "pagerank", prior), h.select("id", F.col("authority").alias("score")), h.select("id", F.col("hub").alias("score"))])
    raise ValueError(f"no ranking {how}")


def anchored_rank(nodes: DataFrame, edges: DataFrame, scores: DataFrame, seeds: int = 20, share: float = 0.30) -> DataFrame:
    """Lexical scores blended with a pagerank that starts from the best of them."""
    top = scores.orderBy(F.desc("score"), "id").limit(seeds)
    prior = top.crossJoin(F.broadcast(top.agg(F.sum("score").alias("t")))).select("id", (F.col("score") / F.col("t")).alias("p"))
    return G.blended(scores, G.personalized_pagerank(nodes, edges, prior).select("id", F.col("rank").alias("score")), share)


def doc_mention_boost(scores: DataFrame, mentions: DataFrame, anchors: int = 8, each: int = 2, most: int = 6, share: float = 0.55) -> DataFrame:
    """Documents (mentions(id, sym_id)) of the top anchors join at a share of their score."""
    top = scores.orderBy(F.desc("score"), "id").limit(anchors).select(F.col("id").alias("sym_id"), F.col("score").alias("s"))
    hit = mentions.join(F.broadcast(top), "sym_id").withColumn("k", F.row_number().over(Window.partitionBy("sym_id").orderBy("id"))).filter(F.col("k") <= each)
    lift = hit.groupBy("id").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "id").limit(most).select("id", (F.col("s") * share).alias("lift"))
    return scores.join(lift, "id", "full").select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("lift", F.lit(0.0))).alias("score"))


def cochange_boost(scores: DataFrame, files: DataFrame, pairs: DataFrame, seeds: int = 3, most_files: int = 8, per_file: int = 3) -> DataFrame:
    """Symbols of the seeds' co-change partners gain 0.25 * degree * the weakest seed's score, kept below it.
    ``files(id, file)``, ``pairs(a, b, conf_a, conf_b)``."""
    top = scores.orderBy(F.desc("score"), "id").limit(seeds).join(files, "id")
    floor = top.agg(F.min("score").alias("floor"))
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("to"), F.col("conf_a").alias("deg")).unionByName(pairs.select(F.col("b").alias("file"), F.col("a").alias("to"), F.col("conf_b").alias("deg")))
    near = both.join(F.broadcast(top.select("file").distinct()), "file").groupBy(F.col("to").alias("file")).agg(F.max("deg").alias("deg")).orderBy(F.desc("deg"), "file").limit(most_files)
    cand = files.join(F.broadcast(near), "file").join(scores, "id", "left").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc_nulls_last("score"), "id"))).filter(F.col("k") <= per_file)
    lift = cand.crossJoin(F.broadcast(floor)).select("id", F.least(F.coalesce("score", F.lit(0.0)) + 0.25 * F.col("deg") * F.col("floor"), F.col("floor") * 0.999).alias("lift"))
    return scores.join(lift, "id", "full").select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("lift", F.lit(0.0))).alias("score"))


def exemplar(nodes: DataFrame, edges: DataFrame, kind: str, ceiling: int = 60) -> DataFrame:
    """The one symbol to imitate: of the kind, under the complexity ceiling (if any is),
    not a fixture, tested, most called, simplest, shortest, smallest id.
    ``nodes(id, name, kind, file, ccx, loc)``."""
    from delvegraph.operators.testgate import tested

    fan = G.fan(edges).select("id", "fan_in")
    cand = nodes.filter(F.col("kind") == kind).join(fan, "id", "left").join(tested(nodes, edges).withColumn("t", F.lit(1)), "id", "left")
    over = (F.col("ccx") > ceiling).cast("int")
    fixture = G.is_test_path(F.col("file")).cast("int")
    return cand.orderBy(over, fixture, F.desc(F.coalesce("t", F.lit(0))), F.desc(F.coalesce("fan_in", F.lit(0))), "ccx", "loc", "id").limit(1).drop("t")


_SELECTOR = re.compile(r"(?:(?P<file>[^:]+):)?(?:(?P<line>\d+):)?(?P<name>[A-Za-z_][\w.]*)(?::(?P<a>\d+)-(?P<b>\d+))?$")


def select_bodies(symbols: DataFrame, files: DataFrame, selector: str) -> DataFrame:
    """(sym_id, file, name, body) of NAME, FILE:NAME, FILE:LINE:NAME or NAME:A-B (lines of the body)."""
    m = _SELECTOR.match(selector)
    if not m:
        raise G.AmbiguousName(f"no selector {selector}")
    s = symbols.filter(F.col("name") == m["name"])
    if m["file"]:
        s = s.filter(F.col("file").endswith(m["file"]))
    if m["line"]:
        s = s.filter(F.col("line") == int(m["line"]))
    body = F.substring("content", F.col("start") + 1, F.col("stop") - F.col("start")).cast("string")
    out = s.join(files.select(F.col("path").alias("file"), F.col("content").cast("binary").alias("content")), "file").select("sym_id", "file", "name", body.alias("body"))
    if m["a"]:
        a, b = int(m["a"]), int(m["b"])
        out = out.withColumn("body", F.array_join(F.slice(F.split("body", "\n"), a, max(0, b - a + 1)), "\n"))
    return out


def signatures(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(sym_id, signature): the declaration up to its opening brace or colon, on one line."""
    body = F.substring("content", F.col("start") + 1, F.col("stop") - F.col("start")).cast("string")
    head = F.regexp_extract(body, r"(?s)^(.*?)(?:\{|:\s*(?:\n|$)|;|$)", 1)
    return symbols.join(files.select(F.col("path").alias("file"), F.col("content").cast("binary").alias("content")), "file").select("sym_id", F.trim(F.regexp_replace(head, r"\s+", " ")).alias("signature"))


def compress(code: Column) -> Column:
    """Code without whole-line comments and with runs of blank lines as one."""
    kept = F.filter(F.split(code, "\n"), lambda s: ~s.rlike(r"^\s*(//|#(?!\s*(include|define|if|endif|else|pragma))|--)"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n\s*\n\s*(\n\s*)+", "\n\n")


def task_bundle(ranked: DataFrame, sizes: DataFrame, budget: int = 6000, shares: tuple[float, ...] = (0.45, 0.30)) -> DataFrame:
    """(section, id, place, cost_so_far): a ranked list and the bodies of its best, each
    section within its share of the budget.  ``ranked(id, place)``, ``sizes(id, list_cost, body_cost)``."""
    rows = ranked.join(sizes, "id")
    parts = [within_budget(rows.withColumn("section", F.lit(name)), [F.col("place")], F.col(cost), budget * share).select("section", "id", "place", "cost_so_far") for name, cost, share in zip(("ranking", "bodies"), ("list_cost", "body_cost"), shares, strict=True)]
    return parts[0].unionByName(parts[1])


def partition_bins(sizes: DataFrame, communities: DataFrame, bins: int, core_share: float = 0.34) -> DataFrame:
    """(id, bin): the most shared part (bin -1, ``sizes(id, size, shared)``) and communities packed into bins."""
    from delvegraph.operators.kernels import pack_bins

    total = sizes.agg(F.sum("size")).first()[0] or 0
    core = within_budget(sizes, [(F.col("shared"), False), F.col("id")], F.col("size"), core_share * total).select("id", F.lit(-1).alias("bin"))
    rest = sizes.join(core, "id", "left_anti").join(communities, "id")
    groups = [(r["community"], r["s"]) for r in rest.groupBy("community").agg(F.sum("size").alias("s")).collect()]  # one row a community
    table = sizes.sparkSession.createDataFrame([(int(c), int(b)) for c, b in pack_bins(groups, bins).items()] or [(-1, 0)], "community int, bin int")
    return core.unionByName(rest.join(F.broadcast(table), "community").select("id", "bin"))


def situation(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, role, hop): changed symbols, their direct callers, and the wider radius."""
    r = G.reach(edges, changed, forward=False)
    return changed.select("id", F.lit("changed").alias("role"), F.lit(0).alias("hop")).unionByName(r.select("id", F.when(F.col("hop") == 1, "caller").otherwise("radius").alias("role"), "hop")).join(nodes.select("id"), "id", "left_semi")


def with_notes(rows: DataFrame, notes: DataFrame, key: str = "canon") -> DataFrame:
    """Rows with their field notes, newest first; notes without a target are dangling and absent."""
    at = F.struct((-F.unix_date("date")).alias("age"), "date", "text")  # sorted as it is, newest first: a comparator would have to tell equal notes apart
    sorted_ = F.sort_array(F.collect_list(at))
    n = notes.groupBy(F.col("target").alias(key)).agg(F.transform(sorted_, lambda x: F.struct(x["date"].alias("date"), x["text"].alias("text"))).alias("notes"))
    return rows.join(n, key, "left")


def heat(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """Findings (name, ...) with calls and total_ms of the profile's scope; NULL is not measured."""
    return findings.join(profile.groupBy(F.col("scope").alias("name")).agg(F.sum("calls").alias("calls"), F.sum("total_ms").alias("total_ms")), "name", "left")


def abi_drift(now: DataFrame, head: DataFrame) -> DataFrame:
    """(agg, verdict): layouts (agg, size, align, offsets) that differ; NULL sizes are not modelled."""
    j = now.alias("n").join(head.alias("h"), "agg", "full")
    v = (
        F.when(F.col("h.offsets").isNull() & F.col("h.size").isNull(), "added")
        .when(F.col("n.offsets").isNull() & F.col("n.size").isNull(), "removed")
        .when(~F.col("n.offsets").eqNullSafe(F.col("h.offsets")), "fields-moved")
        .when(F.col("n.size") != F.col("h.size"), "size-changed")
    )
    return j.select("agg", v.alias("verdict")).filter("verdict is not null")


def flip_radius(edges: DataFrame, guarded: DataFrame, gate: str) -> DataFrame:
    """(id, hop): what a gate's guarded symbols(gate, id) reach, callers and hop counted."""
    seed = guarded.filter(F.col("gate") == gate).select("id")
    return seed.withColumn("hop", F.lit(0)).unionByName(G.reach(edges, seed, forward=False))


def rename_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old, new, n): names swapped on paired lines(hunk, nth, body) that differ in one word."""
    w = lambda df, n: df.select("hunk", "nth", F.regexp_extract_all(F.col("body"), F.lit(r"[A-Za-z_]\w*"), F.lit(0)).alias(n), F.regexp_replace("body", r"[A-Za-z_]\w*", "_").alias(n + "s"))
    j = w(removed, "a").join(w(added, "b"), ["hunk", "nth"]).filter((F.size("a") == F.size("b")) & (F.col("as") == F.col("bs")))
    d = j.select(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"] != x["b"]).alias("d")).filter(F.size(F.array_distinct("d")) == 1)
    return d.select(F.col("d")[0]["a"].alias("old"), F.col("d")[0]["b"].alias("new")).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def name_shape(name: Column) -> Column:
    """The naming rules a name breaks: short, wordy, double-underscore, mixed-style."""
    from delvegraph.functions.text import identifier_words

    core = F.regexp_replace(name, "^_+|_+$", "")
    rules = F.array(
        F.when(F.length(core) <= 2, F.lit("short")),
        F.when(F.size(identifier_words(core)) > 5, F.lit("wordy")),
        F.when(core.rlike(r"[A-Za-z0-9]__[A-Za-z0-9]"), F.lit("double-underscore")),
        F.when(core.rlike("_") & core.rlike("[a-z][A-Z]"), F.lit("mixed-style")),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def git_changed(numstat: DataFrame) -> DataFrame:
    """(path) of ``git diff --numstat`` lines(value): mode-only rows (0, 0) are out, renames give the new path."""
    t = F.split("value", "\t")
    new = F.regexp_replace(F.regexp_replace(t[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    return numstat.filter((F.size(t) >= 3) & ~((t[0] == "0") & (t[1] == "0"))).select(F.regexp_replace(new, "//+", "/").alias("path")).distinct()
