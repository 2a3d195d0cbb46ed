"""Code-quality aggregates, two-snapshot deltas and evidence ensembles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.functions.text import pinned

# Bar and minor step of each per-symbol kind (no minor step: None).
KINDS = {"ccx": (15, 3), "loc": (60, 10), "max_nest": (4, None), "params": (5, 2)}
#: Low-risk bounds of the delta maintainability model.
LOW_RISK = {"loc": 15, "cx": 5, "params": 2}


def delta(now: DataFrame, base: DataFrame, key: str = "canon") -> DataFrame:
    """(canon, kind, was, now, origin, minor): metrics that got worse and are over their bar.

    Both sides take the maximum over overloads; ``was`` is 0 for a new symbol,
    whose findings never gate (origin 'new-symbol').
    """
    top = lambda df, p: df.groupBy(key).agg(*(F.max(c).alias(f"{p}_{c}") for c in KINDS))
    both = top(now, "n").join(top(base, "b"), key, "full")
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("kind"),
                F.coalesce(f"b_{c}", F.lit(0)).cast("long").alias("was"),
                F.coalesce(f"n_{c}", F.lit(0)).cast("long").alias("now"),
                F.lit(bar).alias("bar"),
                (F.coalesce(f"n_{c}", F.lit(0)) - F.coalesce(f"b_{c}", F.lit(0)) < (minor or 0)).alias("minor"),
            )
            for c, (bar, minor) in KINDS.items()
        )
    )
    new = F.greatest(*(F.col(f"b_{c}").isNotNull().cast("int") for c in KINDS)) == 0
    out = both.withColumn("origin", F.when(new, "new-symbol").otherwise("preexisting-worse")).select(key, "origin", F.explode(rows).alias("r"))
    return out.select(key, "r.kind", "r.was", "r.now", "origin", "r.minor").filter("now > was").join(
        F.broadcast(out.sparkSession.createDataFrame([(k, v[0]) for k, v in KINDS.items()], "kind string, bar int")), "kind"
    ).filter("now > bar").drop("bar")


# A helper is reused from so many callers on; a file is churned from so many commits in the short window on.
REUSED_FANIN, CHURNED_COMMITS = 3, 2


def relational_delta(now: DataFrame, base: DataFrame, calls_now: DataFrame, calls_base: DataFrame, clones_now: DataFrame, clones_base: DataFrame, key: str = "canon") -> DataFrame:
    """(canon, kind, was, now, origin): what got worse between symbols, beside the kinds of ``delta``.

    dead-code: an internal symbol nobody calls now that was called, or was not there.
    duplication: a clone group that was not there; new-clone-of-reused-helper: one
    that holds an older member with enough callers.  api-surface: newly public, or
    public with other parameters.  error-masking: more masked errors.
    short-horizon-churn: an older body rewritten in a file with enough recent commits.

    Sides: (canon, params, public, internal, masks, body, commits), one row for each
    symbol; calls (src, dst); clones (canon, grp, tokens).  A group is its set of
    members, and its canon their names joined; it is preexisting-worse if any member was there.
    """
    n, b = now.alias("n"), base.select(key, "params", "public", "masks", "body").alias("b")
    both = n.join(b, key, "left")
    there = F.col("b.params").isNotNull()
    origin = F.when(there, "preexisting-worse").otherwise("new-symbol")
    callers = calls_now.select(F.col("dst").alias(key)).distinct()
    called = calls_base.select(F.col("dst").alias(key), F.lit(True).alias("called")).distinct()
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame, kind: str, was: Column, value: Column, from_: Column = origin) -> DataFrame:
        return df.select(F.col(key).cast("string").alias(key), F.lit(kind).alias("kind"), was.cast("long").alias("was"), value.cast("long").alias("now"), from_.alias("origin"))

    dead = both.filter("n.internal").join(callers, key, "left_anti").join(called, key, "left").filter(~there | F.col("called"))
    public = both.filter("n.public").filter(~there | ~F.col("b.public") | (F.col("n.params") != F.col("b.params")))
    changed = there & F.col("b.public")
    masked = both.filter(F.col("n.masks") > F.coalesce("b.masks", F.lit(0)))
    churned = both.filter(there & (F.col("n.body") != F.col("b.body")) & (F.col("n.commits") >= CHURNED_COMMITS))

    fan = calls_now.groupBy(F.col("dst").alias(key)).agg(F.countDistinct("src").alias("fan"))
    old = base.select(key, F.lit(True).alias("old"))
    members = lambda c: c.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda x: x.cast("string")), ",").alias("set"), F.max("tokens").alias("tokens"), F.countDistinct(key).alias("m")).filter("m > 1")
    fresh = members(clones_now).join(members(clones_base).select("set"), "set", "left_anti")
    known = clones_now.select("grp", key).distinct().join(old, key).join(fan, key, "left").groupBy("grp").agg(F.lit(True).alias("older"), F.max(F.coalesce("fan", F.lit(0))).alias("fan"))
    groups = fresh.join(known, "grp", "left").withColumnRenamed("set", key)
    group_origin = F.when(F.coalesce("older", F.lit(False)), "preexisting-worse").otherwise("new-symbol")
    return (
        rows(dead, "dead-code", zero, zero)
        .unionByName(rows(public, "api-surface", F.when(changed, F.col("b.params")).otherwise(zero), F.when(changed, F.col("n.params")).otherwise(zero)))
        .unionByName(rows(masked, "error-masking", F.coalesce("b.masks", F.lit(0)), F.col("n.masks")))
        .unionByName(rows(churned, "short-horizon-churn", zero, F.col("n.commits")))
        .unionByName(rows(groups, "duplication", zero, F.col("tokens"), group_origin))
        .unionByName(rows(groups.filter(F.col("fan") >= REUSED_FANIN), "new-clone-of-reused-helper", zero, F.col("fan"), group_origin))
    )


def without_acks(findings: DataFrame, acks: DataFrame, key: str = "canon") -> DataFrame:
    """Findings that no acknowledgement (canon, kind) covers."""
    return findings.join(acks.select(key, "kind").distinct(), [key, "kind"], "left_anti")


def dmm(now: DataFrame, base: DataFrame, key: str = "canon") -> DataFrame:
    """One row: size, complexity and interface scores: good change over all change.

    Volume that moves into low-risk units or out of high-risk ones is good.  NULL
    where no volume changed.
    """
    parts = []
    for c, bound in LOW_RISK.items():
        low = lambda df, n: df.groupBy().agg(F.coalesce(F.sum(F.when(F.col(c) <= bound, F.col("loc")).otherwise(0)), F.lit(0)).alias(f"{n}_low"), F.coalesce(F.sum(F.when(F.col(c) > bound, F.col("loc")).otherwise(0)), F.lit(0)).alias(f"{n}_high"))  # noqa: E731, B023
        both = low(now, "n").crossJoin(low(base, "b"))  # one row each
        up, risk = F.col("n_low") - F.col("b_low"), F.col("n_high") - F.col("b_high")
        good = F.greatest(up, F.lit(0)) + F.greatest(-risk, F.lit(0))
        bad = F.greatest(risk, F.lit(0)) + F.greatest(-up, F.lit(0))
        parts.append(both.select(F.when(good + bad > 0, good / (good + bad)).alias({"loc": "size", "cx": "complexity", "params": "interface"}[c])))
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def readability(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, volume, entropy, score): sigmoid of 8.87 - 0.033 V + 0.40 L - 1.5 E.

    V = N log2(distinct), E the byte entropy of the tokens.  ``tokens(id, token)``,
    ``lines(id, n_lines)``.
    """
    counts = tokens.groupBy("id", "token").agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy("id")
    p = F.col("c") / F.sum("c").over(total)
    each = counts.withColumn("h", -p * F.log2(p)).groupBy("id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("eta"), F.sum("h").alias("entropy"))
    v = F.col("n") * F.log2(F.col("eta").cast("double"))
    z = 8.87 - 0.033 * v + 0.40 * F.col("n_lines") - 1.5 * F.col("entropy")
    return each.join(lines, "id").select("id", v.alias("volume"), "entropy", (1 / (1 + F.exp(-z))).alias("score"))


def coupling(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cbo): distinct callees and member types not already callees.  ``calls(id, to)``, ``members(id, to)``."""
    return calls.select("id", "to").unionByName(members.select("id", "to")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("cbo"))


def lcom4(methods: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """(cls, lcom4): components of a class's methods joined by shared fields or calls.

    ``methods(cls, method)``, ``uses(cls, method, field)``, ``calls(cls, a, b)``.
    NULL for classes without methods.  A class is a bounded group; a task runs through
    the sorted rows of many.
    """
    import pyarrow as pa

    rows = (
        methods.select(F.col("cls").cast("string").alias("cls"), F.col("method").alias("a"), F.lit(None).cast("string").alias("b"))
        .unionByName(uses.select(F.col("cls").cast("string").alias("cls"), F.col("method").alias("a"), F.concat(F.lit("field:"), "field").alias("b")))
        .unionByName(calls.select(F.col("cls").cast("string").alias("cls"), "a", "b"))
    )

    def run(batches):
        parent: dict = {}
        own: list = []
        now, begun = None, False

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            out: list = []
            for cls, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or cls != now:
                    if begun:
                        out.append((now, len({find(m) for m in own}) or None))
                        parent, own = {}, []
                    now, begun = cls, True
                if b is None:
                    find(a)
                    own.append(a)
                else:
                    parent[find(a)] = find(b)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["cls", "lcom4"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([len({find(m) for m in own}) or None], pa.int64())], names=["cls", "lcom4"])

    return rows.repartition("cls").sortWithinPartitions("cls").mapInArrow(run, "cls string, lcom4 long")


def naming_vote(names: DataFrame, least: int = 20, share: float = 0.90) -> DataFrame:
    """(lang, kind, votes, style, agreement, verdict) over ``names(lang, kind, style)``;
    style and agreement are NULL below the floors."""
    v = names.filter("style is not null").groupBy("lang", "kind", "style").agg(F.count(F.lit(1)).alias("n"))
    t = v.groupBy("lang", "kind").agg(F.sum("n").alias("votes"), F.max_by("style", F.struct("n", F.negative(F.ascii("style")))).alias("top"), F.max("n").alias("m"))
    verdict = F.when(F.col("votes") < least, "insufficient-sample").when(F.col("m") / F.col("votes") < share, "no-clear-convention").otherwise("convention")
    t = t.withColumn("verdict", verdict)
    ok = F.col("verdict") == "convention"
    return t.select("lang", "kind", "votes", F.when(ok, F.col("top")).alias("style"), F.when(ok, F.col("m") / F.col("votes")).alias("agreement"), "verdict")


def confusable_names(names: DataFrame, most: int = 1) -> DataFrame:
    """(scope, a, b, distance) of names of one scope within ``most`` edits, a < b.

    Names are joined on a deletion neighbourhood (the name with up to ``most``
    characters left out), so only near names ever meet.
    """
    if most > 2:
        raise ValueError("names more than two edits apart are no confusables")
    n = names.select("scope", "name").distinct()
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    keyed = n.withColumn("ks", F.array(F.col("name")))
    for _ in range(most):
        keyed = keyed.withColumn("ks", F.array_distinct(F.concat("ks", F.flatten(F.transform("ks", lambda x: F.when(F.length(x) > 0, without(x)).otherwise(F.array(x)))))))
    keyed = keyed.withColumn("k", F.explode("ks")).select("scope", "name", "k")
    pairs = keyed.select("scope", "k", F.col("name").alias("a")).join(keyed.select("scope", "k", F.col("name").alias("b")), ["scope", "k"]).filter("a < b").select("scope", "a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)


def comment_coherence(rows: DataFrame) -> DataFrame:
    """(id, c_coeff, cic) of ``rows(id, name_words, comment_words)`` (arrays): the share of
    comment words within one edit of a name word, and the Jaccard index of the
    distinct words; NULL without comment or name words."""
    rows = pinned(pinned(rows.select("id", "name_words", "comment_words"), "name_words"), "comment_words")
    near = F.filter("comment_words", lambda w: F.exists("name_words", lambda n: F.levenshtein(w, n) <= 1))
    ok = (F.size("comment_words") > 0) & (F.size("name_words") > 0)
    a, b = F.array_distinct("comment_words"), F.array_distinct("name_words")
    return rows.select("id", F.when(ok, F.size(near) / F.size("comment_words")).alias("c_coeff"), F.when(ok, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("cic"))


def worst_decile(rows: DataFrame, value: str, tie: str, most: int = 40) -> DataFrame:
    """The worst tenth of ``rows`` by ``value``, one row at least (if any) and ``most`` at most."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    ranked = rows.orderBy(F.desc(value), tie).limit(most).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(value), tie)))
    return ranked.crossJoin(F.broadcast(n)).filter(F.col("_r") <= F.least(F.lit(most), F.ceil(F.col("_n") / 10))).drop("_r", "_n")


def ensemble(findings: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, families, n_families): distinct evidence families for each id, never a weighted score."""
    each = None
    for family, df in findings:
        one = df.select("id", F.lit(family).alias("family")).distinct()
        each = one if each is None else each.unionByName(one)
    return each.groupBy("id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.countDistinct("family").alias("n_families"))


def context_ratio(uses: DataFrame, weight: Column | None = None) -> DataFrame:
    """(id, outside_tokens, outside, total_tokens, ratio) of ``uses(id, file, def_id, def_file, tokens)``:
    how much of what a symbol reads lies outside its file."""
    return _ratio(uses.select("id", "file", "def_id", "def_file", "tokens").distinct())


def context_ratio_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``context_ratio`` of what ``edges(src, dst)`` over ``symbols(id, file, tokens)`` read: edges and
    symbols are told apart before they meet, so the wide rows of their join need not be."""
    s = symbols.select("id", "file", "tokens").distinct()
    user = s.select(F.col("id").alias("src"), "file").distinct().hint("shuffle_hash")
    used = s.select(F.col("id").alias("dst"), F.col("file").alias("def_file"), "tokens").hint("shuffle_hash")
    return _ratio(edges.select("src", "dst").distinct().join(used, "dst").join(user, "src").withColumnRenamed("src", "id"))


def _ratio(d: DataFrame) -> DataFrame:
    out = F.col("file") != F.col("def_file")
    t = d.groupBy("id").agg(F.sum(F.when(out, F.col("tokens")).otherwise(0)).alias("outside_tokens"), F.count_if(out).alias("outside"), F.sum("tokens").alias("total_tokens"))
    return t.withColumn("ratio", F.when(F.col("total_tokens") > 0, F.col("outside_tokens") / F.col("total_tokens")))


def edit_check(now: DataFrame, head: DataFrame, key: str = "canon") -> DataFrame:
    """(canon, verdict): new-symbol, contract-change (parameters, publicness or number of
    definitions differ) or unchanged.  Sides: (canon, params, public)."""
    g = lambda df, p: df.groupBy(key).agg(F.max("params").alias(f"{p}p"), F.max("public").alias(f"{p}u"), F.count(F.lit(1)).alias(f"{p}n"))
    both = g(now, "n").join(g(head, "h"), key, "left")
    same = (F.col("np") == F.col("hp")) & (F.col("nu") == F.col("hu")) & (F.col("nn") == F.col("hn"))
    return both.select(key, F.when(F.col("hn").isNull(), "new-symbol").when(same, "unchanged").otherwise("contract-change").alias("verdict"))


def propagate_bits(edges: DataFrame, access: DataFrame) -> DataFrame:
    """(id, cell, reads, writes): accesses (id, cell, reads, writes) carried from callee to caller to a fixpoint.

    A row of the loop holds the bits of up to 63 cells of a symbol; a round carries only
    what the last one changed, over edges held by their callee.
    """
    from delvegraph.plans.ranking import numbered
    from delvegraph.plans.staging import hold, stage, unstage

    kinds = dict(access.dtypes)
    held = stage(access.groupBy("id", "cell").agg(F.max("reads").cast("int").alias("reads"), F.max("writes").cast("int").alias("writes")), "bits")
    codes = stage(numbered(held.select("cell").distinct(), [F.col("cell")], "code"), "cells")
    links = hold(edges.filter("src <> dst").select("src", "dst").distinct(), "dst")
    at = lambda flag: F.bit_or(F.when(flag, F.expr("shiftleft(1L, cast(code % 63 as int))")).otherwise(F.lit(0).cast("long")))
    flags = {"there": F.lit(True), "r0": F.col("reads").isNotNull(), "r1": F.col("reads") > 0, "w0": F.col("writes").isNotNull(), "w1": F.col("writes") > 0}
    coded = held.join(codes.withColumnRenamed("cell", "of"), F.col("cell").eqNullSafe(F.col("of")))
    state = stage(coded.groupBy("id", F.floor(F.col("code") / 63).alias("block")).agg(*(at(c).alias(k) for k, c in flags.items())).withColumn("new", F.lit(True)), "bits")
    zero = F.lit(0).cast("long")
    while state.measured["rows"]:
        front = state.filter("new").select(F.col("id").alias("dst"), "block", *flags)
        up = links.join(front, "dst").groupBy(F.col("src").alias("id"), "block").agg(*(F.bit_or(k).alias(f"up_{k}") for k in flags))
        both = {k: F.coalesce(F.col(k), zero).bitwiseOR(F.coalesce(F.col(f"up_{k}"), zero)) for k in flags}
        changed = functools.reduce(lambda a, b: a | b, (both[k] != F.coalesce(F.col(k), zero) for k in flags))
        new = stage(state.drop("new").join(up, ["id", "block"], "full").select("id", "block", *(c.alias(k) for k, c in both.items()), changed.alias("new")), "bits", moved=F.count_if("new"))
        unstage(state)
        state = new
        if not state.measured["moved"]:
            break
    links.unpersist()
    bit = lambda k: F.expr(f"shiftright({k}, pos) & 1L = 1L")
    each = state.select("id", "block", *flags, F.explode(F.sequence(F.lit(0), F.lit(62))).alias("pos")).filter(bit("there"))
    value = lambda k, kind: F.when(bit(f"{k}1"), 1).when(bit(f"{k}0"), 0).cast(kind)
    out = each.select("id", (F.col("block") * 63 + F.col("pos")).alias("code"), value("r", kinds["reads"]).alias("reads"), value("w", kinds["writes"]).alias("writes"))
    return out.join(codes, "code").select("id", "cell", "reads", "writes")


def module_metrics(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, ca, ce, instability, abstractness, distance, zone) of ``edges(src, dst)`` over
    ``symbols(id, module, abstract)``; NULL instability without coupling."""
    m = symbols.select("id", "module")
    e = edges.join(m.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst").filter("a <> b").select("a", "b").distinct()
    ca = e.groupBy(F.col("b").alias("module")).agg(F.count(F.lit(1)).alias("ca"))
    ce = e.groupBy(F.col("a").alias("module")).agg(F.count(F.lit(1)).alias("ce"))
    base = symbols.groupBy("module").agg(F.avg(F.col("abstract").cast("int")).alias("abstractness"))
    t = base.join(ca, "module", "left").join(ce, "module", "left").fillna(0, ["ca", "ce"])
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce")))
    d = F.abs(F.col("abstractness") + i - 1)
    zone = F.when(d > 0.5, F.when(F.col("abstractness") + i < 1, "pain").otherwise("uselessness")).when(d.isNotNull(), "main")
    return t.select("module", "ca", "ce", i.alias("instability"), "abstractness", d.alias("distance"), zone.alias("zone"))


def rule_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(src_path, dst_path, rule) of path edges that a deny rule matches and no allow rule does.
    ``rules(rule, verdict, src_rx, dst_rx)`` is a small table."""
    hit = edges.join(F.broadcast(rules), F.expr("src_path rlike src_rx and dst_path rlike dst_rx"))
    allowed = hit.filter("verdict = 'allow'").select("src_path", "dst_path").distinct()
    return hit.filter("verdict = 'deny'").join(allowed, ["src_path", "dst_path"], "left_anti").select("src_path", "dst_path", "rule").distinct()


def dead_code(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols (id, internal, ...) of internal linkage that nothing calls."""
    return symbols.filter("internal").join(edges.filter("src <> dst").select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
