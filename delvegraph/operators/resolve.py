"""Reference resolution: call sites joined to definitions by a priority ladder.

``symbols(sym_id, name, scope, file, dir, lang, params, arity_exact)`` and
``refs(ref_id, from_sym, file, dir, lang, callee, arg_count)``.  Every prune keeps
a reference's candidates when it would leave none.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.plans.spans import best_span
from delvegraph.plans.staging import stage

OVERCOMMON = 16
#: Languages that call each other directly share a family.
FAMILIES = {"cpp": "c", "c": "c", "objc": "c"}


def lang_family(lang: Column) -> Column:
    return F.when(lang.isin(*FAMILIES), "c").otherwise(lang)


def _prune(cands: DataFrame, keep: Column) -> DataFrame:
    """Rows where ``keep`` holds, or all rows of a reference's words where it holds for none."""
    some = F.max(F.when(keep, 1).otherwise(0)).over(Window.partitionBy("words"))
    return cands.withColumn("_keep", keep).withColumn("_some", some).filter((F.col("_some") == 0) | F.col("_keep")).drop("_keep", "_some")


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def shared_prefix(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share."""
    pairs = F.zip_with(_segments(a), _segments(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def _worded(refs: DataFrame, *hints: str) -> DataFrame:
    """(ref_id, src, words): references with all that their resolution depends on."""
    return refs.select("ref_id", F.col("from_sym").alias("src"), F.struct("callee", lang_family(F.col("lang")).alias("family"), "file", "dir", "arg_count", *hints).alias("words"))


def _classes(symbols: DataFrame, *more: str) -> DataFrame:
    """One row for the definitions that no step can tell apart, with their ids (``dsts``):
    same name, file and parameters."""
    s = symbols.select(F.col("sym_id").alias("dst"), "name", lang_family(F.col("lang")).alias("family"), F.col("file").alias("d_file"), F.col("dir").alias("d_dir"), "params", "arity_exact", *more)
    each = s.groupBy("name", "family", "d_file", "d_dir", "params", "arity_exact", *more).agg(F.collect_list("dst").alias("dsts"))
    return stage(each.withColumns({"n": F.size("dsts"), "cls": F.monotonically_increasing_id()}), "classes")


def _chosen(c: DataFrame) -> DataFrame:
    """(words, cls, conf, k) of the candidates that arity and the longest shared path leave."""
    by_words = Window.partitionBy("words")
    c = _prune(c, ~F.coalesce(F.col("arity_exact") & (F.col("words.arg_count") > F.col("params")), F.lit(False)))
    c = c.withColumn("near", shared_prefix(F.col("words.file"), F.col("d_file"))).withColumn("top", F.max("near").over(by_words))
    conf = F.when(F.col("step") == 1, 1.0).when(F.col("step") == 2, 0.5).otherwise(0.2)
    return c.filter("near = top").select("words", "cls", "step", conf.alias("conf"), F.sum("n").over(by_words).alias("k"))


def _ladder(words: DataFrame, classes: DataFrame) -> DataFrame:
    """(words, cls, conf, k): the ladder of ``resolve`` for each distinct words."""
    s = classes.drop("dsts")
    r = words.select("words", F.col("words.callee").alias("name"), F.col("words.family").alias("family"), F.col("words.file").alias("r_file"), F.col("words.dir").alias("r_dir"))
    # the narrow joins come first, so that a common name meets all its definitions only for what is left
    near = r.join(s.withColumn("r_file", F.col("d_file")), ["name", "family", "r_file"]).withColumn("step", F.lit(1))
    rest = r.join(near.select("words").distinct(), "words", "left_anti")
    beside = rest.join(s.withColumn("r_dir", F.col("d_dir")), ["name", "family", "r_dir"]).withColumn("step", F.lit(2))
    rest = rest.join(beside.select("words").distinct(), "words", "left_anti")
    far = rest.join(s, ["name", "family"]).withColumn("step", F.lit(3))
    cols = ["words", "cls", "d_file", "params", "arity_exact", "n", "step"]
    c = _chosen(near.select(*cols).unionByName(beside.select(*cols)).unionByName(far.select(*cols)))
    return c.filter((F.col("step") < 3) | (F.col("k") == 1)).drop("step")


def targets(refs: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ref_id, src, cls, conf, k), classes): ``resolve`` with a row for each class of
    definitions that no step can tell apart, for whoever needs no pairs.

    References of the same words (name, place, arguments) resolve alike, so the ladder is
    climbed once for each.
    """
    classes = _classes(symbols)
    r = _worded(refs)
    words = stage(r.select("words").distinct(), "words")
    return r.join(_ladder(words, classes).hint("merge"), "words").select("ref_id", "src", "cls", "conf", "k"), classes


def expanded(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``found(cls, ...)`` with the definitions (dst) of its classes; pairs are made last and dealt to nobody."""
    return found.join(classes.select("cls", "dsts").hint("merge"), "cls").withColumn("dst", F.explode("dsts")).drop("cls", "dsts")


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, src, dst, conf, k): each resolved reference split over its k targets.

    Ladder: same file (1.0), same directory (0.5), a unique definition anywhere
    (0.2); otherwise the reference has no target.  An exact arity below the
    argument count is excluded while another candidate remains; ties go to the
    longest shared path prefix.
    """
    return expanded(*targets(refs, symbols)).select("ref_id", "src", "dst", "conf", "k")


def class_cones(inherits: DataFrame) -> DataFrame:
    """(type, member): every class of ``inherits(derived, base)`` with itself, its ancestors and
    its descendants; siblings are no part of each other's cone."""
    step = inherits.filter("derived <> base").select("derived", "base").distinct()
    up = stage(step.select(F.col("derived").alias("type"), F.col("base").alias("member")), "cone")
    front = up
    while True:
        new = stage(front.join(step, F.col("member") == F.col("derived")).select("type", F.col("base").alias("member")).filter("type <> member").distinct().join(up, ["type", "member"], "left_anti"), "cone")
        if not new.measured["rows"]:
            break
        up, front = up.unionByName(new), new
    own = step.select(F.col("derived").alias("type")).union(step.select("base")).distinct().select("type", F.col("type").alias("member"))
    return own.unionByName(up).unionByName(up.select(F.col("member").alias("type"), F.col("type").alias("member"))).distinct()


def scoped_candidates(words: DataFrame, scopes: DataFrame, cones: DataFrame) -> DataFrame:
    """(words, name, family, scope): the scopes that a reference's own words single out.

    The first of these that holds any: scopes named by the ``qualifier``; the
    caller's own scope (``self_scope``, for this, self or a bare member); the scope
    of the receiver's type (``recv_type``); classes above or below that type.
    ``scopes(name, family, scope)`` hold definitions; ``cones(type, member)``.
    """
    r = words.select("words", F.col("words.callee").alias("name"), F.col("words.family").alias("family"), *(F.col(f"words.{c}").alias(c) for c in ("qualifier", "self_scope", "recv_type")))
    own = scopes.select("name", "family", "scope").distinct()
    # a qualifier names a scope that it is, or that ends with it after ::
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length("scope") - 1, F.lit(1))), lambda i: F.substring(F.col("scope"), i, F.lit(2)) == "::"), lambda i: F.substring(F.col("scope"), i + 2, F.length("scope")))
    ways = [
        own.select("name", "family", "scope", F.explode(F.array_distinct(F.concat(F.array("scope"), ends))).alias("qualifier")),
        own.withColumn("self_scope", F.col("scope")),
        own.withColumn("recv_type", F.col("scope")),
        own.join(cones.select(F.col("type").alias("recv_type"), F.col("member").alias("scope")), "scope"),
    ]
    keys = ["qualifier", "self_scope", "recv_type", "recv_type"]
    each = [r.join(way, ["name", "family", key]).select("words", "name", "family", "scope", F.lit(nth).alias("rank")) for nth, (way, key) in enumerate(zip(ways, keys, strict=True), 1)]
    held = functools.reduce(DataFrame.unionByName, each).withColumn("top", F.min("rank").over(Window.partitionBy("words")))
    return held.filter("rank = top").select("words", "name", "family", "scope").distinct()


def resolve_scoped(refs: DataFrame, symbols: DataFrame, cones: DataFrame) -> DataFrame:
    """``resolve`` where a reference that its own words single out chooses among those
    definitions only: nearest file, then arity, then the longest shared path; it has a
    target even if it is not the only one far away."""
    classes = _classes(symbols, "scope")
    r = _worded(refs, "qualifier", "self_scope", "recv_type")
    words = stage(r.select("words").distinct(), "words")
    allowed = stage(scoped_candidates(words, classes, cones), "allowed")
    rest = _ladder(words.join(allowed.select("words").distinct(), "words", "left_anti"), classes)
    step = F.when(F.col("words.file") == F.col("d_file"), 1).when(F.col("words.dir") == F.col("d_dir"), 2).otherwise(3)
    c = allowed.join(classes.drop("dsts"), ["name", "family", "scope"]).withColumn("step", step)
    c = c.withColumn("first", F.min("step").over(Window.partitionBy("words"))).filter("step = first")
    found = _chosen(c).drop("step").unionByName(rest)
    return expanded(r.join(found.hint("merge"), "words"), classes).select("ref_id", "src", "dst", "conf", "k")


def weighted_resolution(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``weighted_edges`` of ``resolve``, summed by class of definitions before the pairs are made."""
    found, classes = targets(refs, symbols)
    defs = classes.groupBy("name").agg(F.sum("n").alias("defs"))
    damp = classes.select("cls", "name").join(defs, "name").select("cls", _damp().alias("damp"))
    e = found.filter("src is not null").groupBy("src", "cls").agg(F.count(F.lit(1)).alias("n_ref"), F.sum(F.col("conf") / F.col("k")).alias("c"), F.max((F.col("k") > 1).cast("int")).alias("amb"))
    e = e.join(damp, "cls").select("src", "cls", "n_ref", (F.least(F.col("c") / F.col("n_ref") * F.sqrt("n_ref"), F.lit(8.0)) * F.col("damp")).alias("w"), "amb")
    return expanded(e, classes).filter("src <> dst").select("src", "dst", "n_ref", "w", "amb")


def _damp() -> Column:
    return F.when(F.col("defs") >= OVERCOMMON, 0.1).otherwise(1.0) * F.when(F.col("name").startswith("_"), 0.1).otherwise(1.0)


def weighted_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, n_ref, w, amb): w = mean confidence * sqrt(references), capped at 8,
    a tenth for over-common names and a tenth for private names."""
    defs = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("defs"))
    damp = symbols.join(defs, "name").select(F.col("sym_id").alias("dst"), _damp().alias("damp"))
    e = resolved.filter("src is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_ref"), F.sum(F.col("conf") / F.col("k")).alias("c"), F.max((F.col("k") > 1).cast("int")).alias("amb"))
    return e.join(damp, "dst").select("src", "dst", "n_ref", (F.least(F.col("c") / F.col("n_ref") * F.sqrt("n_ref"), F.lit(8.0)) * F.col("damp")).alias("w"), "amb")


def gauges(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(from_sym, amb, unresolved): references of each symbol with several targets, and with none.
    ``resolved(ref_id, k)`` may be ``targets`` or ``resolve``."""
    k = resolved.groupBy("ref_id").agg(F.max("k").alias("k"))
    return refs.join(k, "ref_id", "left").groupBy("from_sym").agg(F.count_if(F.col("k") > 1).alias("amb"), F.count_if(F.col("k").isNull()).alias("unresolved"))


def external_surface(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(callee, lang, n_refs): names used and never defined."""
    return refs.join(symbols.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti").groupBy("callee", "lang").agg(F.count(F.lit(1)).alias("n_refs"))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(point_id, file, at, ...)`` with ``sym_id`` of the innermost span (file, start,
    stop) that holds them, NULL where none does.  ``point_id`` tells the points apart."""
    if "point_id" not in points.columns:
        raise ValueError("points need a point_id")
    inner = best_span(points, spans, "file", F.struct("start", "sym_id")).select(F.col("file").alias("_f"), F.col("at").alias("_at"), F.col("best.sym_id").alias("sym_id"))
    return points.join(inner, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_at")), "left").drop("_f", "_at")


def include_edges(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(src_file, dst_file, n_occ): an include goes to the file whose path ends with its
    target, next to the includer first, then the shortest path."""
    cand = includes.withColumn("base", F.element_at(F.split("target", "/"), -1)).join(
        files.select(F.col("path").alias("dst_file"), F.element_at(F.split("path", "/"), -1).alias("base")), "base"
    ).filter((F.col("dst_file") == F.col("target")) | F.col("dst_file").endswith(F.concat(F.lit("/"), F.col("target"))))
    rank = F.row_number().over(Window.partitionBy("include_id").orderBy(F.desc(shared_prefix(F.col("src_file"), F.col("dst_file"))), F.length("dst_file"), "dst_file"))
    return cand.withColumn("r", rank).filter("r = 1 and src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("n_occ"))


def route_edges(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(use_id, def_id): client calls joined to server templates.

    ``defs(def_id, method, template)``, ``uses(use_id, method, path)``.  Equal segment
    counts, {x} and :x match any segment, an unknown method matches all; a use
    with more than one distinct handler has no edge.
    """
    d = defs.withColumn("ds", F.split(F.trim(F.col("template"), F.lit("/")), "/")).withColumn("n", F.size("ds")).withColumnRenamed("method", "dm")
    u = uses.withColumn("us", F.split(F.trim(F.col("path"), F.lit("/")), "/")).withColumn("n", F.size("us")).withColumnRenamed("method", "um")
    ok = F.forall(F.zip_with("ds", "us", lambda a, b: (a == b) | a.rlike(r"^(\{.*\}|:.+)$")), lambda x: x)
    hit = d.join(u, "n").filter(ok & (F.col("dm").isNull() | F.col("um").isNull() | (F.col("dm") == F.col("um"))))
    one = hit.groupBy("use_id").agg(F.countDistinct("def_id").alias("k"), F.min("def_id").alias("def_id")).filter("k = 1")
    return one.select("use_id", "def_id")
