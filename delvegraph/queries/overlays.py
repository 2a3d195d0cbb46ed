"""Joins that overlay a resolved graph, sources read from lines, and what history adds."""

from __future__ import annotations

from pyspark.sql import functions as F

from delvegraph.operators import bundles as B
from delvegraph.operators import graph as G
from delvegraph.operators import history as H
from delvegraph.operators import quality, resolve, retrieval, search
from delvegraph.operators import text as D
from delvegraph.plans.spans import best_span
from delvegraph.queries.graph import _rank_sql
from delvegraph.queries.history import _RES, _references
from delvegraph.queries.registry import COMMITS, GRAPH, NODES, commit_files, commits, edges, nodes, query, rounded, table
from delvegraph.queries.text import _docs
from delvegraph.sources import precise

_CLASSES = "kind IN ('cls', 'struct', 'iface')"


def _symbols(spark, sf):
    return nodes(spark, sf).select(F.col("id").alias("sym_id"), "name", "kind", "file", F.lit("python").alias("lang"))


# ---------------------------------------------------------------- joins over references


@query(f"{_RES} SELECT DISTINCT b.id AS base, rf.src AS derived FROM rf JOIN nodes b ON b.name = rf.name AND b.{_CLASSES} WHERE b.id <> rf.src")
def inheritance_edges(spark, sf):
    refs, _ = _references(spark, sf)
    return B.inheritance(refs.withColumn("role", F.lit("extends")), _symbols(spark, sf))


@query(f"{_RES} SELECT DISTINCT rf.src AS owner, c.id AS member FROM rf JOIN nodes c ON c.name = rf.name AND c.{_CLASSES} WHERE c.id <> rf.src")
def member_types(spark, sf):
    refs, _ = _references(spark, sf)
    return B.members(refs.select(F.col("from_sym").alias("owner"), F.col("callee").alias("type_name")), _symbols(spark, sf))


@query(f"{_RES} SELECT r_file AS file, event_id AS line, event_type AS role, ref_id FROM rf JOIN events ON event_id = ref_id WHERE name = 'red widget'")
def name_use_sites(spark, sf):
    refs, _ = _references(spark, sf)
    ev = table(spark, sf, "events").select(F.col("event_id").alias("ref_id"), F.col("event_id").alias("line"), F.col("event_type").alias("role"))
    return B.use_sites(refs.join(ev, "ref_id"), "red widget").select("file", "line", "role", "ref_id")


@query(
    f"{_RES}, al AS (SELECT name AS alias, lead(name) OVER (ORDER BY name) AS target, length(name) % 2 = 0 AS weak FROM (SELECT DISTINCT name FROM nodes)) "
    "SELECT DISTINCT rf.ref_id, rf.src, n.id AS dst, CASE WHEN weak THEN 0.1 ELSE 0.2 END::DOUBLE AS conf FROM rf JOIN al ON al.alias = rf.name JOIN nodes n ON n.name = al.target AND n.kind = 'fn' WHERE rf.ref_id NOT IN (SELECT ref_id FROM res)"
)
def foreign_alias_edges(spark, sf):
    from pyspark.sql import Window

    refs, symbols = _references(spark, sf)
    names = nodes(spark, sf).select("name").distinct()  # 64 names
    aliases = names.select(F.col("name").alias("alias"), F.lead("name").over(Window.orderBy("name")).alias("target"), (F.length("name") % 2 == 0).alias("low_conf"))
    return B.foreign_edges(refs, resolve.targets(refs, symbols)[0], aliases, _symbols(spark, sf).filter("kind = 'fn'"))


@query(
    f"{_RES}, pin AS (SELECT rf.ref_id, rf.src, (rf.ref_id * 7) % (SELECT count(*) FROM nodes) AS dst FROM rf WHERE rf.ref_id % 3 = 0) "
    "SELECT ref_id, src, dst, 1.0::DOUBLE AS conf, 1::BIGINT AS k FROM pin UNION ALL SELECT ref_id, src, dst, conf, k FROM res WHERE ref_id NOT IN (SELECT ref_id FROM pin)"
)
def precise_overlay(spark, sf):
    refs, symbols = _references(spark, sf)
    placed = refs.withColumn("line", F.col("ref_id"))
    total = nodes(spark, sf).count()
    pins = placed.filter("ref_id % 3 = 0").select("file", "line", ((F.col("ref_id") * 7) % total).alias("to_sym"))
    found, classes = resolve.targets(refs, symbols)
    return precise.overlay(found, placed, pins, classes).select("ref_id", "src", "dst", "conf", "k")


@query(
    f"WITH {NODES}, inc AS (SELECT e.event_id, a.file AS src, regexp_extract(b.file, '[^/]*$') AS base FROM events e JOIN nodes a ON a.id = (e.user_id * 31) % (SELECT count(*) FROM nodes) JOIN nodes b ON b.id = (e.event_id * 17) % (SELECT count(*) FROM nodes)), f AS (SELECT DISTINCT file FROM nodes) "
    "SELECT src AS src_file, f.file AS dst_file, count(*) AS n_occ FROM inc JOIN f ON regexp_extract(f.file, '[^/]*$') = base WHERE src <> f.file GROUP BY 1, 2"
)
def include_graph(spark, sf):
    n = nodes(spark, sf)
    total = n.count()
    ev = table(spark, sf, "events").select(F.col("event_id").alias("include_id"), ((F.col("user_id") * 31) % total).alias("a"), ((F.col("event_id") * 17) % total).alias("b"))
    inc = ev.join(n.select(F.col("id").alias("a"), F.col("file").alias("src_file")), "a").join(n.select(F.col("id").alias("b"), F.element_at(F.split("file", "/"), -1).alias("target")), "b")
    return resolve.include_edges(inc.select("include_id", "src_file", "target"), n.select(F.col("file").alias("path")).distinct())


@query("SELECT p_partkey AS id, replace(p_name, ' ', '_') AS method FROM part")
def native_method_names(spark, sf):
    native = F.concat(F.lit("Java_com_x_1y_Calls_"), F.replace("p_name", F.lit(" "), F.lit("_1")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), B.jni_alias(native).alias("method"))


# Scopes C0 to C9 form a tree: Ck is derived from C(k // 2).
_CONES = "up(t, m) AS (SELECT k, k FROM range(10) q(k) UNION SELECT t, m // 2 FROM up WHERE m > 0), cone AS (SELECT t, m FROM up UNION SELECT m, t FROM up)"


@query(
    _RES.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", {_CONES}, h AS (SELECT rf.*, ref_id % 4 AS way, ref_id % 10 AS q FROM rf), cand AS (SELECT h.*, sy.dst, sy.d_file, sy.d_dir, sy.params, sy.ax, sy.dst % 10 AS sc FROM h JOIN sy USING (name)), "
    "rk AS (SELECT *, CASE WHEN way = 0 AND sc = q THEN 1 WHEN way = 1 AND sc = src % 10 THEN 2 WHEN way = 2 AND sc = q THEN 3 WHEN way = 2 AND (q, sc) IN (SELECT (t, m) FROM cone) THEN 4 END AS rank FROM cand), "
    "al AS (SELECT * FROM (SELECT * FROM rk WHERE rank IS NOT NULL) QUALIFY rank = min(rank) OVER (PARTITION BY ref_id)), s1 AS (SELECT *, CASE WHEN r_file = d_file THEN 1 WHEN r_dir = d_dir THEN 2 ELSE 3 END AS step FROM al), s2 AS (SELECT * FROM s1 QUALIFY step = min(step) OVER (PARTITION BY ref_id)), "
    "s3 AS (SELECT *, NOT (ax AND args > params) AS ok FROM s2), s4 AS (SELECT * FROM s3 QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY ref_id)), s5 AS (SELECT *, CASE WHEN r_file = d_file THEN 2 WHEN r_dir = d_dir THEN 1 ELSE 0 END AS near FROM s4), s6 AS (SELECT * FROM s5 QUALIFY near = max(near) OVER (PARTITION BY ref_id)) "
    "SELECT ref_id, src, dst, CASE step WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.2 END::DOUBLE AS conf, count(*) OVER (PARTITION BY ref_id) AS k FROM s6 UNION ALL SELECT ref_id, src, dst, conf, k FROM res WHERE ref_id NOT IN (SELECT ref_id FROM al)"
)
def scoped_resolution(spark, sf):
    refs, symbols = _references(spark, sf)
    scope = lambda c: F.concat(F.lit("C"), (c % 10).cast("string"))
    way = F.col("ref_id") % 4
    hinted = refs.withColumns({"qualifier": F.when(way == 0, scope(F.col("ref_id"))), "self_scope": F.when(way == 1, scope(F.col("from_sym"))), "recv_type": F.when(way == 2, scope(F.col("ref_id")))})
    tree = spark.createDataFrame([(f"C{k}", f"C{k // 2}") for k in range(1, 10)], "derived string, base string")
    return resolve.resolve_scoped(hinted, symbols.withColumn("scope", scope(F.col("sym_id"))), resolve.class_cones(tree))


# ---------------------------------------------------------------- ranks


_TOP = "SELECT id, coalesce(s / sum(s) OVER (), 0)::DOUBLE AS p FROM (SELECT nodes.id, t.s FROM nodes LEFT JOIN (SELECT id, cx::DOUBLE AS s FROM nodes WHERE cx >= 40 ORDER BY cx DESC, id LIMIT 20) t ON t.id = nodes.id)"


@query(
    f"WITH pr AS ({_rank_sql(_TOP).replace('round(rank, 9)', 'rank')}), lx AS (SELECT p_partkey AS id, p_size::DOUBLE AS score FROM part WHERE p_size >= 40) "
    "SELECT pr.id, round(0.7::DOUBLE * coalesce(lx.score, 0) / (SELECT max(score) FROM lx) + 0.3::DOUBLE * pr.rank / (SELECT max(rank) FROM pr), 6) AS score FROM pr LEFT JOIN lx USING (id)"
)
def anchored_scores(spark, sf):
    n = nodes(spark, sf)
    return rounded(B.anchored_rank(n, edges(spark, sf), n.filter("cx >= 40").select("id", F.col("cx").cast("double").alias("score"))), "score")


@query(f"{GRAPH}, r(id, hop) AS (SELECT id, 0 FROM nodes WHERE file = 'src/brand7.py' AND kind = 'iface' UNION SELECT e.src, r.hop + 1 FROM r JOIN edges e ON e.dst = r.id WHERE r.hop < 40) SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id")
def gate_flip_radius(spark, sf):
    n = nodes(spark, sf)
    return B.flip_radius(edges(spark, sf), n.filter("kind = 'iface'").select(F.col("file").alias("gate"), "id"), "src/brand7.py")


_TERMS3 = (
    "toks AS (SELECT doc_id AS id, 3 AS w, lower(unnest(regexp_extract_all(source, '[A-Z]?[a-z0-9]+'))) AS term FROM documents UNION ALL SELECT doc_id, 2, lower(unnest(regexp_extract_all(lang, '[A-Z]?[a-z0-9]+'))) FROM documents "
    "UNION ALL SELECT doc_id, 1, lower(unnest(regexp_extract_all(text, '[A-Z]?[a-z0-9]+'))) FROM documents), post AS (SELECT term, id, sum(w)::BIGINT AS tf FROM toks WHERE length(term) >= 2 GROUP BY 1, 2)"
)


@query(
    f"WITH {_TERMS3}, dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id), cst AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl), "
    "asked AS (SELECT * FROM (VALUES ('src1', 1), ('license', 1), ('fr', 1), ('the', 1)) v(term, times)), df AS (SELECT term, count(*) AS d FROM post WHERE term IN (SELECT term FROM asked) GROUP BY term) "
    "SELECT id, round(sum(times * ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN df USING (term) JOIN dl USING (id), cst GROUP BY id"
)
def bm25_weighted_fields(spark, sf):
    return rounded(retrieval.score_documents(_docs(spark, sf), {"source": 3, "lang": 2, "text": 1}, "src1 license fr the"), "score")


@query("WITH a AS (SELECT DISTINCT p_type AS scope, p_name AS name FROM part) SELECT x.scope, x.name AS a, y.name AS b, levenshtein(x.name, y.name)::INTEGER AS distance FROM a x JOIN a y ON x.scope = y.scope AND x.name < y.name AND levenshtein(x.name, y.name) <= 2")
def confusable_names_two_edits(spark, sf):
    return quality.confusable_names(table(spark, sf, "part").select(F.col("p_type").alias("scope"), F.col("p_name").alias("name")), most=2)


_LINES = "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"


@query(f"SELECT id, line::INTEGER AS line, body FROM ({_LINES}) WHERE regexp_matches(body, '(?i)(licen[sc]e|copyright)|token = \"[0-9a-f]+')")
def grep_alternatives(spark, sf):
    return search.grep(_docs(spark, sf), '(?i)(licen[sc]e|copyright)|token = "[0-9a-f]+')


@query(f"SELECT id, line::INTEGER AS line, body FROM ({_LINES}) WHERE regexp_matches(body, '(license|warranty|token = )[^a-z]*[a-z\"]')")
def grep_literal_sets(spark, sf):
    return search.grep(_docs(spark, sf), '(license|warranty|token = )[^a-z]*[a-z"]')


# ---------------------------------------------------------------- documents


@query(
    f"WITH {NODES}, c AS (SELECT conv_id * 1000 + turn AS id, (conv_id * 13 + turn) % (SELECT count(*) FROM nodes) AS n FROM conversations) SELECT DISTINCT c.id, s.id AS sym_id FROM c JOIN nodes m ON m.id = c.n JOIN nodes s ON s.name = m.name"
)
def doc_links(spark, sf):
    n = nodes(spark, sf).withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))
    total = n.count()
    c = table(spark, sf, "conversations").withColumn("n", (F.col("conv_id") * 13 + F.col("turn")) % total).join(n.select(F.col("id").alias("n"), "name").hint("merge"), "n")
    docs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit(" see `pkg."), "name", F.lit("()` and `not here`.")).alias("text"))
    return D.code_mentions(docs, n.select(F.col("id").alias("sym_id"), "name"))


@query("SELECT doc_id AS id, source AS target FROM documents WHERE source IS NOT NULL UNION SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def wiki_links(spark, sf):
    d = _docs(spark, sf)
    return D.wikilinks(d.select("id", F.concat_ws("", "text", F.concat(F.lit(" [["), "source", F.lit("]] ")), F.concat(F.lit("[[ "), "lang", F.lit(" |label]]"))).alias("text")))


@query(
    "WITH t AS (SELECT doc_id AS id, '# Of ' || source || ' #' || chr(10) || text || chr(10) || '```' || chr(10) || '# not a title' || chr(10) || '```' || chr(10) || '### In ' || lang AS text FROM documents), "
    "l AS (SELECT id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t), f AS (SELECT *, sum(regexp_matches(body, '^\\s*(```|~~~)')::INTEGER) OVER (PARTITION BY id ORDER BY line) % 2 AS open FROM l) "
    "SELECT id, line::INTEGER AS line, length(regexp_extract(body, '^(#+)', 1))::INTEGER AS level, trim(regexp_extract(body, '^#+\\s+(.*?)\\s*#*\\s*$', 1)) AS title FROM f WHERE open = 0 AND regexp_matches(body, '^#{1,6}\\s+\\S')"
)
def doc_headings(spark, sf):
    d = _docs(spark, sf)
    text = F.concat(F.lit("# Of "), "source", F.lit(" #\n"), "text", F.lit("\n```\n# not a title\n```\n### In "), "lang")
    return D.headings(d.select("id", text.alias("text")))


@query(
    f"WITH {NODES}, f AS (SELECT file AS path, sum(cx) AS n FROM nodes GROUP BY file), a AS (SELECT doc_id AS id, 'src/brand' || (doc_id % 30) || '.py' AS path, (doc_id * 7 % 4000)::INTEGER AS line FROM documents WHERE text IS NOT NULL) "
    "SELECT id, a.path, line, CASE WHEN f.path IS NULL THEN 'missing-file' ELSE 'past-eof' END AS verdict FROM a LEFT JOIN f USING (path) WHERE f.path IS NULL OR line > n"
)
def doc_drift(spark, sf):
    d = table(spark, sf, "documents")
    said = F.concat(F.lit("src/brand"), (F.col("doc_id") % 30).cast("string"), F.lit(".py:"), (F.col("doc_id") * 7 % 4000).cast("string"))
    anchors = D.line_anchors(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("see "), said, F.lit("\n"), "text").alias("text"))).filter("startswith(path, 'src/brand')")
    return D.drift(anchors, nodes(spark, sf).groupBy(F.col("file").alias("path")).agg(F.sum("cx").alias("n_lines")))


@query(
    "WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '# Auto-generated file' || chr(10) || text WHEN doc_id % 3 = 1 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS text FROM documents WHERE text IS NOT NULL), "
    "l AS (SELECT id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t), f AS (SELECT *, regexp_matches(body, '^\\s*(```|~~~)') AS mark, sum(regexp_matches(body, '^\\s*(```|~~~)')::INTEGER) OVER (PARTITION BY id ORDER BY line) % 2 = 1 AS open FROM l) "
    "SELECT id FROM f GROUP BY id HAVING bool_or(regexp_matches(body, '(?i)(auto-?generated|generated by|do not edit)')) OR avg((open AND NOT mark)::INTEGER) >= 0.6"
)
def generated_docs(spark, sf):
    d = _docs(spark, sf).filter("text is not null")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("# Auto-generated file\n"), "text")).when(F.col("id") % 3 == 1, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return D.generated(d.select("id", text.alias("text")))


# ---------------------------------------------------------------- traces, gates


_FRAME = "'lib/f' || (event_id % 40) || '.py'"


@query(
    f"SELECT user_id AS id, event_id AS nth, CASE event_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'asan' WHEN 2 THEN 'node' WHEN 3 THEN 'compiler' END AS format, {_FRAME} AS path, (event_id % 500)::INTEGER AS line, CASE WHEN event_id % 5 < 3 THEN 'fn' || (event_id % 9) END AS func FROM events WHERE event_id % 5 < 4"
)
def trace_frames(spark, sf):
    e = F.col("event_id")
    path, line, fn = F.concat(F.lit("lib/f"), e % 40, F.lit(".py")), (e % 500).cast("string"), F.concat(F.lit("fn"), e % 9)
    value = (
        F.when(e % 5 == 0, F.concat(F.lit('  File "'), path, F.lit('", line '), line, F.lit(", in "), fn))
        .when(e % 5 == 1, F.concat(F.lit("    #3 0x7f1a in "), fn, F.lit(" /x/"), path, F.lit(":"), line, F.lit(":7")))
        .when(e % 5 == 2, F.concat(F.lit("    at "), fn, F.lit(" ("), path, F.lit(":"), line, F.lit(":3)")))
        .when(e % 5 == 3, F.concat(path, F.lit(":"), line, F.lit(":1: error: no")))
        .otherwise(F.lit("nothing to see"))
    )
    out = D.trace_frames(table(spark, sf, "events").select(F.col("user_id").alias("id"), e.alias("nth"), value.alias("value")))
    return out.withColumn("path", F.regexp_replace("path", "^/x/", ""))


@query(
    f"WITH {NODES}, s AS (SELECT id AS sym_id, replace(name, ' ', '_') AS name, regexp_extract(file, '[^/]*$') AS file, id % 300 AS first_, id % 300 + cx AS last_ FROM nodes), "
    "fr AS (SELECT e.user_id AS id, e.event_id AS nth, m.file AS path, (e.event_id % 360)::INTEGER AS line, CASE WHEN e.event_id % 3 > 0 THEN replace(n.name, ' ', '_') END AS func, regexp_extract(m.file, '[^/]*$') AS file FROM events e JOIN nodes n ON n.id = (e.event_id * 17) % (SELECT count(*) FROM nodes) JOIN nodes m ON m.id = (e.user_id * 31) % (SELECT count(*) FROM nodes)), "
    "b AS (SELECT fr.*, (SELECT min(sym_id) FROM s WHERE s.file = fr.file AND s.name = fr.func) AS by_name, (SELECT max({'f': first_, 'i': sym_id}).f FROM s WHERE s.file = fr.file AND fr.line BETWEEN first_ AND last_) AS best FROM fr) "
    "SELECT id, nth, path, line, func, by_name, best IS NOT NULL AS in_span FROM b"
)
def bound_frames(spark, sf):
    n = nodes(spark, sf)
    total = n.count()
    s = n.select(F.col("id").alias("sym_id"), F.replace("name", F.lit(" "), F.lit("_")).alias("name"), "file", (F.col("id") % 300).alias("first"), (F.col("id") % 300 + F.col("cx")).alias("last"))
    ev = table(spark, sf, "events").select("event_id", "user_id", ((F.col("event_id") * 17) % total).alias("a"), ((F.col("user_id") * 31) % total).alias("b"))
    fr = ev.join(s.select(F.col("sym_id").alias("a"), "name").hint("merge"), "a").join(s.select(F.col("sym_id").alias("b"), F.col("file").alias("path")).hint("merge"), "b")
    fr = fr.select(F.col("user_id").alias("id"), F.col("event_id").alias("nth"), "path", (F.col("event_id") % 360).cast("int").alias("line"), F.when(F.col("event_id") % 3 > 0, F.col("name")).alias("func"))
    out = D.bind_frames(fr, s)
    named = F.col("how").isin("name", "name-disagrees")
    spans = s.select(F.element_at(F.split("file", "/"), -1).alias("base"), F.col("first").alias("start"), (F.col("last") + 1).alias("stop"))
    out = out.withColumn("base", F.element_at(F.split("path", "/"), -1))
    inside = best_span(out.withColumnRenamed("line", "at"), spans, "base", F.lit(True)).select("base", F.col("at").cast("int").alias("line"), F.col("best").alias("in_span"))
    return out.join(inside, ["base", "line"], "left").select("id", "nth", "path", "line", "func", F.when(named, F.col("sym_id")).alias("by_name"), F.coalesce("in_span", F.lit(False)).alias("in_span"))


@query(
    "SELECT p_brand AS file, p_partkey::INTEGER AS line, CASE p_partkey % 5 WHEN 0 THEN 'OPT' || p_size WHEN 1 THEN 'HAS_' || p_size WHEN 2 THEN 'MAX' || p_size ELSE 'ENV_' || p_size END AS gate, "
    "CASE p_partkey % 5 WHEN 0 THEN 'option' WHEN 1 THEN 'ifdef' WHEN 2 THEN 'define' ELSE 'getenv' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'ON' WHEN 2 THEN '1' END AS \"default\" FROM part WHERE p_partkey % 5 < 4"
)
def gate_lines(spark, sf):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit("option(OPT"), n, F.lit(' "about it" ON)')))
        .when(k == 1, F.concat(F.lit("  #ifdef HAS_"), n))
        .when(k == 2, F.concat(F.lit("#define MAX"), n, F.lit(" 1")))
        .when(k == 3, F.concat(F.lit('x = getenv("ENV_'), n, F.lit('");')))
        .otherwise(F.lit("int x = 1;"))
    )
    return D.gates(table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("int").alias("line"), body.alias("body")))


@query(
    "WITH RECURSIVE m(gate, master, n) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT gate, master // 3, n + 1 FROM m WHERE n < 8 AND master % 3 > 0 AND master > 2), t AS (SELECT gate, arg_max(master, n) AS master FROM m GROUP BY gate) "
    "SELECT gate, master, p_size % 2 AS \"default\" FROM t LEFT JOIN part ON p_partkey = master"
)
def gate_masters(spark, sf):
    p = table(spark, sf, "part")
    links = p.filter("p_partkey % 3 > 0 and p_partkey > 2").select(F.col("p_partkey").alias("gate"), F.floor(F.col("p_partkey") / 3).cast("long").alias("target"))
    return H.gate_masters(links, p.select(F.col("p_partkey").alias("gate"), (F.col("p_size") % 2).alias("default")))


# ---------------------------------------------------------------- history


@query(f"{COMMITS}, t AS (SELECT unnest(regexp_extract_all(o_orderpriority || ' ' || o_orderstatus || ' seen_' || (o_custkey % 60), '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS name, commit_id, ordinal FROM commits JOIN orders ON o_orderkey = commit_id) SELECT name, arg_min(commit_id, ordinal) AS commit_id FROM t GROUP BY name")
def name_last_seen(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit_id"), F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(" seen_"), (F.col("o_custkey") % 60).cast("string")).alias("body"))
    return H.last_seen(commits(spark, sf).select("ordinal", "commit_id").join(o, "commit_id"))


_LAYOUT = "SELECT l_orderkey AS agg, sum(l_linenumber)::BIGINT AS size, max(l_linenumber)::BIGINT AS align, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS offsets FROM lineitem"


@query(
    f"WITH n AS ({_LAYOUT} WHERE l_quantity > 3 GROUP BY 1), h AS ({_LAYOUT} WHERE l_quantity < 48 GROUP BY 1) SELECT agg, CASE WHEN h.agg IS NULL THEN 'added' WHEN n.agg IS NULL THEN 'removed' ELSE 'fields-moved' END AS verdict FROM n FULL JOIN h USING (agg) WHERE h.agg IS NULL OR n.agg IS NULL OR n.offsets <> h.offsets"
)
def abi_drift(spark, sf):
    def side(where):
        row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        g = table(spark, sf, "lineitem").filter(where).groupBy(F.col("l_orderkey").alias("agg")).agg(F.sum("l_linenumber").alias("size"), F.max("l_linenumber").alias("align"), F.array_sort(F.collect_list(row)).alias("rows"))
        return g.select("agg", "size", "align", F.transform("rows", lambda r: r["l_partkey"]).alias("offsets"))

    return B.abi_drift(side("l_quantity > 3"), side("l_quantity < 48"))


_FIELD = "SELECT l_orderkey AS agg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, 'f' || l_partkey AS name, l_linenumber AS size, l_quantity AS q FROM lineitem"


@query(
    f"WITH l AS ({_FIELD}), r AS (SELECT agg, nth, CASE WHEN q < 5 THEN name || 'x' ELSE name END AS name, size FROM l WHERE q < 45), s AS (SELECT DISTINCT agg FROM r) "
    "SELECT l.agg, l.nth, l.name AS left_name, r.name AS right_name FROM l LEFT JOIN r ON r.agg = l.agg AND r.nth = l.nth WHERE l.agg IN (SELECT agg FROM s) AND (r.name IS DISTINCT FROM l.name OR r.size IS DISTINCT FROM l.size)"
)
def struct_mirrors(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    left = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("agg"), F.row_number().over(order).alias("nth"), F.concat(F.lit("f"), "l_partkey").alias("name"), F.col("l_linenumber").alias("size"), F.col("l_quantity").alias("q"))
    right = left.filter("q < 45").withColumn("name", F.when(F.col("q") < 5, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return H.mirror_mismatches(left.drop("q"), right.drop("q"))


@query(f"WITH {NODES}, p AS (SELECT n.name, count(*) AS calls, sum(e.value) AS ms FROM events e JOIN nodes n ON n.id = (e.user_id * 31) % (SELECT count(*) FROM nodes) WHERE n.kind <> 'fn' GROUP BY n.name) SELECT id, name, calls, round(ms, 4) AS total_ms FROM nodes LEFT JOIN p USING (name)")
def heat_join(spark, sf):
    n = nodes(spark, sf)
    total = n.count()
    ev = table(spark, sf, "events").select(((F.col("user_id") * 31) % total).alias("id"), "value")
    profile = ev.join(n.filter("kind <> 'fn'").select("id", "name"), "id").select(F.col("name").alias("scope"), F.lit(1).alias("calls"), F.col("value").alias("total_ms"))
    return rounded(B.heat(n.select("id", "name"), profile), "total_ms", digits=4).select("id", "name", "calls", "total_ms")


@query(
    "SELECT p_partkey AS canon, string_agg(ts::DATE || ' ' || event_type, ';' ORDER BY ts::DATE DESC, event_type) AS notes FROM part LEFT JOIN events ON (user_id * 31) % (SELECT count(*) FROM part) = p_partkey GROUP BY p_partkey"
)
def surfaced_notes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("canon"))
    notes = table(spark, sf, "events").select(((F.col("user_id") * 31) % p.count()).alias("target"), F.to_date("ts").alias("date"), F.col("event_type").alias("text"))
    return B.with_notes(p, notes).select("canon", F.array_join(F.transform("notes", lambda x: F.concat_ws(" ", x["date"], x["text"])), ";").alias("notes"))


@query("SELECT source AS old, lang AS new, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND source <> lang GROUP BY 1, 2")
def rename_votes(spark, sf):
    d = table(spark, sf, "documents")
    side = lambda c: d.select(F.col("doc_id").alias("hunk"), F.lit(1).alias("nth"), F.concat(F.lit("  int "), F.col(c), F.lit(" = make(3);")).alias("body"))
    return B.rename_pairs(side("source"), side("lang"))


@query(
    f"{COMMITS}, pr AS (SELECT a.file AS a, b.file AS b, count(*) AS t FROM cf a JOIN cf b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 2), fr AS (SELECT file, count(*) AS n FROM cf GROUP BY file), "
    "sc AS (SELECT p_partkey AS id, p_size::DOUBLE AS score FROM part WHERE p_size >= 49), top AS (SELECT * FROM sc ORDER BY score DESC, id LIMIT 3), "
    "de AS (SELECT a AS f, b AS t_, t / fa.n::DOUBLE AS d FROM pr JOIN fr fa ON fa.file = a UNION ALL SELECT b, a, t / fb.n::DOUBLE FROM pr JOIN fr fb ON fb.file = b), "
    "nr AS (SELECT t_ AS file, max(d) AS deg FROM de WHERE f IN (SELECT id FROM top) GROUP BY 1 ORDER BY deg DESC, file LIMIT 8), "
    "li AS (SELECT nr.file AS id, least(coalesce(sc.score, 0) + 0.25 * deg * (SELECT min(score) FROM top), (SELECT min(score) FROM top) * 0.999) AS lift FROM nr LEFT JOIN sc ON sc.id = nr.file) "
    "SELECT coalesce(sc.id, li.id) AS id, round(greatest(coalesce(score, 0), coalesce(lift, 0)), 6)::DOUBLE AS score FROM sc FULL JOIN li ON sc.id = li.id"
)
def cochange_boosted_scores(spark, sf):
    from delvegraph.queries.history import _pairs

    p = table(spark, sf, "part")
    scores = p.filter("p_size >= 49").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return rounded(B.cochange_boost(scores, p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file")), _pairs(spark, sf)), "score")


@query(
    "WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'src/test_b.py' WHEN 2 THEN 'docs/c.md' WHEN 3 THEN 'bench/d.c' WHEN 4 THEN 'src/contest.py' ELSE 'lib/e_test.go' END AS path FROM part) "
    "SELECT id, path, p % 6 IN (0, 1, 5) AS test, CASE WHEN p % 6 = 2 THEN 2 WHEN p % 6 = 4 THEN 0 ELSE 1 END::INTEGER AS tier FROM (SELECT *, id AS p FROM x)"
)
def path_tiers(spark, sf):
    names = ["tests/a.py", "src/test_b.py", "docs/c.md", "bench/d.c", "src/contest.py", "lib/e_test.go"]
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("path"))
    return x.withColumns({"test": G.is_test_path(F.col("path")), "tier": G.path_tier(F.col("path"))})


@query("SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'a/' ELSE 'b/new' END || (l_partkey % 50) || '.c' AS path FROM lineitem WHERE NOT (l_suppkey % 4 = 0 AND l_linenumber % 2 = 0)")
def diffed_paths(spark, sf):
    n = F.col("l_partkey") % 50
    path = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("a/"), n, F.lit(".c"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("b/{old => new"), n, F.lit("}.c"))).otherwise(F.concat(F.lit("was.c => b/new"), n, F.lit(".c")))
    zero = (F.col("l_suppkey") % 4 == 0) & (F.col("l_linenumber") % 2 == 0)
    value = F.concat_ws("\t", F.when(zero, "0").otherwise("3"), F.when(zero, "0").otherwise("1"), path)
    return B.git_changed(table(spark, sf, "lineitem").select(value.alias("value")))
