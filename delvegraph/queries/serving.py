"""Queries of what answers are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from delvegraph.operators import quality as Q
from delvegraph.operators import serve as S
from delvegraph.operators import text as D
from delvegraph.queries.history import _DELTA, _TOPS, _arms, _snapshots, _stray
from delvegraph.queries.history import stray_verdicts as _verdicts
from delvegraph.queries.registry import GRAPH, NODES, edges, nodes, query, table


@query(f"WITH {NODES} SELECT id, file, id AS line, cx AS score, row_number() OVER (ORDER BY cx, id DESC)::INTEGER AS place FROM nodes ORDER BY cx, id DESC LIMIT 300")
def ordered_symbols(spark, sf):
    from pyspark.sql import Window

    rows = nodes(spark, sf).select("id", "file", F.col("id").alias("line"), F.col("cx").alias("score"))
    top = S.ordered(rows, "important-last").limit(300)
    return top.withColumn("place", F.row_number().over(Window.orderBy("score", F.desc("id"))))


@query(
    "SELECT 'h' || doc_id AS handle, source || '/' || doc_id AS file, array_to_string(string_split(text[11:210], chr(10))[1:3], chr(10)) AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL UNION ALL SELECT 'none', NULL, NULL"
)
def fetched_bodies(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null and source is not null").withColumns({"path": F.concat_ws("/", "source", "doc_id"), "handle": F.concat(F.lit("h"), "doc_id")})
    symbols = d.select("handle", F.col("path").alias("file"), F.lit(10).alias("start"), F.lit(210).alias("stop"))
    wanted = d.select("handle").union(spark.createDataFrame([("none",)], "handle string"))
    return S.fetch_body(symbols, d.select("path", "text"), wanted, 1, 3)


@query(
    f"WITH {NODES}, b AS (SELECT file, sum(CASE WHEN cx >= 20 THEN cx * 3 ELSE 0 END)::BIGINT AS bundle, sum(cx)::BIGINT AS whole FROM nodes GROUP BY file HAVING max(cx) >= 20) SELECT file, CASE WHEN whole < bundle THEN 'file' ELSE 'bundle' END AS mode, least(whole, bundle) AS n_bytes FROM b"
)
def whole_file_modes(spark, sf):
    n = nodes(spark, sf)
    return S.whole_or_bundle(n.filter("cx >= 20").select("file", "id", (F.col("cx") * 3).alias("n_bytes")), n.groupBy(F.col("file").alias("path")).agg(F.sum("cx").alias("n_bytes")))


_BATCH = ['and(kind(all, fn), cx(all, 40))', 'callers(name("red widget"), 1)', 'fanin(all, 25)', 'and(kind(all, fn), cx(all, 40))']


@query(
    f"{GRAPH} SELECT '{_BATCH[0]}' AS query, id FROM nodes WHERE kind = 'fn' AND cx >= 40 UNION ALL SELECT '{_BATCH[1]}', id FROM (SELECT DISTINCT e.src AS id FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.name = 'red widget') WHERE id NOT IN (SELECT id FROM nodes WHERE name = 'red widget') "
    f"UNION ALL SELECT '{_BATCH[2]}', id FROM nodes WHERE id IN (SELECT dst FROM edges GROUP BY dst HAVING count(*) >= 25)"
)
def graph_query_batch(spark, sf):
    return S.batch(_BATCH, nodes(spark, sf), edges(spark, sf))


_LANES = "ch AS (SELECT DISTINCT o_orderpriority AS arm, p_partkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE {where})"
_CLASH = "cl AS (SELECT DISTINCT x.arm AS a, y.arm AS b FROM ch x JOIN ch y ON x.symbol = y.symbol AND x.arm <> y.arm), n AS (SELECT arm, (SELECT count(*) FROM cl WHERE a = arm)::INTEGER AS clashes FROM (SELECT DISTINCT arm FROM ch))"


@query(f"WITH {_LANES.format(where='l_quantity = 50 AND p_size = 1')}, {_CLASH} SELECT arm, clashes FROM n")
def lane_plan(spark, sf):
    o = table(spark, sf, "orders")
    j = o.join(table(spark, sf, "lineitem").filter("l_quantity = 50"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part").filter("p_size = 1"), F.col("p_partkey") == F.col("l_partkey"))
    return S.plan_lanes(j.select(F.col("o_orderpriority").alias("arm"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("symbol")).distinct()).select("arm", "clashes")


@query()
def landing_plan(spark, sf):
    return S.landing_plan(_verdicts(spark, sf), _arms(spark, sf))


_ACCEPTED = "ac AS (SELECT canon, kind, now - (canon % 3) AS now FROM d WHERE canon % 2 = 0)"


@query(f"{_TOPS}, d AS ({_DELTA}), {_ACCEPTED} SELECT d.canon, d.kind, d.now FROM d LEFT JOIN ac ON ac.canon = d.canon AND ac.kind = d.kind WHERE ac.now IS NULL OR d.now > ac.now")
def findings_above_baseline(spark, sf):
    found = Q.delta(*_snapshots(spark, sf)).select("canon", "kind", "now")
    return S.above_baseline(found, found.filter("canon % 2 = 0").withColumn("now", F.col("now") - F.col("canon") % 3))


@query(f"{_TOPS}, d AS ({_DELTA}), ac AS (SELECT canon, kind, now - 1 + canon % 3 AS now FROM d WHERE canon % 2 = 0 UNION ALL SELECT 1000000 + canon, kind, now FROM d) SELECT d.canon, d.kind, least(d.now, ac.now) AS now FROM d JOIN ac ON ac.canon = d.canon AND ac.kind = d.kind")
def baseline_update(spark, sf):
    found = Q.delta(*_snapshots(spark, sf)).select("canon", "kind", "now")
    held = found.filter("canon % 2 = 0").withColumn("now", F.col("now") - 1 + F.col("canon") % 3).unionByName(found.withColumn("canon", F.col("canon") + 1_000_000))
    return S.updated_baseline(found, held)


@query(
    f"WITH {NODES}, f AS (SELECT file AS path, sum(cx) AS n FROM nodes GROUP BY file), a AS (SELECT DISTINCT doc_id % 60 AS id, 'src/brand' || (doc_id % 27) || '.py' AS path, (doc_id * 7 % 900)::INTEGER AS line FROM documents) "
    "SELECT id, count(*) AS anchors, count(n) AS checkable, count(*) FILTER (line <= n) AS holds, count(*) = count(n) AS gateable FROM a LEFT JOIN f USING (path) GROUP BY id"
)
def drift_gateability(spark, sf):
    d = table(spark, sf, "documents")
    said = F.concat(F.lit("src/brand"), (F.col("doc_id") % 27).cast("string"), F.lit(".py:"), (F.col("doc_id") * 7 % 900).cast("string"))
    anchors = D.line_anchors(d.select((F.col("doc_id") % 60).alias("id"), F.concat(F.lit("at "), said, F.lit(" !")).alias("text"))).distinct()
    return S.gateability(anchors, nodes(spark, sf).groupBy(F.col("file").alias("path")).agg(F.sum("cx").alias("n_lines")))


_TYPES = ["int", "const char*", "double [3]", "unsigned short[2][5]", "std::uint64_t", "Widget", "float &", "char buf[N]", "bool"]
_BYTES = [4, 8, 24, 20, 8, None, 8, None, 1]
_ALIGN = [4, 8, 8, 2, 8, None, 8, None, 1]


def _pick(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) for v in values) + "]"


@query(f"SELECT p_partkey AS id, ({_pick(_BYTES)})[p_partkey % 9 + 1]::BIGINT AS size, ({_pick(_ALIGN)})[p_partkey % 9 + 1]::BIGINT AS align FROM part")
def type_sizes(spark, sf):
    declared = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    size, align = S.type_size(declared)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), size.alias("size"), align.alias("align"))


# Two states of a corpus: the line items shipped before a date and all of them; parts are symbols, consecutive parts of an order call.
_CUT = "TIMESTAMP '1995-03-01'"


def _state_sql(name: str, where: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT l_partkey AS canon, max(l_linenumber)::BIGINT AS params, max(l_linenumber) % 2 = 1 AS public, max(l_linenumber) % 2 = 0 AS internal, count(*) FILTER (l_quantity < 9) AS masks, sum(l_suppkey)::BIGINT AS body, count(DISTINCT l_orderkey) AS commits FROM lineitem WHERE {where} GROUP BY 1), "
        f"{name}c AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem WHERE {where}) WHERE dst IS NOT NULL AND src <> dst), "
        f"{name}g AS MATERIALIZED (SELECT p_name || p_type AS grp, array_to_string(list_transform(list_sort(list_distinct(list(canon))), lambda x: x::VARCHAR), ',') AS st, max(p_size)::BIGINT AS tokens FROM {name} JOIN part ON p_partkey = canon GROUP BY 1 HAVING count(DISTINCT canon) > 1)"
    )


@query(
    f"WITH {_state_sql('n', 'true')}, {_state_sql('b', f'l_shipdate < {_CUT}')}, j AS (SELECT n.*, b.params AS bp, b.public AS bpub, b.masks AS bm, b.body AS bb, CASE WHEN b.canon IS NULL THEN 'new-symbol' ELSE 'preexisting-worse' END AS origin, b.canon IS NOT NULL AS there FROM n LEFT JOIN b USING (canon)), "
    "fan AS (SELECT dst AS canon, count(DISTINCT src) AS f FROM nc GROUP BY 1), gr AS (SELECT ng.grp, ng.st, ng.tokens, bool_or(b.canon IS NOT NULL) AS older, max(CASE WHEN b.canon IS NOT NULL THEN coalesce(f, 0) END) AS fan FROM ng JOIN part ON p_name || p_type = ng.grp JOIN n ON n.canon = p_partkey LEFT JOIN b ON b.canon = n.canon LEFT JOIN fan ON fan.canon = n.canon WHERE ng.st NOT IN (SELECT st FROM bg) GROUP BY 1, 2, 3) "
    "SELECT canon::VARCHAR AS canon, 'dead-code' AS kind, 0::BIGINT AS was, 0::BIGINT AS now, origin FROM j WHERE internal AND canon NOT IN (SELECT dst FROM nc) AND (NOT there OR canon IN (SELECT dst FROM bc)) "
    "UNION ALL SELECT canon::VARCHAR, 'api-surface', CASE WHEN there AND bpub THEN bp ELSE 0 END, CASE WHEN there AND bpub THEN params ELSE 0 END, origin FROM j WHERE public AND (NOT there OR NOT bpub OR params <> bp) "
    "UNION ALL SELECT canon::VARCHAR, 'error-masking', coalesce(bm, 0), masks, origin FROM j WHERE masks > coalesce(bm, 0) "
    "UNION ALL SELECT canon::VARCHAR, 'short-horizon-churn', 0, commits, origin FROM j WHERE there AND body <> bb AND commits >= 2 "
    "UNION ALL SELECT st, 'duplication', 0, tokens, CASE WHEN older THEN 'preexisting-worse' ELSE 'new-symbol' END FROM gr "
    "UNION ALL SELECT st, 'new-clone-of-reused-helper', 0, fan, 'preexisting-worse' FROM gr WHERE fan >= 3"
)
def quality_delta_relational(spark, sf):
    from pyspark.sql import Window

    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")

    def state(df):
        g = df.groupBy(F.col("l_partkey").alias("canon")).agg(F.max("l_linenumber").alias("params"), F.count_if(F.col("l_quantity") < 9).alias("masks"), F.sum("l_suppkey").alias("body"), F.countDistinct("l_orderkey").alias("commits"))
        symbols = g.withColumns({"public": F.col("params") % 2 == 1, "internal": F.col("params") % 2 == 0})
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        calls = df.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst is not null and src <> dst")
        clones = parts.join(symbols.select(F.col("canon").alias("p_partkey")), "p_partkey").select(F.col("p_partkey").alias("canon"), F.concat("p_name", "p_type").alias("grp"), F.col("p_size").alias("tokens"))
        return symbols, calls, clones

    now, base = state(lines), state(lines.filter("l_shipdate < timestamp_ntz'1995-03-01'"))
    return Q.relational_delta(now[0], base[0], now[1], base[1], now[2], base[2])


_CODE = ["goto end;", "strcpy(a, b);", "x = md5(y);", "catch (...) { }", "  a = a;", "if (x) ;", "typedef int T;", "foo(12345, x);", "return x;", "do x++; while (x < 5) ;", "sprintf(b, c); gets(b);"]
_HITS = ["goto", "unsafe-c-fn", "weak-crypto", "empty-catch", "self-assign", "suspicious-semicolon", "typedef-over-using", "magic-number", None, None, "unsafe-c-fn"]


@query(
    "WITH f AS (SELECT p_brand AS path, p_partkey::INTEGER AS line, (["
    + ", ".join("NULL" if h is None else f"'{h}'" for h in _HITS)
    + "])[p_partkey % 11 + 1] AS rule FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line)::INTEGER AS nth, count(*) OVER (PARTITION BY rule) AS total FROM f WHERE rule IS NOT NULL) "
    "SELECT path, line, rule, CASE WHEN rule IN ('unsafe-c-fn', 'weak-crypto') THEN 'error' ELSE 'warning' END AS severity, nth, total FROM r WHERE nth <= 20"
)
def lint_tallies(spark, sf):
    from delvegraph.sources import rules

    body = F.element_at(F.array(*map(F.lit, _CODE)), (F.col("p_partkey") % 11 + 1).cast("int"))
    lines = table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.lit("cpp").alias("lang"), F.col("p_partkey").cast("int").alias("line"), body.alias("body"))
    return rules.tallied(rules.lint(lines, rules.BUILTIN), 20)


@query(
    "WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS cls, l_partkey AS m, l_suppkey % 7 AS f FROM lineitem), l AS (SELECT DISTINCT a.cls, a.m AS a, b.m AS b FROM x a JOIN x b ON a.cls = b.cls AND a.f = b.f), "
    "r(cls, a, b) AS (SELECT * FROM l UNION SELECT r.cls, r.a, l.b FROM r JOIN l ON l.cls = r.cls AND l.a = r.b), c AS (SELECT cls, a, min(b) AS m FROM r GROUP BY 1, 2) SELECT cls::VARCHAR AS cls, count(DISTINCT m) AS lcom4 FROM c GROUP BY 1"
)
def class_cohesion(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("cls"), F.col("l_partkey").cast("string").alias("method"), (F.col("l_suppkey") % 7).cast("string").alias("field")).distinct()
    none = x.select("cls", F.col("method").alias("a"), F.col("method").alias("b")).limit(0)
    return Q.lcom4(x.select("cls", "method").distinct(), x, none)


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS public FROM part")
def public_names(spark, sf):
    from delvegraph.operators.bundles import public_api

    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.initcap("p_name")).when(k == 1, F.lower("p_name")).when(k == 2, F.lower("p_name")).otherwise(F.concat(F.lit("_"), "p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), public_api(name, F.when(k < 2, "go").otherwise("python")).alias("public"))


@query("SELECT p_partkey AS sym_id, 'def ' || replace(p_name, ' ', '_') || '(a, b=' || p_size || ')' AS signature FROM part")
def symbol_signatures(spark, sf):
    from delvegraph.operators.bundles import signatures

    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    p = table(spark, sf, "part").withColumn("head", F.concat(F.lit("def "), name, F.lit("(a,\n      b="), F.col("p_size").cast("string"), F.lit("):\n    return a\n")))
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("import x\n"), "head", F.lit("rest")).alias("content"))
    symbols = p.select(F.col("p_partkey").alias("sym_id"), F.col("p_partkey").cast("string").alias("file"), F.lit(9).alias("start"), (F.lit(9) + F.length("head")).alias("stop"))
    return signatures(symbols, files)


@query("SELECT doc_id AS id, replace(coalesce(source, '') || ' = 1;' || chr(10) || 'b();' || chr(10) || chr(10) || 'c();', chr(13), '') AS code FROM documents WHERE source IS NOT NULL")
def compressed_code(spark, sf):
    from delvegraph.operators.bundles import compress

    d = table(spark, sf, "documents").filter("source is not null")
    code = F.concat("source", F.lit(" = 1;\n// about it\nb();\n\n\n  # why\n\nc();"))
    return d.select(F.col("doc_id").alias("id"), compress(code).alias("code"))
