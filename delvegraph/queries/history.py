"""History and quality queries over orders (commits), parts (files) and snapshots of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from delvegraph.operators import history as H
from delvegraph.operators import mining as M
from delvegraph.operators import quality as Q
from delvegraph.operators import resolve as R
from delvegraph.queries.registry import COMMITS, GRAPH, NODES, commit_files, commits, edges, nodes, query, rounded, table

_PAIRS = (
    f"{COMMITS}, slot AS (SELECT commit_id, ntile(3) OVER (ORDER BY ordinal) AS s FROM commits), "
    "pr AS (SELECT a.file AS a, b.file AS b, count(*) AS together, count(DISTINCT s) AS recur FROM cf a JOIN cf b ON a.commit_id = b.commit_id AND a.file < b.file JOIN slot ON slot.commit_id = a.commit_id GROUP BY 1, 2 HAVING count(*) >= 2), "
    "fr AS (SELECT file, count(*) AS n FROM cf GROUP BY file), pairs AS (SELECT a, b, together, together / fa.n::DOUBLE AS conf_a, together / fb.n::DOUBLE AS conf_b, recur FROM pr JOIN fr fa ON fa.file = a JOIN fr fb ON fb.file = b)"
)


def _pairs(spark, sf):
    return M.cochange_pairs(commits(spark, sf), commit_files(spark, sf), support=2)


@query(f"{_PAIRS} SELECT a, b, together, round(conf_a, 6) AS conf_a, round(conf_b, 6) AS conf_b, recur FROM pairs")
def cochange_pairs(spark, sf):
    return rounded(_pairs(spark, sf), "conf_a", "conf_b")


@query(f"{_PAIRS} SELECT b AS path, together, round(conf_a, 6) AS deg, round(conf_b, 6) AS deg_rev FROM pairs WHERE a = 5 UNION ALL SELECT a, together, round(conf_b, 6), round(conf_a, 6) FROM pairs WHERE b = 5")
def cochange_partners(spark, sf):
    return rounded(M.partners(_pairs(spark, sf), 5), "deg", "deg_rev")


@query(f"{_PAIRS}, dep AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem) SELECT a, b, together FROM pairs WHERE (a, b) NOT IN (SELECT (a, b) FROM dep)")
def surprising_cochange(spark, sf):
    dep = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return M.surprising(_pairs(spark, sf), dep).select("a", "b", "together")


@query()
def violation_groups(spark, sf):
    """Greedy cover of all surprising pairs."""
    return M.violation_groups(surprising_cochange(spark, sf))


@query(
    f"{COMMITS}, e AS (SELECT file, author, sum(exp(-ln(2.0) * greatest(date_diff('second', ts, TIMESTAMP '2001-08-01') / 86400.0, 0) / 182.5)) AS score FROM cf JOIN commits USING (commit_id) GROUP BY 1, 2), "
    "s AS (SELECT *, score / sum(score) OVER (PARTITION BY file) AS share FROM e) SELECT file, author, round(score, 6) AS score, round(share, 6) AS share, max(share) OVER (PARTITION BY file) > 0.8 AS sole FROM s"
)
def ownership(spark, sf):
    return rounded(M.owners(commits(spark, sf), commit_files(spark, sf), "2001-08-01"), "score", "share")


@query(f"{COMMITS} SELECT file, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts FROM cf JOIN commits USING (commit_id) WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY file")
def churn_window(spark, sf):
    return M.churn(commits(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), commit_files(spark, sf), "1997-01-01", "1998-01-01")


_FILE_CF = f"{COMMITS}, {NODES}, bf AS (SELECT DISTINCT commit_id, nodes.file AS file FROM cf JOIN nodes ON nodes.id = cf.file)"


@query(
    f"{_FILE_CF}, ch AS (SELECT file, count(*) AS commits FROM bf GROUP BY file), per AS (SELECT file, sum(cx)::BIGINT AS complexity, max({{'c': cx, 'n': name}}).n AS worst FROM nodes GROUP BY file) "
    "SELECT file, complexity, commits, (complexity * commits)::BIGINT AS heat, worst FROM per JOIN ch USING (file) WHERE complexity * commits > 0"
)
def hotspots(spark, sf):
    n = nodes(spark, sf)
    by_file = commit_files(spark, sf).join(n.select(F.col("id").alias("file"), F.col("file").alias("path")), "file").select("commit_id", F.col("path").alias("file"))
    return M.hotspots(n.withColumnRenamed("cx", "ccx"), M.churn(commits(spark, sf), by_file))


@query(f"{_FILE_CF}, ch AS (SELECT file, count(*) AS commits FROM bf GROUP BY file) SELECT id, round((coalesce(commits, 0) + 1) / (sum(coalesce(commits, 0) + 1) OVER ())::DOUBLE, 12) AS p FROM nodes LEFT JOIN ch USING (file)")
def churn_teleport(spark, sf):
    n = nodes(spark, sf)
    by_file = commit_files(spark, sf).join(n.select(F.col("id").alias("file"), F.col("file").alias("path")), "file").select("commit_id", F.col("path").alias("file"))
    return rounded(M.churn_prior(n, M.churn(commits(spark, sf), by_file)), "p", digits=12)


@query(f"{COMMITS} SELECT slot::INTEGER AS slot, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, ntile(3) OVER (ORDER BY ordinal) AS slot FROM commits) GROUP BY slot")
def equal_count_windows(spark, sf):
    c = commits(spark, sf)
    return H.newest_first_windows(c).join(c, "commit_id").groupBy("slot").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Two snapshots: the line items shipped before a date and all of them.
_SNAP = (
    "WITH s AS (SELECT l_partkey AS canon, l_quantity::INTEGER AS loc, (l_linenumber * 3)::INTEGER AS ccx, (l_linenumber + l_quantity::INTEGER % 3)::INTEGER AS cx, l_linenumber::INTEGER AS max_nest, (l_quantity::INTEGER % 9)::INTEGER AS params, l_shipdate FROM lineitem), "
    "bs AS (SELECT * FROM s WHERE l_shipdate < TIMESTAMP '1998-01-01')"
)


def _snapshots(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("canon"),
        F.col("l_quantity").cast("int").alias("loc"),
        (F.col("l_linenumber") * 3).cast("int").alias("ccx"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).cast("int").alias("cx"),
        F.col("l_linenumber").cast("int").alias("max_nest"),
        (F.col("l_quantity").cast("int") % 9).cast("int").alias("params"),
        "l_shipdate",
    )
    return s, s.filter("l_shipdate < timestamp_ntz'1998-01-01'")


_TOPS = f"{_SNAP}, n AS (SELECT canon, max(ccx) AS ccx, max(loc) AS loc, max(max_nest) AS max_nest, max(params) AS params FROM s GROUP BY canon), b AS (SELECT canon, max(ccx) AS ccx, max(loc) AS loc, max(max_nest) AS max_nest, max(params) AS params FROM bs GROUP BY canon)"
_DELTA = " UNION ALL ".join(
    f"SELECT coalesce(n.canon, b.canon) AS canon, '{k}' AS kind, coalesce(b.{k}, 0)::BIGINT AS was, coalesce(n.{k}, 0)::BIGINT AS now, CASE WHEN b.canon IS NULL THEN 'new-symbol' ELSE 'preexisting-worse' END AS origin, coalesce(n.{k}, 0) - coalesce(b.{k}, 0) < {m or 0} AS minor FROM n FULL JOIN b ON n.canon = b.canon WHERE coalesce(n.{k}, 0) > coalesce(b.{k}, 0) AND coalesce(n.{k}, 0) > {bar}"
    for k, (bar, m) in Q.KINDS.items()
)


@query(f"{_TOPS} {_DELTA}")
def quality_delta(spark, sf):
    return Q.delta(*_snapshots(spark, sf)).select("canon", "kind", "was", "now", "origin", "minor")


@query(f"{_TOPS}, d AS ({_DELTA}) SELECT canon, kind, was, now FROM d WHERE NOT (canon % 10 = 0 AND kind = 'ccx')")
def quality_delta_acknowledged(spark, sf):
    found = Q.delta(*_snapshots(spark, sf))
    acks = found.filter("canon % 10 = 0 and kind = 'ccx'").select("canon", "kind")
    return Q.without_acks(found, acks).select("canon", "kind", "was", "now")


def _dmm_sql(c: str, bound: int) -> str:
    low = f"coalesce(sum(CASE WHEN {c} <= {bound} THEN loc ELSE 0 END), 0)::BIGINT"
    high = f"coalesce(sum(CASE WHEN {c} > {bound} THEN loc ELSE 0 END), 0)::BIGINT"
    t = f"(SELECT (SELECT {low} FROM s) - (SELECT {low} FROM bs) AS up, (SELECT {high} FROM s) - (SELECT {high} FROM bs) AS risk)"
    good, bad = "greatest(up, 0) + greatest(-risk, 0)", "greatest(risk, 0) + greatest(-up, 0)"
    return f"(SELECT CASE WHEN {good} + {bad} > 0 THEN round(({good}) / ({good} + {bad})::DOUBLE, 6) END FROM {t})"


@query(f"{_SNAP} SELECT {_dmm_sql('loc', 15)} AS size, {_dmm_sql('cx', 5)} AS complexity, {_dmm_sql('params', 2)} AS interface")
def maintainability_delta(spark, sf):
    return rounded(Q.dmm(*_snapshots(spark, sf)), "size", "complexity", "interface")


@query(
    f"{_SNAP}, n AS (SELECT canon, max(params) AS p, max(ccx % 2) AS u, count(*) AS c FROM s GROUP BY canon), h AS (SELECT canon, max(params) AS p, max(ccx % 2) AS u, count(*) AS c FROM bs GROUP BY canon) "
    "SELECT n.canon, CASE WHEN h.canon IS NULL THEN 'new-symbol' WHEN n.p = h.p AND n.u = h.u AND n.c = h.c THEN 'unchanged' ELSE 'contract-change' END AS verdict FROM n LEFT JOIN h USING (canon)"
)
def edit_contracts(spark, sf):
    now, head = (x.withColumn("public", F.col("ccx") % 2) for x in _snapshots(spark, sf))
    return Q.edit_check(now, head)


@query(
    "WITH n AS (SELECT id, cx, file FROM (SELECT p_partkey AS id, p_size AS cx, p_brand AS file FROM part)), r AS (SELECT *, row_number() OVER (ORDER BY cx DESC, id) AS nth FROM n) SELECT id, cx, file FROM r WHERE nth <= least(40, ceil((SELECT count(*) FROM n) / 10.0))"
)
def worst_decile(spark, sf):
    return Q.worst_decile(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cx"), F.col("p_brand").alias("file")), "cx", "id")


@query(
    f"{GRAPH}, f AS (SELECT id, 'big' AS family FROM nodes WHERE cx >= 45 UNION SELECT dst, 'popular' FROM edges GROUP BY dst HAVING count(*) >= 25 UNION SELECT src, 'busy' FROM edges GROUP BY src HAVING count(*) >= 25) "
    "SELECT id, string_agg(family, ',' ORDER BY family) AS families, count(*) AS n_families FROM f GROUP BY id"
)
def evidence_ensemble(spark, sf):
    e = edges(spark, sf)
    wide = lambda c: e.groupBy(F.col(c).alias("id")).count().filter("count >= 25")
    out = Q.ensemble([("big", nodes(spark, sf).filter("cx >= 45")), ("popular", wide("dst")), ("busy", wide("src"))])
    return out.withColumn("families", F.array_join("families", ","))


@query(
    f"{GRAPH}, u AS (SELECT DISTINCT a.id AS id, a.file AS file, b.id AS d, b.file AS df, b.cx AS t FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst) "
    "SELECT id, sum(CASE WHEN file <> df THEN t ELSE 0 END)::BIGINT AS outside_tokens, count(*) FILTER (file <> df) AS outside, sum(t)::BIGINT AS total_tokens, CASE WHEN sum(t) > 0 THEN round(sum(CASE WHEN file <> df THEN t ELSE 0 END) / sum(t)::DOUBLE, 6) END AS ratio FROM u GROUP BY id"
)
def context_ratio(spark, sf):
    n = nodes(spark, sf)
    return rounded(Q.context_ratio_of(edges(spark, sf), n.select("id", "file", F.col("cx").alias("tokens"))), "ratio")


# Names of parts as definitions (64 names, so most are ambiguous); line items call them.
_RES = (
    f"WITH {NODES}, sy AS (SELECT id AS dst, name, file AS d_file, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END AS d_dir, cx % 4 AS params, cx % 2 = 0 AS ax FROM nodes), "
    "rf AS (SELECT e.event_id AS ref_id, n.id AS src, n.file AS r_file, regexp_replace(n.file, '/[^/]*$', '') AS r_dir, m.name, (e.event_id % 5)::INTEGER AS args FROM events e JOIN nodes n ON n.id = (e.user_id * 31) % (SELECT count(*) FROM nodes) JOIN nodes m ON m.id = (e.event_id * 17) % (SELECT count(*) FROM nodes)), "
    "c AS (SELECT *, CASE WHEN r_file = d_file THEN 1 WHEN r_dir = d_dir THEN 2 ELSE 3 END AS step FROM rf JOIN sy USING (name)), "
    "c1 AS (SELECT * FROM c QUALIFY step = min(step) OVER (PARTITION BY ref_id)), c2 AS (SELECT *, NOT (ax AND args > params) AS ok FROM c1), c3 AS (SELECT * FROM c2 QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY ref_id)), "
    "c4 AS (SELECT *, CASE WHEN r_file = d_file THEN 2 WHEN r_dir = d_dir THEN 1 ELSE 0 END AS near FROM c3), c5 AS (SELECT * FROM c4 QUALIFY near = max(near) OVER (PARTITION BY ref_id)), "
    "res AS (SELECT ref_id, src, dst, CASE step WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.2 END::DOUBLE AS conf, count(*) OVER (PARTITION BY ref_id) AS k, step FROM c5 QUALIFY step < 3 OR count(*) OVER (PARTITION BY ref_id) = 1)"
)


def _references(spark, sf):
    n = nodes(spark, sf)
    dir_ = F.regexp_replace("file", "/[^/]*$", "")
    symbols = n.select(F.col("id").alias("sym_id"), "name", "file", dir_.alias("dir"), F.lit("python").alias("lang"), (F.col("cx") % 4).alias("params"), (F.col("cx") % 2 == 0).alias("arity_exact"))
    total = n.count()
    ev = table(spark, sf, "events").select("event_id", ((F.col("user_id") * 31) % total).alias("a"), ((F.col("event_id") * 17) % total).alias("b"))
    # symbols are no table with a bound: their file is small for what it holds, so it would be broadcast
    refs = ev.join(n.select(F.col("id").alias("a"), "file").hint("merge"), "a").join(n.select(F.col("id").alias("b"), "name").hint("merge"), "b").select(
        F.col("event_id").alias("ref_id"), F.col("a").alias("from_sym"), "file", dir_.alias("dir"), F.lit("python").alias("lang"), F.col("name").alias("callee"), (F.col("event_id") % 5).cast("int").alias("arg_count")
    )
    return refs, symbols


@query(f"{_RES} SELECT ref_id, src, dst, conf, k FROM res")
def resolve_references(spark, sf):
    return R.resolve(*_references(spark, sf))


@query(
    f"{_RES}, df AS (SELECT name, count(*) AS defs FROM nodes GROUP BY name), e AS (SELECT src, dst, count(*) AS n_ref, sum(conf / k) AS c, max((k > 1)::INTEGER) AS amb FROM res WHERE src <> dst GROUP BY 1, 2) "
    "SELECT src, dst, n_ref, round(least(c / n_ref * sqrt(n_ref), 8.0) * CASE WHEN defs >= 16 THEN 0.1 ELSE 1.0 END, 6)::DOUBLE AS w, amb FROM e JOIN nodes ON nodes.id = dst JOIN df USING (name)"
)
def resolved_edges(spark, sf):
    refs, symbols = _references(spark, sf)
    return rounded(R.weighted_resolution(refs, symbols), "w")


@query(f"{_RES}, k AS (SELECT ref_id, max(k) AS k FROM res GROUP BY ref_id) SELECT src AS from_sym, count(*) FILTER (k > 1) AS amb, count(*) FILTER (k IS NULL) AS unresolved FROM rf LEFT JOIN k USING (ref_id) GROUP BY src")
def resolution_gauges(spark, sf):
    refs, symbols = _references(spark, sf)
    return R.gauges(refs, R.targets(refs, symbols)[0])


@query("SELECT event_type AS callee, 'python' AS lang, count(*) AS n_refs FROM events WHERE event_type NOT IN (SELECT p_name FROM part) GROUP BY event_type")
def external_surface(spark, sf):
    refs = table(spark, sf, "events").select(F.col("event_type").alias("callee"), F.lit("python").alias("lang"))
    return R.external_surface(refs, table(spark, sf, "part").select(F.col("p_name").alias("name")))


@query(
    "WITH sp AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS sym_id, o_custkey % 50 AS file, (o_orderkey % 500)::BIGINT AS start, (o_orderkey % 500 + 5 + o_custkey % 40)::BIGINT AS stop FROM orders), "
    "pt AS (SELECT event_id AS point_id, user_id % 50 AS file, event_id % 550 AS at_ FROM events) "
    "SELECT point_id, file, at_ AS at, (SELECT max({'s': start, 'i': sym_id}).i FROM sp WHERE sp.file = pt.file AND pt.at_ >= sp.start AND pt.at_ < sp.stop) AS sym_id FROM pt"
)
def enclosing_symbols(spark, sf):
    from delvegraph.plans.ranking import numbered

    o = numbered(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], "nth")
    spans = o.select((F.col("nth") + 1).cast("long").alias("sym_id"), (F.col("o_custkey") % 50).alias("file"), (F.col("o_orderkey") % 500).alias("start"), (F.col("o_orderkey") % 500 + 5 + F.col("o_custkey") % 40).alias("stop"))
    points = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), (F.col("user_id") % 50).alias("file"), (F.col("event_id") % 550).alias("at"))
    return R.enclosing(points, spans)


# Arms of work: customers' orders by market segment; parts are symbols, brands files.
_ARMS = "WITH ch AS (SELECT DISTINCT o_orderpriority AS arm, p_brand AS file, p_partkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


def _arms(spark, sf):
    o = table(spark, sf, "orders")
    j = o.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.select(F.col("o_orderpriority").alias("arm"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("symbol")).distinct()


@query(f"{_ARMS} SELECT x.arm AS a, y.arm AS b, count(*) FILTER (x.symbol = y.symbol) AS symbols, count(DISTINCT x.file) AS files FROM ch x JOIN ch y ON x.file = y.file AND x.arm < y.arm GROUP BY 1, 2")
def merge_conflicts(spark, sf):
    return H.conflicts(_arms(spark, sf))


@query()
def landing_order(spark, sf):
    pairs = H.conflicts(_arms(spark, sf)).filter("symbols > 0").select("a", "b").collect()
    arms = [r[0] for r in _arms(spark, sf).select("arm").distinct().collect()]
    return spark.createDataFrame(list(enumerate(H.landing_order(arms, {(r.a, r.b) for r in pairs}))), "nth int, arm string")


_STRAY = (
    "WITH au AS (SELECT o_orderpriority AS ref, p_brand AS path, p_name AS line, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3), "
    "hd AS (SELECT p_brand AS path, p_name AS line, count(*) AS m FROM part GROUP BY 1, 2), t AS (SELECT ref, path, sum(greatest(n - coalesce(m, 0), 0))::BIGINT AS n_stray, sum(n)::BIGINT AS n_authored FROM au LEFT JOIN hd USING (path, line) GROUP BY 1, 2)"
)


def _stray(spark, sf):
    o = table(spark, sf, "orders")
    p = table(spark, sf, "part")
    authored = o.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_orderpriority").alias("ref"), F.col("p_brand").alias("path"), F.col("p_name").alias("line"))
    return H.absent_lines(authored, p.select(F.col("p_brand").alias("path"), F.col("p_name").alias("line")))


@query(f"{_STRAY} SELECT * FROM t")
def stray_lines(spark, sf):
    return _stray(spark, sf)


@query(
    f"{_STRAY} SELECT ref, path, CASE WHEN n_stray = 0 THEN 'merged' WHEN n_authored % 3 > 0 AND (n_authored % 2) / (n_authored % 3)::DOUBLE >= 0.6 THEN 'superseded' WHEN n_authored % 3 = 0 AND 1 - n_stray / n_authored::DOUBLE >= 0.9 AND n_stray >= 8 THEN 'superseded' ELSE 'unmerged' END AS verdict FROM t"
)
def stray_verdicts(spark, sf):
    rows = _stray(spark, sf).withColumns({"deleted": F.col("n_authored") % 3, "redone": F.col("n_authored") % 2, "touched": F.lit(True), "containment": 1 - F.col("n_stray") / F.col("n_authored")})
    return H.stray_verdict(rows).select("ref", "path", "verdict")


@query("SELECT DISTINCT o_orderpriority AS ref, 'cust' || (o_custkey % 100)::VARCHAR AS path, 1 AS n_lines FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(c_name, '00012')")
def where_is(spark, sf):
    o = table(spark, sf, "orders")
    tree = o.select(F.col("o_orderpriority").alias("ref"), F.concat(F.lit("cust"), F.col("o_custkey") % 100).alias("path"), F.col("o_custkey").alias("sha"))
    blobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("sha"), F.col("c_name").alias("text"))
    return H.where_is(tree.select("ref").distinct(), tree.distinct(), blobs, "00012").distinct()


_FIELDS = "WITH f AS (SELECT l_orderkey AS agg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, (l_partkey % 4) AS e, l_partkey FROM lineitem)"


def _fields(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    width = F.expr("cast(shiftleft(1, cast(l_partkey % 4 as int)) as long)")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("agg"), F.row_number().over(order).alias("nth"), F.concat(F.lit("f"), "l_partkey").alias("name"), width.alias("size"), width.alias("align"))


@query(
    "WITH RECURSIVE f AS (SELECT l_orderkey AS agg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, (1 << (l_partkey % 4)::INTEGER)::BIGINT AS sz FROM lineitem), "
    "w(agg, nth, fin, al, used, offs) AS (SELECT agg, 1, sz, sz, sz, '0' FROM f WHERE nth = 1 UNION ALL SELECT f.agg, f.nth, ((w.fin + f.sz - 1) // f.sz) * f.sz + f.sz, greatest(w.al, f.sz), w.used + f.sz, w.offs || ',' || (((w.fin + f.sz - 1) // f.sz) * f.sz)::VARCHAR FROM w JOIN f ON f.agg = w.agg AND f.nth = w.nth + 1), "
    "l AS (SELECT * FROM w QUALIFY nth = max(nth) OVER (PARTITION BY agg)) SELECT agg, (((fin + al - 1) // al) * al)::BIGINT AS size, al::BIGINT AS align, (((fin + al - 1) // al) * al - used)::BIGINT AS padding, offs AS offsets FROM l"
)
def struct_layouts(spark, sf):
    return H.struct_layout(_fields(spark, sf)).withColumn("offsets", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ","))


@query(
    "WITH x AS (SELECT DISTINCT o_custkey % 20 AS fn, 's' AS agg, p_size AS field FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) "
    "SELECT 's' AS agg, a.field AS a, b.field AS b, count(*) AS together, round(count(*) * (64 - least(abs(a.field - b.field) * 8, 64)) / 64.0, 6)::DOUBLE AS weight FROM x a JOIN x b ON a.fn = b.fn AND a.field < b.field GROUP BY a.field, b.field"
)
def field_affinity(spark, sf):
    o = table(spark, sf, "orders")
    x = o.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select((F.col("o_custkey") % 20).alias("fn"), F.lit("s").alias("agg"), F.col("p_size").alias("field"))
    order = x.select("agg", "field").distinct().withColumn("offset", F.col("field") * 8)
    return rounded(H.field_affinity(x, order), "weight")


@query(
    f"WITH {NODES}, v AS (SELECT file, kind, CASE WHEN cx % 10 < 9 THEN 'snake' ELSE 'camel' END AS style, count(*) AS n FROM nodes GROUP BY 1, 2, 3), t AS (SELECT file AS lang, kind, sum(n)::BIGINT AS votes, max({{'n': n, 's': -ascii(style), 't': style}}).t AS top, max(n) AS m FROM v GROUP BY 1, 2), "
    "w AS (SELECT *, CASE WHEN votes < 20 THEN 'insufficient-sample' WHEN m / votes::DOUBLE < 0.9 THEN 'no-clear-convention' ELSE 'convention' END AS verdict FROM t) "
    "SELECT lang, kind, votes, CASE WHEN verdict = 'convention' THEN top END AS style, CASE WHEN verdict = 'convention' THEN round(m / votes::DOUBLE, 6) END AS agreement, verdict FROM w"
)
def naming_conventions(spark, sf):
    n = nodes(spark, sf).select(F.col("file").alias("lang"), "kind", F.when(F.col("cx") % 10 < 9, "snake").otherwise("camel").alias("style"))
    return rounded(Q.naming_vote(n), "agreement")
