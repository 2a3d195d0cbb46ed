"""Graph queries: the set language, closures, ranks, cycles, health, rules, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from delvegraph.operators import graph as G
from delvegraph.operators import kernels, quality, testgate
from delvegraph.plans.graphquery import graph_query, page
from delvegraph.queries.registry import EDGES, GRAPH, NODES, OFTEN, REFS, edges, nodes, often, query, rounded


@query(f"{GRAPH}, s AS (SELECT DISTINCT e.src AS id FROM edges e JOIN nodes n ON n.id = e.dst WHERE n.name = 'red widget') SELECT id, name, kind, cx, file FROM nodes WHERE kind = 'fn' AND id IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM nodes WHERE name = 'red widget')")
def graph_query_callers(spark, sf):
    return graph_query('and(callers(name("red widget"), 1), kind(all, fn))', nodes(spark, sf), edges(spark, sf))


@query(f"WITH {NODES} SELECT id, name, kind, cx, file FROM nodes WHERE (kind = 'cls' OR cx >= 30) AND NOT regexp_matches(file, '^tests/')")
def graph_query_set_algebra(spark, sf):
    return graph_query('not(or(kind(all, cls), cx(all, 30)), file(all, "^tests/"))', nodes(spark, sf), edges(spark, sf))


@query(f"{GRAPH} SELECT id, name, kind, cx, file FROM nodes WHERE id IN (SELECT dst FROM edges GROUP BY dst HAVING count(*) >= 25)")
def graph_query_fanin(spark, sf):
    return graph_query("fanin(all, 25)", nodes(spark, sf), edges(spark, sf))


@query(
    f"{GRAPH}, seed AS (SELECT id FROM nodes WHERE name = 'blue anvil'), h1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM seed)), "
    "h2 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM h1)) SELECT id, name, kind, cx, file FROM nodes WHERE id IN (SELECT id FROM h1 UNION SELECT id FROM h2) AND id NOT IN (SELECT id FROM seed)"
)
def graph_query_callees_two_hops(spark, sf):
    return graph_query('callees(name("blue anvil"), 2)', nodes(spark, sf), edges(spark, sf))


_REACH = "{w}, r(id, hop) AS (SELECT id, 0 FROM nodes WHERE {seed} UNION SELECT {to}, r.hop + 1 FROM r JOIN edges ON edges.{at} = r.id WHERE r.hop < {most}) SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id HAVING min(hop) > 0"


@query(_REACH.format(w=GRAPH, seed="id = 0", to="src", at="dst", most=40))
def impact_hops(spark, sf):
    return G.reach(edges(spark, sf), nodes(spark, sf).filter("id = 0"), forward=False)


@query(_REACH.format(w=GRAPH, seed="id % 40 = 7", to="dst", at="src", most=40))
def forward_reach_hops(spark, sf):
    return G.reach(edges(spark, sf), nodes(spark, sf).filter("id % 40 = 7"), forward=True)


@query(f"{GRAPH} SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY id")
def fan_in_out(spark, sf):
    return G.fan(edges(spark, sf))


@query(f"WITH {REFS}, {EDGES} SELECT src, dst, n_ref, round(w, 6) AS w FROM edges")
def weighted_call_edges(spark, sf):
    return rounded(edges(spark, sf), "w")


#: Rounds that the SQL has at hand; the stop rule picks the first whose change is below 1e-6.
_ROUNDS = 24


def _stopped(names: str, column: str, rounds: int) -> str:
    """The rows of the first round whose change is below the tolerance."""
    all_ = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {names}{k}" for k in range(1, rounds + 1))
    changes = " UNION ALL ".join(f"SELECT {k} AS k, c FROM c{k}" for k in range(1, rounds + 1))
    return f"SELECT {column} FROM ({all_}) WHERE k = (SELECT min(k) FROM ({changes}) WHERE c < 1e-6)"


def _rank_sql(prior: str) -> str:
    sql = f"{GRAPH}, p AS MATERIALIZED ({prior}), wout AS MATERIALIZED (SELECT src, sum(w) AS wo FROM edges GROUP BY src), li AS MATERIALIZED (SELECT e.src, e.dst, e.w / o.wo AS share FROM edges e JOIN wout o USING (src)), r0 AS (SELECT id, p AS rank FROM p)"
    for k in range(1, _ROUNDS + 1):
        sql += (
            f", d{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k-1} WHERE id NOT IN (SELECT src FROM wout))"
            f", f{k} AS (SELECT l.dst AS id, sum(l.share * r.rank) AS inflow FROM li l JOIN r{k-1} r ON r.id = l.src GROUP BY l.dst)"
            f", r{k} AS MATERIALIZED (SELECT p.id, 0.85 * coalesce(f.inflow, 0) + (0.85 * d.lost + 0.15) * p.p AS rank FROM p LEFT JOIN f{k} f USING (id) CROSS JOIN d{k} d)"
            f", c{k} AS (SELECT sum(abs(x.rank - y.rank)) AS c FROM r{k} x JOIN r{k-1} y USING (id))"
        )
    return f"{sql} {_stopped('r', 'id, round(rank, 9) AS rank', _ROUNDS)}"


_UNIFORM = "SELECT id, 1.0 / (SELECT count(*) FROM nodes)::DOUBLE AS p FROM nodes"


@query(_rank_sql(_UNIFORM))
def pagerank_uniform(spark, sf):
    return rounded(G.personalized_pagerank(nodes(spark, sf), edges(spark, sf)), "rank", digits=9)


_NAMED = "SELECT id, u / (sum(u) OVER ()) AS p FROM (SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 5 THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN starts_with(name, '_') THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN length(name) >= 8 AND contains(name, ' ') THEN 1.7 ELSE 1.0 END::DOUBLE AS u FROM nodes)"


@query(_rank_sql(_NAMED))
def pagerank_name_prior(spark, sf):
    n = nodes(spark, sf)
    return rounded(G.personalized_pagerank(n, edges(spark, sf), G.name_prior(n)), "rank", digits=9)


_HOT = "SELECT id, 0.3::DOUBLE / (SELECT count(*) FROM nodes) + CASE WHEN file = 'src/brand7.py' THEN 0.7::DOUBLE / (SELECT count(*) FROM nodes WHERE file = 'src/brand7.py') ELSE 0 END AS p FROM nodes"


@query(_rank_sql(_HOT))
def pagerank_changed_files(spark, sf):
    n = nodes(spark, sf)
    return rounded(G.personalized_pagerank(n, edges(spark, sf), G.teleport_prior(n, n.filter("file = 'src/brand7.py'"))), "rank", digits=9)


def _hits_sql(rounds: int = 16) -> str:
    sql = f"{GRAPH}, ed AS MATERIALIZED (SELECT * FROM edges), h0 AS (SELECT id, 1.0 / sqrt((SELECT count(*) FROM nodes)) AS hub, 1.0 / sqrt((SELECT count(*) FROM nodes)) AS authority FROM nodes)"
    for k in range(1, rounds + 1):
        sql += (
            f", ar{k} AS (SELECT n.id, coalesce(sum(e.w * h.hub), 0) AS v FROM nodes n LEFT JOIN ed e ON e.dst = n.id LEFT JOIN h{k-1} h ON h.id = e.src GROUP BY n.id)"
            f", a{k} AS MATERIALIZED (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM ar{k}) AS authority FROM ar{k})"
            f", hr{k} AS (SELECT n.id, coalesce(sum(e.w * a.authority), 0) AS v FROM nodes n LEFT JOIN ed e ON e.src = n.id LEFT JOIN a{k} a ON a.id = e.dst GROUP BY n.id)"
            f", h{k} AS MATERIALIZED (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM hr{k}) AS hub, authority FROM hr{k} JOIN a{k} USING (id))"
            f", c{k} AS (SELECT sum(abs(x.hub - y.hub) + abs(x.authority - y.authority)) AS c FROM h{k} x JOIN h{k-1} y USING (id))"
        )
    return f"{sql} {_stopped('h', 'id, round(authority, 9) AS authority, round(hub, 9) AS hub', rounds)}"


@query(_hits_sql())
def hits_scores(spark, sf):
    return rounded(G.hits(nodes(spark, sf), edges(spark, sf)), "authority", "hub", digits=9)


_TWO = f"{GRAPH}, a AS (SELECT dst AS id, count(*)::DOUBLE AS score FROM edges GROUP BY dst), b AS (SELECT id, cx::DOUBLE AS score FROM nodes)"


def _two(spark, sf):
    a = edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return a, nodes(spark, sf).select("id", F.col("cx").cast("double").alias("score"))


@query(f"{_TWO}, p AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM a UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM b) SELECT id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM p GROUP BY id")
def reciprocal_rank_fusion(spark, sf):
    return rounded(G.fused_rank(list(_two(spark, sf))), "score", digits=9)


@query(f"{_TWO} SELECT coalesce(a.id, b.id) AS id, round(0.7::DOUBLE * coalesce(a.score, 0) / (SELECT max(score) FROM a) + 0.3::DOUBLE * coalesce(b.score, 0) / (SELECT max(score) FROM b), 9) AS score FROM a FULL JOIN b ON a.id = b.id")
def blended_score(spark, sf):
    return rounded(G.blended(*_two(spark, sf)), "score", digits=9)


@query(
    f"{GRAPH}, both_ AS (SELECT src AS id, dst AS t, w, 1 AS way FROM edges UNION ALL SELECT dst, src, w, -1 FROM edges), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY w DESC, t) AS nth FROM both_) WHERE nth <= 8), "
    "h1 AS (SELECT t AS id, 1 AS hop, max(way) AS direction FROM top WHERE id = 11 AND t <> 11 GROUP BY t), "
    "h2 AS (SELECT t AS id, 2 AS hop, max(way) AS direction FROM top JOIN h1 ON h1.id = top.id AND h1.direction = top.way WHERE t <> 11 AND t NOT IN (SELECT id FROM h1) GROUP BY t) "
    "SELECT id, hop::INTEGER AS hop, direction::INTEGER AS direction FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)"
)
def ego_network(spark, sf):
    return G.ego(edges(spark, sf), nodes(spark, sf).filter("id = 11"), depth=2, fan_out=8)


@query()
def shortest_call_path(spark, sf):
    one = lambda i: nodes(spark, sf).filter(F.col("id") == i)
    path = G.shortest_path(edges(spark, sf), one(3), one(42))
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(path)], "nth int, id long")


@query(
    f"{GRAPH}, r(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, edges.dst FROM r JOIN edges ON edges.src = r.b), mutual AS (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a WHERE r.a <> r.b) "
    "SELECT a AS id, least(a, min(b)) AS component FROM mutual GROUP BY a"
)
def dependency_cycles(spark, sf):
    return G.cycles(edges(spark, sf))


_FILES = f"{GRAPH}, fe AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.file <> b.file), files AS (SELECT DISTINCT file AS id FROM nodes)"


def _file_graph(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return e.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), n.select(F.col("file").alias("id")).distinct()


@query(
    f"{_FILES}, r(a, b) AS (SELECT src, dst FROM fe UNION SELECT r.a, fe.dst FROM r JOIN fe ON fe.src = r.b), t AS (SELECT (SELECT count(*) FROM files) AS n, (SELECT count(*) FROM files) + (SELECT count(*) FROM r WHERE a <> b) AS ccd) "
    "SELECT n, ccd, round(ccd / n::DOUBLE, 6) AS acd, round(ccd / ((n + 1) * log2(n + 1) - n), 6) AS nccd, round(ccd / (n::DOUBLE * n), 6) AS propagation FROM t"
)
def dependency_health(spark, sf):
    return rounded(G.health(*_file_graph(spark, sf)), "acd", "nccd", "propagation")


@query(
    f"{GRAPH}, m AS (SELECT id, file AS module, (kind = 'iface')::INTEGER AS ab FROM nodes), e AS (SELECT DISTINCT a.module AS a, b.module AS b FROM edges x JOIN m a ON a.id = x.src JOIN m b ON b.id = x.dst WHERE a.module <> b.module), "
    "ca AS (SELECT b AS module, count(*) AS ca FROM e GROUP BY b), ce AS (SELECT a AS module, count(*) AS ce FROM e GROUP BY a), "
    "t AS (SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, abst FROM (SELECT module, avg(ab) AS abst FROM m GROUP BY module) LEFT JOIN ca USING (module) LEFT JOIN ce USING (module)), "
    "u AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce / (ca + ce)::DOUBLE END AS i FROM t), v AS (SELECT *, abs(abst + i - 1) AS d FROM u) "
    "SELECT module, ca, ce, round(i, 6) AS instability, round(abst, 6) AS abstractness, round(d, 6) AS distance, CASE WHEN d > 0.5 THEN CASE WHEN abst + i < 1 THEN 'pain' ELSE 'uselessness' END WHEN d IS NOT NULL THEN 'main' END AS zone FROM v"
)
def module_metrics(spark, sf):
    s = nodes(spark, sf).select("id", F.col("file").alias("module"), (F.col("kind") == "iface").alias("abstract"))
    return rounded(quality.module_metrics(edges(spark, sf), s), "instability", "abstractness", "distance")


@query(
    f"{GRAPH}, pe AS (SELECT DISTINCT a.file AS src_path, b.file AS dst_path FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst) "
    "SELECT src_path, dst_path, 'deny src -> tests' AS rule FROM pe WHERE contains(src_path, 'src/') AND contains(dst_path, 'tests/') AND NOT (contains(src_path, 'brand1') AND contains(dst_path, 'tests/'))"
)
def arch_rule_violations(spark, sf):
    from delvegraph.sources.rules import rules_table

    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("file").alias("src_path")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("dst_path")), "dst").select("src_path", "dst_path").distinct()
    rules = rules_table(spark, "layer src = src/\nlayer tests = tests/\ndeny src -> tests\nallow brand1 -> tests\n")
    return quality.rule_violations(e, rules)


@query(f"{OFTEN} SELECT id, name, file FROM nodes WHERE kind IN ('fn', 'method') AND id NOT IN (SELECT dst FROM often)")
def dead_symbols(spark, sf):
    s = nodes(spark, sf).withColumn("internal", F.col("kind").isin("fn", "method"))
    return quality.dead_code(s, often(spark, sf)).select("id", "name", "file")


_GATE = f"{OFTEN}, changed AS (SELECT id FROM nodes WHERE file = 'src/brand7.py'), r(id) AS (SELECT id FROM changed UNION SELECT src FROM r JOIN often ON often.dst = r.id), radius AS (SELECT id FROM r WHERE id NOT IN (SELECT id FROM changed))"


@query(f"{_GATE} SELECT file, count(*) AS symbols FROM nodes WHERE id IN (SELECT id FROM radius) AND starts_with(file, 'tests/') GROUP BY file")
def test_gate_tests(spark, sf):
    n = nodes(spark, sf)
    return testgate.gate(n, often(spark, sf), n.filter("file = 'src/brand7.py'"))[0]


@query(
    f"{_GATE}, tr(id) AS (SELECT id FROM nodes WHERE starts_with(file, 'tests/') UNION SELECT dst FROM tr JOIN often ON often.src = tr.id) "
    "SELECT id, name, file, cx FROM nodes WHERE id IN (SELECT id FROM radius) AND NOT starts_with(file, 'tests/') AND id NOT IN (SELECT id FROM tr)"
)
def test_gate_untested(spark, sf):
    n = nodes(spark, sf)
    return testgate.gate(n, often(spark, sf), n.filter("file = 'src/brand7.py'"))[1]


@query(f"{OFTEN}, tr(id) AS (SELECT id FROM nodes WHERE file = 'tests/brand15.py' UNION SELECT dst FROM tr JOIN often ON often.src = tr.id) SELECT id FROM tr WHERE id IN (SELECT id FROM nodes WHERE NOT starts_with(file, 'tests/'))")
def exercised_symbols(spark, sf):
    n = nodes(spark, sf)
    return testgate.exercised(n, often(spark, sf), n.filter("file = 'tests/brand15.py'"))


@query(
    f"{OFTEN}, tr(id) AS (SELECT id FROM nodes WHERE starts_with(file, 'tests/') UNION SELECT dst FROM tr JOIN often ON often.src = tr.id) "
    "SELECT a.file AS src_file, b.file AS dst_file, count(*) AS n_edges FROM often e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.file <> b.file AND e.dst NOT IN (SELECT id FROM tr) GROUP BY 1, 2"
)
def untested_seams(spark, sf):
    return testgate.seams(nodes(spark, sf), often(spark, sf))


@query(f"{GRAPH} SELECT a.file AS src_file, b.file AS dst_file, sum(e.n_ref)::BIGINT AS calls FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.file <> b.file GROUP BY 1, 2")
def module_call_graph(spark, sf):
    return testgate.module_graph(nodes(spark, sf), edges(spark, sf))


@query(
    f"{GRAPH}, u AS (SELECT src AS id, dst AS t FROM edges UNION SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT id, count(*) AS cbo FROM u GROUP BY id"
)
def coupling_between_objects(spark, sf):
    from delvegraph.queries.registry import table

    members = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("to")).distinct()
    return quality.coupling(edges(spark, sf).select(F.col("src").alias("id"), F.col("dst").alias("to")), members)


@query(
    f"{GRAPH}, a0 AS (SELECT id, file AS cell, (cx % 5 = 0)::INTEGER AS reads, (cx % 7 = 0)::INTEGER AS writes FROM nodes), "
    "up(id, cell, reads, writes) AS (SELECT id, cell, reads, writes FROM a0 UNION SELECT o.src, up.cell, up.reads, up.writes FROM up JOIN edges o ON o.dst = up.id) SELECT id, cell, max(reads)::INTEGER AS reads, max(writes)::INTEGER AS writes FROM up GROUP BY id, cell"
)
def state_access_closure(spark, sf):
    access = nodes(spark, sf).select("id", F.col("file").alias("cell"), (F.col("cx") % 5 == 0).cast("int").alias("reads"), (F.col("cx") % 7 == 0).cast("int").alias("writes"))
    return quality.propagate_bits(edges(spark, sf), access)


@query()
def louvain_communities(spark, sf):
    return kernels.communities(edges(spark, sf))


@query()
def community_zoom(spark, sf):
    return kernels.zoom(edges(spark, sf))


@query()
def connect_terminals(spark, sf):
    return spark.createDataFrame(kernels.connect(edges(spark, sf), [3, 42, 77]), "a long, b long")


@query(f"WITH {NODES} SELECT id, name, (SELECT count(*) FROM nodes)::INTEGER AS total, 25 AS shown, true AS capped FROM nodes ORDER BY name, id LIMIT 25 OFFSET 10")
def paged_listing(spark, sf):
    return page(nodes(spark, sf).select("id", "name"), ["name", "id"], 10, 25)


@query(
    f"{GRAPH}, k AS (SELECT id, name, kind, file, row_number() OVER (PARTITION BY file ORDER BY cx DESC, id) AS nth FROM nodes) SELECT file, nth::INTEGER AS nth, id, name, kind FROM k WHERE nth <= 3"
)
def top_symbols_per_file(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("cx"), "id"))
    return nodes(spark, sf).withColumn("nth", nth).filter("nth <= 3").select("file", "nth", "id", "name", "kind")


@query(f"WITH {NODES} SELECT file, kind, grouping(kind)::INTEGER AS rolled, count(*) AS symbols, sum(cx)::BIGINT AS complexity FROM nodes GROUP BY ROLLUP (file, kind) HAVING grouping(file) = 0")
def file_kind_rollup(spark, sf):
    return nodes(spark, sf).rollup("file", "kind").agg(F.grouping("kind").cast("int").alias("rolled"), F.grouping("file").alias("g"), F.count(F.lit(1)).alias("symbols"), F.sum("cx").alias("complexity")).filter("g = 0").drop("g")


@query(
    f"{GRAPH}, inh AS (SELECT DISTINCT a.id AS derived, b.id AS base FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.kind IN ('cls', 'struct', 'iface') AND b.kind IN ('cls', 'struct', 'iface')), "
    "up(id) AS (SELECT base FROM inh WHERE derived % 40 = 3 UNION SELECT base FROM up JOIN inh ON inh.derived = up.id), dn(id) AS (SELECT derived FROM inh WHERE base % 40 = 3 UNION SELECT derived FROM dn JOIN inh ON inh.base = dn.id) "
    "SELECT id FROM nodes WHERE id % 40 = 3 UNION SELECT id FROM up UNION SELECT id FROM dn"
)
def class_cones(spark, sf):
    from delvegraph.operators import bundles

    n = nodes(spark, sf)
    c = n.filter(F.col("kind").isin("cls", "struct", "iface")).select("id")
    inh = edges(spark, sf).join(c.select(F.col("id").alias("src")), "src", "left_semi").join(c.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("derived"), F.col("dst").alias("base"))
    return bundles.class_cone(inh, n.filter("id % 40 = 3"))


@query(f"{GRAPH}, r(id) AS (SELECT id FROM nodes WHERE name LIKE 'red%' UNION SELECT src FROM r JOIN edges ON edges.dst = r.id) SELECT id FROM r")
def impure_symbols(spark, sf):
    from delvegraph.operators import bundles

    return bundles.impure(nodes(spark, sf), edges(spark, sf), "^red")


@query(
    f"{GRAPH}, ch AS (SELECT id FROM nodes WHERE id % 90 = 1), r(id, hop) AS (SELECT id, 0 FROM ch UNION SELECT edges.src, r.hop + 1 FROM r JOIN edges ON edges.dst = r.id WHERE r.hop < 30), m AS (SELECT id, min(hop) AS hop FROM r GROUP BY id) "
    "SELECT id, CASE WHEN hop = 0 THEN 'changed' WHEN hop = 1 THEN 'caller' ELSE 'radius' END AS role, hop::INTEGER AS hop FROM m"
)
def change_situation(spark, sf):
    from delvegraph.operators import bundles

    n = nodes(spark, sf)
    return bundles.situation(n, edges(spark, sf), n.filter("id % 90 = 1"))


@query(
    f"{GRAPH}, tr(id) AS (SELECT id FROM nodes WHERE starts_with(file, 'tests/') UNION SELECT dst FROM tr JOIN edges ON edges.src = tr.id), td AS (SELECT id FROM tr WHERE id NOT IN (SELECT id FROM nodes WHERE starts_with(file, 'tests/'))), "
    "f AS (SELECT dst AS id, count(*) AS fan_in FROM edges GROUP BY dst) SELECT n.id, n.name, n.file FROM nodes n LEFT JOIN f USING (id) WHERE kind = 'fn' "
    "ORDER BY (cx > 40)::INTEGER, starts_with(file, 'tests/')::INTEGER, (n.id IN (SELECT id FROM td))::INTEGER DESC, coalesce(fan_in, 0) DESC, cx, cx, n.id LIMIT 1"
)
def exemplar_symbol(spark, sf):
    from delvegraph.operators import bundles

    n = nodes(spark, sf).withColumn("ccx", F.col("cx")).withColumn("loc", F.col("cx"))
    return bundles.exemplar(n, edges(spark, sf), "fn", ceiling=40).select("id", "name", "file")


@query(
    f"WITH {NODES}, r AS (SELECT id, cx, row_number() OVER (ORDER BY cx DESC, id) AS place FROM nodes), l AS (SELECT id, place, sum(10) OVER (ORDER BY place) AS c FROM r), b AS (SELECT id, place, sum(cx) OVER (ORDER BY place) AS c FROM r) "
    "SELECT 'ranking' AS section, id, place::INTEGER AS place, c::BIGINT AS cost_so_far FROM l WHERE c <= 450 UNION ALL SELECT 'bodies', id, place::INTEGER, c::BIGINT FROM b WHERE c <= 300"
)
def task_bundle(spark, sf):
    from pyspark.sql import Window

    from delvegraph.operators import bundles

    n = nodes(spark, sf)
    ranked = n.select("id", F.row_number().over(Window.orderBy(F.desc("cx"), "id")).alias("place"))
    return bundles.task_bundle(ranked, n.select("id", F.lit(10).alias("list_cost"), F.col("cx").alias("body_cost")), budget=1000)


@query()
def partitioned_bundle(spark, sf):
    from delvegraph.operators import bundles

    n, e = nodes(spark, sf), edges(spark, sf)
    fan = G.fan(e).select("id", F.col("fan_in").alias("shared"))
    sizes = n.select("id", F.col("cx").alias("size")).join(fan, "id", "left").fillna(0, ["shared"])
    return bundles.partition_bins(sizes, kernels.communities(e), 4)


@query(f"{GRAPH}, s AS (SELECT id, cx::DOUBLE AS score FROM nodes WHERE cx >= 45), m AS (SELECT DISTINCT dst AS id, src AS sym_id FROM edges), t AS (SELECT id AS sym_id, score AS s FROM s ORDER BY score DESC, id LIMIT 8), h AS (SELECT m.id, t.s, row_number() OVER (PARTITION BY sym_id ORDER BY m.id) AS k FROM m JOIN t USING (sym_id)), l AS (SELECT id, max(s) AS s FROM h WHERE k <= 2 GROUP BY id ORDER BY 2 DESC, 1 LIMIT 6) SELECT coalesce(s.id, l.id) AS id, round(greatest(coalesce(score, 0), coalesce(l.s * 0.55, 0)), 6)::DOUBLE AS score FROM s FULL JOIN l ON s.id = l.id")
def doc_mention_boost(spark, sf):
    from delvegraph.operators import bundles

    scores = nodes(spark, sf).filter("cx >= 45").select("id", F.col("cx").cast("double").alias("score"))
    mentions = edges(spark, sf).select(F.col("dst").alias("id"), F.col("src").alias("sym_id")).distinct()
    return rounded(bundles.doc_mention_boost(scores, mentions), "score")


@query(f"WITH {NODES} SELECT id, array_to_string(list_filter([CASE WHEN length(k) <= 2 THEN 'short' END, CASE WHEN contains(k, '_') AND regexp_matches(k, '[a-z][A-Z]') THEN 'mixed-style' END], lambda x: x IS NOT NULL), ',') AS broken FROM (SELECT id, CASE id % 3 WHEN 0 THEN name[:2] WHEN 1 THEN replace(name, ' ', '_') || 'Xy' ELSE replace(name, ' ', '_') END AS k FROM nodes)")
def name_shapes(spark, sf):
    from delvegraph.operators import bundles

    k = F.when(F.col("id") % 3 == 0, F.substring("name", 1, 2)).when(F.col("id") % 3 == 1, F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("Xy"))).otherwise(F.replace("name", F.lit(" "), F.lit("_")))
    return nodes(spark, sf).select("id", F.array_join(bundles.name_shape(k), ",").alias("broken"))
