"""Queries over their whole tables: no slices in them or their SQL, or brute force."""

import inspect
import random

import pytest

from delvegraph import catalog
from delvegraph.operators import clones, mining

#: Slices that query or oracle once held and neither may hold again.
SLICES = {
    **dict.fromkeys(["quality_delta", "quality_delta_acknowledged", "maintainability_delta", "edit_contracts"], [" WHERE l_partkey % 5 = 0"]),
    "enclosing_symbols": [" WHERE o_orderkey % 7 = 0"],
    "merge_conflicts": [" WHERE o_orderkey % 40 = 1"],
    **dict.fromkeys(["stray_lines", "stray_verdicts"], [" WHERE o_orderkey % 9 = 2"]),
    "field_affinity": [" WHERE o_orderkey % 50 = 0"],
    "readability_scores": [" WHERE doc_id % 10 = 0"],
    "comment_coherence": [" WHERE doc_id % 7 = 0", "text[:300]"],
    "xml_escape": [" WHERE doc_id % 20 = 0"],
    "dependency_cycles": [" WHERE (src * 7 + dst * 13) % 17 = 0"],
    "module_metrics": [" AND (x.src + x.dst) % 97 = 0"],
    "arch_rule_violations": [" WHERE (e.src + e.dst) % 97 = 0"],
    "state_access_closure": [" WHERE id % 50 = 3"],
}


@pytest.mark.parametrize("name", sorted(SLICES))
def test_query_covers_the_whole_tables(name):
    sql, code = catalog.oracle_sql()[name], inspect.getsource(catalog.queries()[name])
    for cut in SLICES[name]:
        assert cut not in sql and cut.removeprefix(" WHERE ") not in code


def test_violation_groups_cover_every_surprising_pair(spark, sf):
    q = catalog.queries()
    pairs = [(r.a, r.b) for r in q["surprising_cochange"](spark, sf).collect()]
    got = q["violation_groups"](spark, sf).orderBy("nth").collect()
    assert len(pairs) > 500 and sum(r.pairs for r in got) == len(pairs)
    assert [(r.nth, r.file, r.pairs) for r in got] == [(i, f, len(p)) for i, (f, p) in enumerate(mining.greedy_cover(pairs))]


def test_landing_order_sees_all_orders(spark, tmp_path):
    tables = {
        "orders": ([(2, "a"), (3, "b"), (4, "c")], "o_orderkey long, o_orderpriority string"),
        "lineitem": ([(2, 7), (3, 7), (3, 8), (4, 8)], "l_orderkey long, l_partkey long"),
        "part": ([(7, "f"), (8, "f")], "p_partkey long, p_brand string"),
    }
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    # b clashes with a and c; a goes first, then b and c clash once each
    assert [r.arm for r in catalog.queries()["landing_order"](spark, str(tmp_path)).orderBy("nth").collect()] == ["a", "b", "c"]


def test_near_clones_meet_in_groups_over_the_bucket(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [[*base, *(f"u{k}" for _ in range(3))] for k in range(12)]  # a group over the bucket: all share 56 grams
    rows += [rows[0], [rng.choice("xyz") + str(rng.randrange(40)) for _ in range(50)], base[:20]]
    for k in range(10):  # random edits
        rows.append([t if rng.random() > 0.06 else f"v{k}" for t in base])
    rows += [list("abcdefghijklmnopqrst") + [f"t{k}"] for k in range(9)]  # no rare gram but one

    def grams(x):
        return {tuple(x[i : i + 5]) for i in range(max(len(x) - 4, 1))}

    want = set()
    for a, x in enumerate(rows):
        for b in range(a + 1, len(rows)):
            y, m = rows[b], min(len(x), len(rows[b]))
            common = len(grams(x) & grams(y))
            r = 2 * clones.lcs_length(x, y) / (len(x) + len(y))
            if m >= 0.7 * max(len(x), len(y)) and common >= max(1, 0.25 * m - 5) and 0.8 <= r < 1:
                want.add((a, b, round(r, 9)))
    df = spark.createDataFrame(list(enumerate(rows)), "id long, stream array<string>")
    for bucket in (4, 1024):
        got = clones.near_clones(df, bucket=bucket).collect()
        assert len(got) == len(want) and {(r.a, r.b, round(r.ratio, 9)) for r in got} == want
