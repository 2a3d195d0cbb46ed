"""The ten queries on the smallest tables against brute force, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from delvegraph.llm import queries as Q
from delvegraph.llm.decontaminate import find_overlap, remove_overlap
from delvegraph.llm.embed_dedup import near_vectors
from delvegraph.llm.language_id import fit_on, identify
from delvegraph.llm.lm_score import score_texts
from delvegraph.llm.minhash_dedup import keep_one, near_duplicates
from delvegraph.llm.packing import pack
from delvegraph.llm.secret_scan import mask_hits, scan_history
from delvegraph.llm.sharding import byte_balanced_shards
from delvegraph.llm.suffix_dedup import remove_repeats
from delvegraph.llm.token_count import count_tokens

RUN = Q.queries()


def run(spark, sf, n):
    name = next(k for k in RUN if k.startswith(f"op{n}_"))
    return [r.asDict() for r in RUN[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(spark, sf):
    src = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in src], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r.vec_id for r in src]
    s = x @ x.T
    deg = dict(zip(ids, ((s >= 0.9).sum(axis=1) - 1).tolist(), strict=True))
    comp = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= 0.9), strict=True)])
    for r in run(spark, sf, 1):
        assert (r["n_links"], r["component_id"], r["kept"]) == (deg[r["vec_id"]], comp[r["vec_id"]], comp[r["vec_id"]] == r["vec_id"])
    small = near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), shard_bytes=1 << 12, slice_rows=100)
    assert {r.vec_id: (r.n_links, r.component_id) for r in small.collect()} == {i: (deg[i], comp[i]) for i in ids} and small.audit_recall >= 0.999


def test_vectors_of_one_id_and_without_an_id(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [1.0, 0.01], "c"), (None, [1.0, 0.0], "d"), (3, [0.01, 1.0], "e")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_op2(spark, sf, docs):
    seen, want = set(), {}
    for k in sorted(docs):
        t = (docs[k] or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(t[i : i + 100])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        want[k] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    for r in run(spark, sf, 2):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_op3(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = run(spark, sf, 3)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_op4(spark, sf, docs):
    rows = run(spark, sf, 4)
    size = {k: len((t or "").encode()) + 1 for k, t in docs.items()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode())
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(8))
    total = sum(size.values())
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
        assert abs(sum(r["size"] for r in s) - total / 8) <= max(size.values())
    assert len(rows) == len(docs)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def spans_of(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_op5(spark, sf, docs):
    for r in run(spark, sf, 5):
        want = spans_of(docs[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


def test_op6(spark, sf, docs):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wins = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = rx.findall((r.text or "").translate(low))
        for i in range(max(1, len(w) - 12)):
            if w:
                wins[tuple(w[i : i + 13])].add(str(r.item_id))
    sizes = {len(w) for w in wins}
    for r in run(spark, sf, 6):
        w = rx.findall((docs[r["doc_id"]] or "").translate(low))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(items))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))


def test_op7(spark, sf, docs):
    toks = {k: (t or "").encode().lower().split() + [b"\n"] for k, t in docs.items()}
    c = Counter(w for k, t in toks.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in run(spark, sf, 7):
        t = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * max(1, abs(r["base_score"]))
        assert r["score"] < 0


def test_op7_counts_ids_exactly_and_beats_the_base(spark, monkeypatch):
    from delvegraph.llm import lm_score

    seen = []
    fit = lm_score.fit_network
    monkeypatch.setattr(lm_score, "fit_network", lambda train, counts, *a: (seen.append(counts.copy()), fit(train, counts, *a))[1])
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    rows = Q.op7_attention_scores(spark, "/root/testdata/sf0.01").collect()
    enc = lm_score.Subwords(lm_score.default_path())
    want = np.zeros(enc.size + 1, np.int64)
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            want[:-1] += np.bincount(enc.ids(t), minlength=enc.size)
            want[-1] += 1
    assert (seen[0] == want).all()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(texts) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op7_learns_from_every_window_of_every_training_text(spark, monkeypatch):
    from delvegraph.llm import lm_score

    steps = {}
    write = lm_score.materialize

    def spy(df, tag, *a, **k):
        out = write(df, tag, *a, **k)
        if tag == "lm-weights":  # every step touches the bias of each class
            steps["bias"] = [np.frombuffer(r.touches, "<f4") for r in out.filter("name = 'bias'").collect()]
        return out

    monkeypatch.setattr(lm_score, "materialize", spy)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, 150)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = score_texts(docs, seed_windows=300).collect()
    enc = lm_score.Subwords(lm_score.default_path())
    windows = sum(len(enc.ids(t)) // lm_score.SCORED + 1 for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2)
    assert len(rows) == len(texts) and windows > 600
    assert (steps["bias"][0] == -(-windows // 256)).all()  # steps of 256 windows, in one task


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, k):
    sets = {d: shingles(t, k) for d, t in docs.items()}
    inv = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inv[g].append(d)
    links = [(d, e) for d, s in sets.items() for e, n in Counter(e for g in s for e in inv[g] if e > d).items() if 100 * n >= 80 * len(s | sets[e])]
    return sets, components(docs, links)


def test_op8(spark, sf, docs):
    sets, comp = near(docs, 4)
    for r in run(spark, sf, 8):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from delvegraph.llm.encoding import default_path

    return Tokenizer.from_file(default_path())


def test_op9(spark, sf, docs, tokenizer):
    rows = run(spark, sf, 9)
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist() and sum(r["length"] for r in parts) == len(ids[k])
    assert set(by_doc) == set(docs)
    for s, parts in by_seq.items():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
        assert sum(r["length"] for r in parts) == 4096 or s == max(by_seq)


def test_op10(spark, sf, docs, tokenizer):
    for r in run(spark, sf, 10):
        t = docs[r["doc_id"]] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


# ------------------------------------------------------------------ odd rows

ODD = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, "   \n", None, "s", 4), (4, "12 34 !!", "en", "s", 8), (None, "some words that stand here", "en", "s", 1), (5, "word " * 30_000, "en", "s", 1), (6, "The same text, twice over here.", "en", "s", 1), (6, "The same text, twice over here.", "en", "s", 1), (7, "the SAME text, twice over here.", None, "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    for c in ("size", "shard", "spans", "items", "ids", "id", "row", "score", "blob", "path", "digest", "rep"):  # clashing names
        d = d.withColumn(c, F.lit("x"))
    return d


def test_odd_rows_everywhere(spark, odd, sf):
    bench = spark.createDataFrame([(1, "stand here"), (2, None), (None, "zzz")], "item_id long, text string")
    n = len(ODD)
    for df in (
        byte_balanced_shards(odd, 8),
        remove_repeats(odd, 100),
        near_duplicates(odd),
        count_tokens(odd),
        find_overlap(odd, bench),
        scan_history(odd)[0],
        identify(odd, fit_on(odd, F.lit(True))),
        score_texts(odd),
    ):
        assert df.count() == n
    assert pack(odd).select("doc_id").distinct().count() == 8
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 7").count() == 0 and kept.filter("doc_id is null").count() == 1
    clean = remove_overlap(odd, bench)
    assert clean.columns == odd.columns and clean.filter("doc_id is null").count() == 0


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for df in (byte_balanced_shards(none), remove_repeats(none), near_duplicates(none), count_tokens(none), find_overlap(none, none.select(F.col("doc_id").alias("item_id"), "text")), scan_history(none)[0], pack(none), score_texts(none), identify(none, fit_on(none, F.lit(True)))):
        assert df.count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(v).count() == 0


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [0.0, float("inf")])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 7: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 8: (0, 8), 9: (0, 9), 10: (0, 10)}


def test_blocks_of_families_and_benchmarks_do_not_change_results(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: 100 - i % 4], *(f"x{i}_{j}" for j in range(i % 4))])) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    one = {tuple(r) for r in near_duplicates(d).collect()}
    assert one == {tuple(r) for r in near_duplicates(d, block_docs=4).collect()}
    _, comp = near(dict(rows), 5)
    assert {(r[0], r[2]) for r in one} == set(comp.items())
    b = spark.createDataFrame([(i, " ".join(base[i : i + 20])) for i in range(0, 80, 7)], "item_id long, text string")
    assert {str(r) for r in find_overlap(d, b).collect()} == {str(r) for r in find_overlap(d, b, block_words=30).collect()}


def test_secret_ledger_scans_only_what_is_new(spark):
    v1 = spark.createDataFrame([("a", 'token = "abcdefghijkl1234"'), ("b", "AKIA" + "B" * 16)], "doc_id string, text string")
    found, ledger = scan_history(v1)
    ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    v2 = v1.unionByName(spark.createDataFrame([("c", "deadbeefdeadbeef00"), ("d", 'token = "abcdefghijkl1234"')], "doc_id string, text string"))
    found2, new = scan_history(v2, ledger)
    assert new.select("blob").distinct().count() == 1
    hits = {r.path: [h.kind for h in r.hits] for r in found2.collect()}
    assert hits == {"a": ["assign"], "b": ["access"], "c": ["hex"], "d": ["assign"]}
    masked = {r[0]: r[1] for r in v2.join(found2, F.col("doc_id") == F.col("path")).select("doc_id", mask_hits(F.col("text"), F.col("hits"))).collect()}
    assert masked["a"] == '[REDACTED:assign]"' and masked["c"] == "[REDACTED:hex]"


def test_many_hits_in_one_text_and_a_ledger_of_earlier_runs(spark, tmp_path):
    from delvegraph.llm.secret_scan import Ledger, findings, versions_of

    many = "".join(f"é{i:016x} \U0001f600\ufeff" for i in range(3000))
    v1 = spark.createDataFrame([(1, many), (2, None), (3, "")], "doc_id long, text string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.rows() is None
    ledger.commit(versions_of(v1))
    n = ledger.rows().count()
    ledger.commit(versions_of(v1))
    assert ledger.rows().count() == n  # nothing was new
    v2 = v1.unionByName(spark.createDataFrame([(4, many), (5, "AKIA" + "B" * 16 + "0123456789abcdef")], "doc_id long, text string"))
    ledger.commit(versions_of(v2))
    assert ledger.rows().count() == n + 6  # one new blob, six rules
    hits = findings(versions_of(v2), ledger.rows()).withColumnRenamed("path", "doc_id")
    got = {r.doc_id: [(h.start, h.stop) for h in r.hits] for r in hits.collect()}
    assert got[1] == got[4] == [m.span() for m in re.finditer("[0-9a-f]{16,}", many)] and got[2] == got[3] == []
    masked = {r[0]: r[1] for r in v2.join(hits, "doc_id").select("doc_id", mask_hits(F.col("text"), F.col("hits"))).collect()}
    assert masked[1] == re.sub("[0-9a-f]{16,}", "[REDACTED:hex]", many) and masked[2] is None and masked[3] == ""


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as P

    for c in ("lang_pred", "row", "__key", "__hits", "hits", "_gone", "doc", "masked", "text2", "key", "deal"):
        odd = odd.withColumn(c, F.lit("mine"))
    spark.createDataFrame([(1, "stand here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, odd.limit(0)):
        now = table
        for name, stage in P.STAGES[:-1]:
            out = P.materialize(stage(spark, now, str(tmp_path)), name)
            assert out.dtypes == table.dtypes
            rows = out.collect()
            assert all(r["lang_pred"] == r["__key"] == r["_gone"] == "mine" and r["score"] == "x" for r in rows)
            if name != "language":  # on all odd rows, too: only the pipeline drops what has no language
                alone = stage(spark, table, str(tmp_path))
                assert alone.columns == table.columns and alone.count() <= table.count()
            now = out
        assert P.STAGES[-1][1](spark, now, str(tmp_path)).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf}/documents.parquet")
    cols, now, left = d.columns, d, set(docs)
    for name, stage in P.STAGES[:-1]:
        now = P.materialize(stage(spark, now, sf), name)
        assert now.columns == cols and dict(now.dtypes) == dict(d.dtypes)
        rows = {r.doc_id: r.text for r in now.collect()}
        assert set(rows) <= left
        if name == "near_duplicates":
            _, comp = near({k: docs[k] for k in left}, 5)
            assert set(rows) == {k for k in left if comp[k] == k}
        if name == "secrets":
            assert all(not spans_of(t) for t in rows.values())
        left = set(rows)
    packed = P.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
