"""DuckDB oracles of the queries that SQL can express."""

from __future__ import annotations

from delvegraph.llm.secret_scan import RULES

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = "reached(id, to_) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.to_)"

OP1 = (
    "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9), "
    f"{_COMPONENTS} SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(to_) FROM reached WHERE id = vec_id), vec_id)) AS component_id, "
    "vec_id <= coalesce((SELECT min(to_) FROM reached WHERE id = vec_id), vec_id) AS kept FROM embeddings"
)


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return "[" + ", ".join(out) + "]::BIGINT[]"


OP4 = (
    f"WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents), tbl AS (SELECT {_crc_table()} AS t), "
    "b AS (SELECT doc_id, size, list_prepend(4294967295::BIGINT, list_transform(range(0, (length(h) / 2)::BIGINT), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)) AS bytes FROM d), "
    "c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, tbl), "
    "p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM c), "
    "s AS (SELECT *, least(7, ((2 * start + size) * 8) // (2 * total))::INTEGER AS shard FROM p) "
    "SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s"
)


def _op5() -> str:
    parts, kinds = [], []
    for k, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        body = f"regexp_extract(m, '{rx}', {r.group})" if r.group else "m"
        parts.append(
            f"k{k} AS (SELECT doc_id, m, i, g FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{rx}')) AS m, generate_subscripts(regexp_extract_all(t, '{rx}'), 1) AS i, string_split_regex(t, '{rx}') AS g FROM d WHERE regexp_matches(t, '{rx}'))), "
            f"s{k} AS (SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x))) + sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(m) AS start, {k} AS ord, length(m) AS n, '{r.kind}' AS kind, length({body}) >= {r.min_length} AS ok FROM k{k})"
        )
        kinds.append(f"SELECT doc_id, start::BIGINT AS start, ord, (start + n)::BIGINT AS stop, kind FROM s{k} WHERE ok")
    text = "kind || ':' || start || ':' || stop"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, h AS ({' UNION ALL '.join(kinds)}), "
        f"a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg({text}, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans FROM h GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


_WORDS6 = "list_filter(string_split_regex(" + _LOWER.format(t="coalesce(text, '')") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP6 = (
    f"WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_WORDS6} AS w FROM benchmark), "
    "iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 12, 1)), sizes AS (SELECT DISTINCT n FROM iw), "
    "dw AS (SELECT doc_id, n, p.i AS i, array_to_string(w[p.i:p.i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) p), "
    "f AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN iw ON iw.n = dw.n AND iw.s = dw.s), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY doc_id), "
    "it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY doc_id) "
    "SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"
)

_WORDS8 = "list_filter(string_split_regex(" + _LOWER.format(t="coalesce(text, '')") + ", '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP8 = (
    f"WITH RECURSIVE d AS (SELECT doc_id, {_WORDS8} AS w FROM documents), "
    "sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)), "
    "n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2), "
    "links AS (SELECT a, b FROM pr JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)), "
    f"{_COMPONENTS}, m AS (SELECT id, min(to_) AS m FROM reached GROUP BY id) "
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.m, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id"
)

ORACLES = {"op1_hnsw_near_vectors": OP1, "op4_byte_balanced_shards": OP4, "op5_secret_ledger": _op5(), "op6_suffix_automaton_overlap": OP6, "op8_odd_sketch_dedup": OP8}
