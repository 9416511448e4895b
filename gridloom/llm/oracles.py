"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 2, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

OP4 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, 'allow') AS verdict
FROM (SELECT p.*, (SELECT max_by({'rule': h || rp, 'v': v}, length(h || rp)) FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, rp)) AS r FROM p) b
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH q AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
i AS (SELECT item_id, least(5, len(ws)) AS n, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS k, ws FROM q WHERE len(ws) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS s FROM i),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ns AS (SELECT DISTINCT n FROM items),
ds AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, ns WHERE len(ws) >= n),
docs AS (SELECT DISTINCT doc_id, n, array_to_string(ws[k:k + n - 1], ' ') AS s FROM ds),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM hits JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT doc_id, ws, least(5, len(ws)) AS n, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS k FROM d WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[k:k + n - 1], ' ') AS s FROM k),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= 75 * (ca.n + cb.n - i)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.a = doc_id
"""



def _op12(rounds: int = 3) -> str:
    """Each round's assignment and centroids as tables of their own; whole numbers in doubles and HUGEINT."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64)",
        "e AS MATERIALIZED (SELECT r, vec_id, i, CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE) AS c FROM (SELECT r, vec_id, unnest(range(64)) AS i, unnest(embedding) AS c FROM v))",
        "x AS MATERIALIZED (SELECT r, vec_id, list(c ORDER BY i) AS x FROM e GROUP BY r, vec_id HAVING count(c) = 64 AND bool_and(isfinite(c)))",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM x ORDER BY h LIMIT 16))",
    ]
    for n in range(rounds + 1):
        d = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, m.k AS cluster, CAST(m.d AS BIGINT) AS distance FROM (SELECT r, vec_id, min({{'d': {d}, 'k': cluster}}) AS m FROM x, c{n} GROUP BY r, vec_id))")
        if n < rounds:
            parts.append(f"m{n} AS MATERIALIZED (SELECT a.cluster, i, sum(CAST(c AS HUGEINT)) AS s, count(*) AS n FROM a{n} a JOIN e USING (r) GROUP BY a.cluster, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k.cluster, coalesce(l.c, k.c) AS c FROM c{n} k LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS DOUBLE) ORDER BY i) AS c FROM m{n} GROUP BY cluster) l USING (cluster))")
    n = rounds
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.cluster AS INT) AS cluster, distance, count(*) OVER w AS cluster_size, CAST(sum(distance) OVER w AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, s.h AS centroid_sha256
FROM a{n} a JOIN (SELECT cluster, sha256(array_to_string(CAST(c AS BIGINT[]), ',')) AS h FROM c{n}) s USING (cluster) WINDOW w AS (PARTITION BY a.cluster)"""


ORACLES = {"op12_ball_kmeans": _op12(), "op8_jaccard_join": OP8, "op6_decontaminate": OP6, "op1_chat_format": OP1, "op4_url_filter": OP4}
