"""SQL for the queries of this subpackage that SQL can express: the same results by plain definitions."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: Words of each text with their place, and every 35-word window that occurs more than once.
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT x.r, x.i, array_to_string(d.w[x.i : x.i + 34], ' ') AS s FROM x JOIN d USING (r)),
twice AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM (SELECT g.r, g.i, unnest(range(35)) AS k FROM g JOIN twice USING (s))),
gone_of AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(o.ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce((SELECT string_agg(d.w[u.i], ' ' ORDER BY u.i) FROM (SELECT unnest(generate_series(1, len(d.w))) AS i) u WHERE NOT coalesce(list_contains(o.ps, u.i), FALSE)), '')) AS kept_sha256
FROM d LEFT JOIN gone_of o USING (r)
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least.m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


def _escaped(text: str) -> str:
    """Characters of a text after the template's escapes."""
    marks = " + ".join(f"(length({text}) - length(replace({text}, '{m}', ''))) // {len(m)}" for m in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))
    return f"length({text}) + {marks}"


OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN 7 + {_escaped("text")} ELSE 14 + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: A line is its set of words. Pairs are looked for by the rarest words only (a set of n needs n - ceil(0.8 n) + 1 of them), then compared whole.
OP10 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(lower(s), '{WORD}'))) AS t FROM l),
c AS (SELECT t, min({{'d': doc_id, 'i': i}}) AS at, row_number() OVER (ORDER BY min({{'d': doc_id, 'i': i}})) AS c FROM t WHERE len(t) > 0 GROUP BY t),
g AS (SELECT c, len(t) AS n, unnest(t) AS s FROM c),
df AS (SELECT s, count(*) AS df FROM g GROUP BY s),
p AS (SELECT c, n, s FROM (SELECT c, n, s, row_number() OVER (PARTITION BY c ORDER BY df, s) AS r FROM g JOIN df USING (s)) WHERE r <= n - (80 * n + 99) // 100 + 1),
pair AS (SELECT DISTINCT a.c AS early, b.c AS late FROM p a JOIN p b ON a.s = b.s AND a.c < b.c WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
sized AS (SELECT late, len(list_intersect(a.t, b.t)) AS common, len(a.t) AS na, len(b.t) AS nb FROM pair JOIN c a ON a.c = early JOIN c b ON b.c = late),
late AS (SELECT DISTINCT late FROM sized WHERE 100 * common >= 80 * (na + nb - common)),
gone AS (SELECT t.doc_id, t.i FROM t JOIN c ON t.t = c.t WHERE c.c IN (SELECT late FROM late) OR c.at <> {{'d': t.doc_id, 'i': t.i}}),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.s, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
         FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

ORACLES = {"op3_substring_dedup": OP3, "op4_exact_top_k": OP4, "op8_minhash_dedup": OP8, "op9_chat_formatting": OP9, "op10_line_dedup": OP10}
