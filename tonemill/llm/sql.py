"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: struct_pack(i := i, win := array_to_string(w[i:i + n - 1], ' ')))) AS s
         FROM doc, (SELECT DISTINCT n FROM win)),
hit AS (SELECT doc_id, s.i AS i, v.n, v.item_id FROM spot JOIN win AS v ON v.win = s.win AND v.n = spot.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_ESC = r"replace(replace(replace({0}, '\', '\b'), '<', '\l'), '>', '\g')"
OP4 = rf"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT *, ceil(length(body) / 4)::BIGINT + 4 AS cost,
             length({_ESC.format('role')}) + length({_ESC.format('body')}) + 15 AS width,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) AS pos FROM turns),
b AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS upto,
             max(CASE WHEN pos = 1 AND role = 'system' THEN cost END) OVER (PARTITION BY conv_id) AS sys_cost,
             max(CASE WHEN pos = 1 AND role = 'system' THEN width END) OVER (PARTITION BY conv_id) AS sys_width FROM a),
c AS (SELECT *, (upto - 1) // (32 * 512) AS segment, 512 - coalesce(sys_cost, 0) AS room, CASE WHEN pos = 1 AND sys_cost IS NOT NULL THEN 0 ELSE cost END AS c FROM b),
d AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(width, 1) OVER w AS w1, lag(width, 2) OVER w AS w2, row_number() OVER w AS k
      FROM c WINDOW w AS (PARTITION BY conv_id, segment ORDER BY pos)),
e AS (SELECT *, CASE WHEN c1 > 0 AND c2 > 0 AND 4 * (c1 + c2) <= room AND c1 + c2 + c <= room THEN 2 WHEN c1 > 0 AND 4 * c1 <= room AND c1 + c <= room THEN 1 ELSE 0 END AS again FROM d),
walk AS (SELECT conv_id, segment, k, c AS used, true AS starts, 0 AS again FROM e WHERE k = 1
         UNION ALL SELECT e.conv_id, e.segment, e.k, CASE WHEN stays THEN used + c ELSE c + CASE e.again WHEN 2 THEN c1 + c2 WHEN 1 THEN c1 ELSE 0 END END, NOT stays, CASE WHEN stays THEN 0 ELSE e.again END
         FROM (SELECT e.*, walk.used, walk.used + e.c <= e.room OR walk.used = 0 AS stays FROM e JOIN walk ON e.conv_id = walk.conv_id AND e.segment = walk.segment AND e.k = walk.k + 1) AS e),
f AS (SELECT e.*, walk.starts, walk.again AS n FROM e JOIN walk ON e.conv_id = walk.conv_id AND e.segment = walk.segment AND e.k = walk.k)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
       length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY pos), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY pos), '')) AS loss_sha256,
       sum(width + CASE WHEN starts AND pos > 1 THEN coalesce(sys_width, 0) ELSE 0 END + CASE WHEN n >= 1 THEN w1 ELSE 0 END + CASE WHEN n = 2 THEN w2 ELSE 0 END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP6 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id, doc_id AS c FROM doc UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id)
SELECT doc.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN reach ON reach.doc_id = doc.doc_id GROUP BY doc.doc_id
"""

OP10 = """
WITH RECURSIVE fine AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM fine),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM unit p JOIN unit q ON p.vec_id <> q.vec_id AND list_dot_product(p.v, q.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.vec_id),
least AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT least.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, c = least.vec_id AS kept FROM least LEFT JOIN n ON n.a = least.vec_id
"""

OP12 = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
g AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""


def _code_round(k: int) -> str:
    """Parts assigned to the entries of round ``k``, and the entries of the next."""
    return f"""
near{k} AS (SELECT x.row, x.p, min(struct_pack(d := coalesce(list_sum(list_transform(range(1, len(x.w) + 1), lambda i: (x.w[i] - b.w[i]) * (x.w[i] - b.w[i]))), 0)::BIGINT, e := b.e)) AS best
            FROM part x JOIN book{k} b ON b.p = x.p GROUP BY x.row, x.p),
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS w FROM (SELECT x.p, n.best.e AS e, i, floor(sum(x.w[i]) / count(*))::BIGINT AS m
            FROM (SELECT row, p, w, unnest(range(1, len(w) + 1)) AS i FROM part) x JOIN near{k} n ON n.row = x.row AND n.p = x.p GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e),"""


OP13 = f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
part AS (SELECT row, vec_id, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS w FROM (SELECT *, unnest(range(16)) AS p FROM kept)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM part QUALIFY e < 64),{_code_round(0)}{_code_round(1)}{_code_round(2)}
done AS (SELECT row, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS books FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, books AS codebooks_sha256 FROM kept JOIN done USING (row), books
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op4_chat_format": OP4, "op6_jaccard_join": OP6, "op10_embedding_dedup": OP10, "op12_fill_in_middle": OP12, "op13_vector_codes": OP13}
