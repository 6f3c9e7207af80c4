"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_COMPONENTS = """
    reach(a, b) AS (
        SELECT a, b FROM links
        UNION
        SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    )"""

OP1 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b
    FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93
),{_COMPONENTS}
SELECT e.vec_id,
    (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
    least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""

OP3 = r"""
WITH sized AS (
    SELECT doc_id, coalesce('s' || source, 'n') AS source_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
),
per AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source_key),
ranked AS (
    SELECT *, 2 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source_key = 'n', source_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM per
),
levelled AS (
    SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM ranked
    WINDOW before AS (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (SELECT source_key, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM levelled),
ordered AS (
    SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source_key ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(d.size AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized d JOIN targets t USING (source_key)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
    CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM ordered
"""

OP4 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * o >= 75 * (s.n + t.n - o)
),{_COMPONENTS},
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
"""

OP9 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
turns AS (
    SELECT *, length(regexp_replace(role, '(\\|###|: |</turn>)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|: |</turn>)', '\\\1', 'g')) + length('### : </turn>') + 1 AS chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP10 = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""

OP12 = r"""
WITH held AS (
    SELECT * FROM (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents
    ) WHERE len(t) > 0
),
facts AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM held),
items AS (
    SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
),
asked AS (SELECT k, term, count(*) AS repeats FROM (SELECT k, unnest(t) AS term FROM items) GROUP BY ALL),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM held) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, facts GROUP BY term),
scores AS (
    SELECT k, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(h.t) * docs) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN held h USING (r), facts
    GROUP BY k, r
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores JOIN held USING (r) JOIN items USING (k) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, x: list_reduce(list_prepend(xor(r, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

OP13 = f"""
WITH numbered AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
per AS (SELECT conv_id, count(*) AS own FROM numbered GROUP BY conv_id),
convs AS (
    SELECT p.conv_id, h, least(h, coalesce(b.own, 0)) AS taken, least(h, coalesce(b.own, 0)) + greatest(p.own - h, 0) AS n_turns, base
    FROM (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM per) p LEFT JOIN per b ON b.conv_id = p.base
),
turns AS (
    SELECT c.conv_id, i AS depth, role, text FROM convs c JOIN numbered n ON n.conv_id = c.base WHERE i <= taken
    UNION ALL SELECT conv_id, taken + i - h, role, text FROM convs JOIN numbered USING (conv_id) WHERE i > h
),
paths AS (
    SELECT conv_id, depth, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
nodes AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY key),
children AS (SELECT key[1 : 32 * (depth - 1)] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
sums AS (
    SELECT p.key, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved
    FROM whole u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.key
),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM paths JOIN convs USING (conv_id) WHERE depth = n_turns GROUP BY key)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM whole w JOIN sums s USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON w.depth > 0 AND p.key = w.key[1 : 32 * (w.depth - 1)]
"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1,
    "op3_source_mixing": OP3,
    "op4_ngram_jaccard_join": OP4,
    "op9_chat_tree": OP9,
    "op10_exact_dedup": OP10,
    "op12_ranked_search": OP12,
    "op13_prefix_trie": OP13,
}
