"""DuckDB SQL for the operators that SQL can express, by plain all-pairs definitions."""

# Turns are plain text here: SQL has no canonical JSON, so texts that are JSON objects of calls are left to the tests.
OP1 = """
WITH calls AS (
  SELECT conv_id, turn, concat_ws(':', conv_id, turn) AS call_id, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, role, text
  FROM conversations WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, turn, concat_ws(':', conv_id, turn - 1) AS call_id, text AS content FROM conversations WHERE role IN ('assistant', 'tool')
), answers AS (
  SELECT conv_id, call_id, arg_min(content, (turn, content)) AS content, count(*) AS n FROM results GROUP BY conv_id, call_id
), users AS (
  SELECT DISTINCT conv_id, turn FROM calls WHERE role = 'user'
)
SELECT c.conv_id, c.turn, CASE WHEN u.turn IS NOT NULL THEN printf('%019d', u.turn) || '.000001' ELSE printf('%019d', c.turn) || '.000000' END AS place, c.call_id, c.name,
  CASE WHEN a.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN c.text IS NOT NULL THEN '' WHEN c.role = 'user' THEN 'missing prompt' ELSE 'missing text' END AS errors,
  '{"arguments":{' || CASE WHEN c.text IS NULL THEN '' WHEN c.role = 'user' THEN '"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',' ELSE '"text":' || CAST(to_json(c.text) AS VARCHAR) END
    || CASE WHEN c.role = 'user' THEN '"turn":' || c.turn ELSE '' END || '},"id":"' || c.call_id || '","name":"' || c.name || '"'
    || coalesce(',"result":' || CAST(to_json(a.content) AS VARCHAR), '') || '}' AS message
FROM calls c LEFT JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
LEFT JOIN users u ON c.role = 'system' AND u.conv_id = c.conv_id AND u.turn = c.turn + 1
UNION ALL
SELECT r.conv_id, r.turn, printf('%019d', r.turn) || '.000000', r.call_id, NULL, 'orphan', '',
  '{"id":"' || r.call_id || '"' || coalesce(',"result":' || CAST(to_json(r.content) AS VARCHAR), '') || '}'
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
UNION ALL
SELECT conv_id, turn, printf('%019d', turn) || '.000000', NULL, NULL, 'no call', '',
  '{' || concat_ws(',', '"role":' || CAST(to_json(role) AS VARCHAR), '"content":' || CAST(to_json(text) AS VARCHAR)) || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'system', 'assistant', 'tool')
"""

OP5 = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r GROUP BY r.a
"""

OP6 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT r.a AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
"""

OP11 = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM item_words WHERE len(w) > 0
), doc_windows AS (
  SELECT row, l.n, unnest(range(1, len(w) - l.n + 2)) AS i, unnest(list_transform(range(1, len(w) - l.n + 2), lambda i: array_to_string(w[i:i + l.n - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT n FROM item_windows) l WHERE len(w) >= l.n
), hits AS (
  SELECT d.row, d.n, d.i, t.item FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.s = t.s
), places AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(a.n_items, 0) AS n_items, sha256(coalesce(a.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places p ON p.row = d.row LEFT JOIN named a ON a.row = d.row
"""


def _dearer(x: str, cost: str, letter: str) -> str:
    """A state's text (six digits of cost, then edits) with one more edit; null stays null."""
    return f"(printf('%06d', CAST(left({x}, 6) AS INTEGER) + {cost}) || substr({x}, 7) || '{letter}')"


OP13 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind
  FROM named, crc_table
), damage AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM kinds JOIN (VALUES (0), (1)) copies(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0
), ids AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), faults AS (
  SELECT c, d.*, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM damage d JOIN ids ON ids.conv_id IS NOT DISTINCT FROM d.conv_id
), turns AS (
  SELECT *, left(role, 1) AS r, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, fault = 'duplicate') AS i FROM faults
), health AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS n FROM turns GROUP BY c
), pairs AS (
  SELECT c, count(*) FILTER (NOT (r || after IN ('su', 'ua', 'au'))) AS illegal FROM (SELECT c, r, lead(r) OVER (PARTITION BY c ORDER BY i) AS after FROM turns) WHERE after IS NOT NULL GROUP BY c
), steps AS (
  SELECT c, CAST(0 AS BIGINT) AS i, CAST('000000' AS VARCHAR) AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM ids
  UNION ALL
  SELECT c, i, {_dearer("e", "3", "D")},
    least({_dearer("s", "3", "D")}, CASE WHEN NOT must AND r = 's' THEN {_dearer("e", "late", "K")} END),
    least({_dearer("u1", "3", "D")}, CASE WHEN NOT must AND r = 'u' THEN {_dearer("least(e, s, a1)", "late", "K")} END, CASE WHEN NOT must THEN {_dearer("least(e, s, a1)", "late + 2", "R")} END),
    least({_dearer("a1", "3", "D")}, CASE WHEN NOT must AND r = 'a' THEN {_dearer("u1", "late", "K")} END, CASE WHEN NOT must THEN {_dearer("u1", "late + 2", "R")} END)
  FROM (SELECT *, least(a, {_dearer("u1", "2", "I")}) AS a1 FROM (
    SELECT v.c, t.i, t.r, t.must, t.late, v.e, v.s, v.a, least(v.u, {_dearer("v.e", "2", "I")}, {_dearer("v.s", "2", "I")}, {_dearer("v.a", "2", "I")}) AS u1 FROM steps v JOIN turns t ON t.c = v.c AND t.i = v.i + 1))
), chosen AS (
  SELECT v.c, least(e, a, {_dearer("u", "2", "I")}, {_dearer(_dearer("s", "2", "I"), "2", "I")}) AS best FROM steps v LEFT JOIN health h ON h.c = v.c WHERE v.i = coalesce(h.n, 0)
), letters AS (
  SELECT c, p, substr(best, 6 + p, 1) AS x, count(*) FILTER (substr(best, 6 + p, 1) <> 'I') OVER w AS i, count(*) FILTER (substr(best, 6 + p, 1) <> 'D') OVER w AS place
  FROM (SELECT c, best, unnest(range(1, length(best) - 5)) AS p FROM chosen) WINDOW w AS (PARTITION BY c ORDER BY p)
), systems AS (
  SELECT DISTINCT l.c FROM letters l JOIN turns t ON t.c = l.c AND t.i = l.i WHERE l.x = 'K' AND l.place = 1 AND t.r = 's'
), mended AS (
  SELECT l.c, sha256(string_agg(CASE WHEN x = 'K' THEN t.role WHEN (place - CASE WHEN y.c IS NULL THEN 0 ELSE 1 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p)) AS digest
  FROM letters l LEFT JOIN turns t ON t.c = l.c AND t.i = l.i LEFT JOIN systems y ON y.c = l.c WHERE x <> 'D' GROUP BY l.c
)
SELECT ids.conv_id, coalesce(h.gaps, 0) AS gaps, coalesce(h.blank, 0) AS blank, coalesce(h.duplicate, 0) AS duplicate, coalesce(h.truncated, 0) AS truncated, coalesce(p.illegal, 0) AS illegal,
  CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit, coalesce(m.digest, sha256('')) AS repaired_sha256
FROM ids JOIN chosen USING (c) LEFT JOIN health h USING (c) LEFT JOIN pairs p USING (c) LEFT JOIN mended m USING (c)
"""


def _lloyd(n: int) -> str:
    """One round: the parts' nearest entries in the codebooks before it, and the codebooks after it."""
    return f"""
a{n} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS d FROM parts JOIN b{n} USING (p)) GROUP BY r, p
), m{n} AS (
  SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS m FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM parts JOIN a{n} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e
), b{n + 1} AS (
  SELECT b{n}.p, b{n}.e, coalesce(m{n}.y, b{n}.y) AS y FROM b{n} LEFT JOIN m{n} ON m{n}.p = b{n}.p AND m{n}.e = b{n}.e
)"""


# Whole numbers as doubles: exact up to 2^53.  All vectors of a table have one length, a multiple of four.
OP12 = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), parts AS (
  SELECT r, p, v[len(v) // 4 * p + 1:len(v) // 4 * (p + 1)] AS x FROM kept, range(4) t(p)
), b0 AS (
  SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= 256
), {", ".join(_lloyd(n) for n in range(5))}, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS digest FROM b4
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, books.digest AS codebooks_sha256 FROM kept k JOIN coded c USING (r), books
"""
