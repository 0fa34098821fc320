"""DuckDB SQL for the queries of the numbered operators that SQL can express."""

LINE_RULES = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), words AS (
  SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i
  FROM docs
), windows AS (
  SELECT rid, i, struct_pack(a := w, b := lead(w, 1) OVER p, c := lead(w, 2) OVER p) AS g, lead(w, 2) OVER p AS last
  FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM docs
), worded AS (
  SELECT rid, doc_id, source, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY rid
), frequent AS (
  SELECT source, norm FROM worded GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20
), removed AS (
  SELECT rid, sum(n)::BIGINT AS removed_words FROM worded JOIN frequent USING (source, norm) GROUP BY rid
), measured AS (
  SELECT d.doc_id,
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM docs d LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN removed USING (rid)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured
)
SELECT *, (NOT base_failed AND n_words - removed_words >= n_words * 0.3) AS kept FROM judged
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '&(amp;|lt;|lb;|nl;)', '&amp;\1', 'g'),
      '<|', '&lt;|'), '</s>', '&lt;/s>'), '<s>', '&lt;s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>') AS safe,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joins
  FROM turns
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length(safe) + CASE WHEN joins THEN 8 ELSE 8 + length(role) + 1 + 8 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

NEAR_DEDUP = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
), reached AS (
  SELECT doc_id AS id, doc_id AS r FROM docs UNION SELECT l.b, q.r FROM reached q JOIN links l ON l.a = q.id
), least AS (
  SELECT id, min(r) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN least ON least.id = d.doc_id
"""

SPELLING = r"""
WITH RECURSIVE polynomial(i, k, c) AS (  -- the table of the cyclic redundancy check, by its rule
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM documents
), counted AS (
  SELECT r, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x, count(*) AS n FROM runs GROUP BY 1, 2
), hashed AS (
  SELECT r, n, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(length(x) // 2), lambda j: ('0x' || x[2 * j + 1 : 2 * j + 2])::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN r[: h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), gaps AS (
  SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, x.n, y.word AS v, y.n AS m FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
  UNION SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b
), best AS (
  SELECT word, count(*) AS n_near, first(v ORDER BY m DESC, v) AS v, max(m) AS m FROM near GROUP BY 1
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN v END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS r, 0 AS step FROM formed
  UNION ALL SELECT l.word, f.form, step + 1 FROM led l JOIN formed f ON f.word = l.r WHERE f.form IS NOT NULL
)
SELECT word, n, n_near, form, form_n, root
FROM formed JOIN (SELECT word, first(r ORDER BY step DESC) AS root FROM led GROUP BY 1) USING (word)
"""

FILL_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 50 THEN 'plain'
         WHEN ('0x' || x[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1 : least(c1, c2)], '') AS p,
    array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1 :], '') AS s
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL = {
    "op2_line_rules": LINE_RULES,
    "op6_chat_format": CHAT_FORMAT,
    "op10_near_dedup": NEAR_DEDUP,
    "op11_spelling_variants": SPELLING,
    "op13_fill_middle": FILL_MIDDLE,
}
