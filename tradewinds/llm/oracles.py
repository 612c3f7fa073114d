"""Reference answers in DuckDB SQL, where SQL can give them."""

LINKED_CALLS = """
WITH lines AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, u.line AS line, u.k - 1 AS k
  FROM conversations, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, k)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), calls AS (
  SELECT DISTINCT conv_id, turn, k, line, conv_id || '-' || turn || '-' || k AS call_id,
    len(list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda w: w <> '')) AS words
  FROM lines WHERE role = 'user'
), results AS (
  SELECT DISTINCT conv_id, turn, conv_id || '-' || (turn - 1) || '-' || k AS call_id, line AS content
  FROM lines WHERE role = 'assistant'
), checked AS (
  SELECT *, list_filter([
      CASE WHEN len(line) > 400 THEN 'text: above 400' END, CASE WHEN len(line) < 1 THEN 'text: below 1' END,
      CASE WHEN words > 40 THEN 'words: above 40' END, CASE WHEN words < 1 THEN 'words: below 1' END
    ], lambda e: e IS NOT NULL) AS errors,
    CAST(floor(log2(k + 1)) AS BIGINT) AS level
  FROM calls
), joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn,
    CASE WHEN c.call_id IS NULL THEN 'result' ELSE 'call' END AS kind, coalesce(c.call_id, r.call_id) AS call_id,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    coalesce(c.errors, ['result: no call']) AS errors, c.level, c.k, c.line, c.words, r.content
  FROM checked c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, turn,
  CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY kind, level NULLS LAST, length(call_id), call_id) AS INTEGER) AS place,
  kind, call_id, status, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors,
  '{' || CASE WHEN kind = 'call'
      THEN '"arguments":{"line":' || k || ',"text":' || to_json(line) || ',"words":' || words || '},' ELSE '' END
    || '"call_id":' || to_json(call_id)
    || CASE WHEN content IS NULL THEN '' ELSE ',"content":' || to_json(content) END
    || ',"errors":' || to_json(errors) || ',"kind":' || to_json(kind)
    || CASE WHEN kind = 'call' THEN ',"name":"say"' ELSE '' END
    || ',"status":' || to_json(status) || '}' AS json
FROM joined
"""

CHAT_FORMAT = f"""
WITH linked AS ({LINKED_CALLS}), said AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, coalesce(turn, -1) AS turn, role, text,
    CASE WHEN role IS NULL THEN 'role: missing' WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'role: unknown' ELSE '' END AS error
  FROM conversations
), rows AS (
  SELECT conv_id, turn, place AS old_place, kind, call_id, status, valid, errors, json, NULL AS role, NULL AS text FROM linked
  UNION ALL SELECT conv_id, turn, NULL, 'message', NULL, 'said', error = '', error,
    '{{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END
      || '"errors":' || to_json(CASE WHEN error = '' THEN [] ELSE [error] END) || ',"kind":"message"'
      || CASE WHEN role IS NULL THEN '' ELSE ',"role":' || to_json(role) END || ',"status":"said"}}', role, text
  FROM said
)
SELECT conv_id, turn, CASE WHEN conv_id IS NOT NULL THEN CAST(row_number() OVER (
    PARTITION BY conv_id, turn ORDER BY old_place IS NOT NULL, old_place, role NULLS FIRST, text NULLS FIRST) AS INTEGER) END AS place,
  kind, call_id, status, valid, errors, json
FROM rows
"""

SUBSTRING_DEDUP = """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, u.k AS k, list_aggregate(words[u.k : u.k + 12], 'string_agg', ' ') AS line
  FROM split, unnest(range(1, len(words) - 11)) AS u(k)
), least AS (
  SELECT line, min(doc_id) AS first_doc FROM windows GROUP BY line
), hit AS (
  SELECT DISTINCT doc_id, u.k AS k
  FROM windows JOIN least USING (line), unnest(range(windows.k, windows.k + 13)) AS u(k)
  WHERE first_doc < doc_id
), gone AS (
  SELECT doc_id, list(k) AS ks FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN words
    ELSE list_filter(words, lambda w, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""

DECONTAMINATION = """
WITH sources AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM sources
), wanted AS (
  SELECT DISTINCT CAST(id AS VARCHAR) AS item, least(13, len(words)) AS m,
    array_to_string(words[u.k : u.k + least(13, len(words)) - 1], ' ') AS line
  FROM split, unnest(range(1, greatest(len(words) - 12, least(len(words), 1)) + 1)) AS u(k)
  WHERE kind = 'b' AND len(words) > 0
), sizes AS (
  SELECT DISTINCT m FROM wanted
), found AS (
  SELECT d.id AS doc_id, u.k AS k, s.m AS m, w.item AS item
  FROM split d, sizes s, unnest(range(1, len(d.words) - s.m + 2)) AS u(k), wanted w
  WHERE d.kind = 'd' AND w.m = s.m AND w.line = array_to_string(d.words[u.k : u.k + s.m - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT u.k) AS n_hit FROM found, unnest(range(found.k, found.k + m)) AS u(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id
)
SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM split LEFT JOIN hits ON id = hits.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 'd'
"""

NEAR_DUPLICATES = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[u.k : u.k + 3], ' ') AS line
  FROM split, unnest(range(1, greatest(len(words) - 2, 2))) AS u(k) WHERE len(words) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.line = b.line AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS met FROM documents
  UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.met = edges.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, low AS component_id, d.doc_id = low AS kept
FROM split d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(met) AS low FROM reach GROUP BY node) r ON d.doc_id = r.node
"""

LEXICAL_SEARCH = """
WITH sources AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM sources
), lengths AS (
  SELECT id AS doc_id, len(words) AS n FROM split WHERE kind = 'd' AND len(words) > 0
), totals AS (
  SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_words FROM lengths
), held AS (
  SELECT s.id AS doc_id, u.w AS term, count(*) AS tf FROM split s, unnest(s.words) AS u(w) WHERE kind = 'd' GROUP BY ALL
), asked AS (
  SELECT DISTINCT s.id AS item_id, u.w AS term FROM split s, unnest(s.words) AS u(w) WHERE kind = 'b'
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_n) // all_words)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

TARGET_RESAMPLING = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), bytes AS (
  SELECT list(v ORDER BY i) AS step FROM steps WHERE k = 8
), sources AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM sources
), used AS (
  SELECT kind, id, u.w AS word, count(*) AS n FROM split, unnest(words) AS u(w) GROUP BY ALL
), coded AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM used)
), hashed AS (
  SELECT word, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
      lambda crc, b: xor(crc >> 8, step[(xor(crc, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM coded, bytes
), counts AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (kind = 'd'), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (kind = 'b'), 0) AS BIGINT) AS t
  FROM used JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT CAST(sum(s) AS BIGINT) AS all_s, CAST(sum(t) AS BIGINT) AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM counts, totals
), weights AS (
  SELECT id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM used JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(
      -1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (id) WHERE kind = 'd'
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op8_decontamination": DECONTAMINATION,
    "op9_chat_format": CHAT_FORMAT,
    "op10_minhash_near_dedup": NEAR_DUPLICATES,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op13_target_resampling": TARGET_RESAMPLING,
}
