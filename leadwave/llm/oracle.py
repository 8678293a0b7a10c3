"""DuckDB SQL with the rows of the queries that SQL can express."""

ORACLE = {
    "op2_line_dedup": r"""
WITH lists AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM lists),
masked AS (
  SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM lines),
leafed AS (
  SELECT doc_id, line_no, tokens, len(tokens) || ' ' || array_to_string(list_slice(tokens, 1, 3), ' ') AS leaf FROM masked WHERE len(tokens) > 0),
common AS (
  SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
places AS (
  SELECT doc_id, line_no, leaf, unnest(range(1, len(tokens) + 1)) AS place, unnest(tokens) AS token FROM leafed JOIN common USING (leaf)),
standing AS (
  SELECT leaf, place, token FROM places GROUP BY leaf, place, token HAVING count(DISTINCT doc_id) >= 10),
built AS (
  SELECT p.doc_id, p.line_no, p.leaf, count(*) AS n, count(*) FILTER (s.token IS NOT NULL AND p.token <> '<*>') AS fixed,
         string_agg(coalesce(s.token, '<*>'), ' ' ORDER BY p.place) AS general, string_agg(p.token, ' ' ORDER BY p.place) AS own
  FROM places p LEFT JOIN standing s ON p.leaf = s.leaf AND p.place = s.place AND p.token = s.token GROUP BY p.doc_id, p.line_no, p.leaf),
templates AS (
  SELECT doc_id, line_no, leaf || '|' || CASE WHEN fixed >= 0.6 * n THEN general ELSE own END AS template FROM built),
recurring AS (
  SELECT template FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
dropped AS (
  SELECT doc_id, line_no FROM templates JOIN recurring USING (template)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped, string_agg(CASE WHEN d.line_no IS NULL THEN l.line END, chr(10) ORDER BY l.line_no) AS kept
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.line_no = d.line_no GROUP BY l.doc_id)
SELECT o.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents o LEFT JOIN kept k ON o.doc_id = k.doc_id
""",
    "op5_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS order_key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST) - source_size AS held,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST) + weight AS free
  FROM sources),
feasible AS (
  SELECT min(struct_pack(held := held, free := free)) AS level FROM levels
  WHERE weight * CAST(3 * total - 4 * held AS DOUBLE) / (2 * free) < 2 * source_size),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.held < f.level.held THEN 2.0 * l.source_size ELSE l.weight * CAST(3 * l.total - 4 * f.level.held AS DOUBLE) / (2 * f.level.free) END AS target
  FROM levels l CROSS JOIN feasible f),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
keys AS (
  SELECT source, order_key, sum(size) AS key_size FROM docs GROUP BY source, order_key),
placed AS (
  SELECT source, order_key, sum(key_size) OVER (PARTITION BY source ORDER BY order_key) - key_size / 2.0 AS middle FROM keys)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, w.source_size, CAST(w.target AS DOUBLE) AS target,
       CAST(d.size * (w.whole + CASE WHEN w.target > w.whole * w.source_size AND p.middle <= w.target - w.whole * w.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d
JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
JOIN placed p ON d.source IS NOT DISTINCT FROM p.source AND d.order_key = p.order_key
""",
    "op6_decontamination": r"""
WITH doc_lists AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_lists AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS place, words FROM item_lists WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(words, place, place + n - 1), ' ') AS window_text FROM windows),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_places AS (
  SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS place FROM doc_lists CROSS JOIN lengths WHERE len(words) >= n),
found AS (
  SELECT doc_id, place, item_id, w.n FROM
    (SELECT doc_id, n, place, array_to_string(list_slice(words, place, place + n - 1), ' ') AS window_text FROM doc_places) d
    JOIN item_windows w ON d.n = w.n AND d.window_text = w.window_text),
covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS word FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.words), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= coalesce(len(l.words), 0) AS contaminated
FROM doc_lists l LEFT JOIN covered c ON l.doc_id = c.doc_id LEFT JOIN items i ON l.doc_id = i.doc_id
""",
    "op7_ngram_join": r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (
  SELECT doc_id, words, least(5, len(words)) AS n, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS place FROM lists WHERE len(words) > 0),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, place, place + n - 1), ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS seen FROM lists
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.seen)
SELECT l.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM lists l LEFT JOIN sizes s ON s.doc_id = l.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM reached GROUP BY node) r ON r.node = l.doc_id
""",
    "op12_bottom_k": r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (
  SELECT doc_id, words, least(2, len(words)) AS n, unnest(range(1, len(words) - least(2, len(words)) + 2)) AS place FROM lists WHERE len(words) > 0),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, place, place + n - 1), ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS seen FROM lists
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.seen)
SELECT l.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id, l.doc_id = r.component_id AS kept
FROM lists l LEFT JOIN sizes s ON s.doc_id = l.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM reached GROUP BY node) r ON r.node = l.doc_id
""",
    "op13_importance": r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) t(i)),
doc_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_lists AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
in_docs AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(words) AS word FROM doc_lists) GROUP BY doc_id, word),
in_items AS (SELECT word, count(*) AS times FROM (SELECT unnest(words) AS word FROM item_lists) GROUP BY word),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM in_docs UNION ALL SELECT word FROM in_items)),
spelled AS (
  SELECT word, hex(encode(word)) AS code FROM vocabulary),
bytes AS (
  SELECT word, list_transform(range(CAST(length(code) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr(code, 2 * i + 1, 2)) AS BIGINT)) AS bytes FROM spelled),
hashed AS (
  SELECT word, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS INTEGER) AS bucket FROM bytes CROSS JOIN crc_table),
source_counts AS (SELECT bucket, sum(times) AS s FROM in_docs JOIN hashed USING (word) GROUP BY bucket),
target_counts AS (SELECT bucket, sum(times) AS t FROM in_items JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM source_counts) AS big_s, (SELECT coalesce(sum(t), 0) FROM target_counts) AS big_t),
gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (big_s + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (big_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN source_counts USING (bucket) LEFT JOIN target_counts USING (bucket) CROSS JOIN totals),
weights AS (
  SELECT doc_id, sum(times) AS n, CAST(floor(CAST(sum(times * gain) AS DOUBLE) / sum(times)) AS BIGINT) AS weight FROM in_docs JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT l.doc_id, CAST(coalesce(w.n, 0) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || l.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc_lists l LEFT JOIN weights w ON l.doc_id = w.doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.place <= floor(10 * r.eligible / 100) THEN r.place END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
""",
}
