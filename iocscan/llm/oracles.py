"""The queries that SQL can express, for DuckDB."""

#: Three-word shingles of all pairs that share one, and the smallest id in reach of links.
JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE [concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) FOR i IN range(1, len(w) - 1)] END) AS s
  FROM words),
flat AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * common >= 90 * (len(x.s) + len(y.s) - common)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, s.b FROM reached r JOIN steps s ON r.b = s.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reached WHERE a = doc_id) AS component_id FROM sets
"""

#: Every window of every item against every window of every document.
DECONTAMINATION = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n,
         unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS t
  FROM items WHERE len(w) > 0),
words AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS t
  FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, p, n, item FROM places JOIN windows USING (n, t)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS found FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(found), 0) AS n_items,
       sha256(array_to_string(coalesce(found, []), ',')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

#: All strings of 400 bytes, and the bytes that those which start twice cover.
REPEATS = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT doc_id, p, sha256(b[p:p + 399]) AS s FROM texts, unnest(range(1, octet_length(b) - 398)) u(p)),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
found AS (SELECT doc_id, p FROM strings WHERE s IN (FROM twice)),
opened AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM found),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM opened),
spans AS (SELECT doc_id, run, min(p) AS first, max(p) + 400 AS after FROM numbered GROUP BY ALL),
gaps AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY first), 1) AS since FROM spans),
kept AS (
  SELECT doc_id, sum(after - first) AS n_removed, count(*) AS n_spans, max(after) AS last,
         string_agg(CASE WHEN since < first THEN hex(b[since:first - 1]) ELSE '' END, '' ORDER BY first) AS k
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(concat(coalesce(k, ''),
           CASE WHEN coalesce(last, 1) <= octet_length(b) THEN hex(b[coalesce(last, 1):octet_length(b)]) ELSE '' END))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

#: The same words at a distance, in stretches without a gap; CRC-32 bit by bit.
RUNS = r"""
WITH texts AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
      lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) AS h
  FROM documents),
ends AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM ends),
altered AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END FOR i IN range(n)] ELSE w END AS w
  FROM periods),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM altered),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS d FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, d, min(i) AS start, count(*) + d AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS stretch FROM same) GROUP BY doc_id, d, stretch
  HAVING count(*) >= 3 * d AND count(*) + d >= 6),
runs AS (SELECT doc_id, start, length, min(d) AS period FROM stretches GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
by_document AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed,
    list(row(start, length, period) ORDER BY length DESC, start, period)[1] AS best
  FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM altered LEFT JOIN by_document USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
