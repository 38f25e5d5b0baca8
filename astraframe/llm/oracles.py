"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
arr AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (
  SELECT r, doc_id, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM arr
), keyed AS (
  SELECT r, doc_id, n, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT k.*, coalesce(p.keeper IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < p.keeper), false) AS dropped
  FROM keyed k LEFT JOIN repeated p ON p.key = k.key
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((nr - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS full_size FROM sources
), levels AS (
  SELECT *, coalesce(sum(full_size) OVER (ORDER BY full_size / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
    sum(w) OVER (ORDER BY full_size / w, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM weighed
), targets AS (
  SELECT source, nr, source_size, least(full_size, max((total - before) / open_w) OVER () * w) AS target FROM levels
), queued AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.size, d.h, t.nr, t.source_size, t.target,
    CAST(sum(d.size) OVER (PARTITION BY t.nr ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), timed AS (
  SELECT q.*, e AS epoch, CASE WHEN target > 0 THEN CAST(e * source_size + cum AS DOUBLE) / target ELSE 0.0 END AS finish
  FROM queued q, (SELECT unnest([0, 1, 2]) AS e)
), placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY finish, nr, h, doc_id NULLS FIRST, size, r, epoch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM timed
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(least(size, greatest(0, (SELECT sum(source_size) FROM sources) - (upto - size)))) AS BIGINT) AS taken
FROM placed GROUP BY r
"""

OP7 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT r, words, unnest(generate_series(1, len(words) - 34)) AS i FROM docs WHERE len(words) >= 35
), windows AS (
  SELECT r, i, sha256(array_to_string(words[i : i + 34], ' ')) AS w FROM starts
), repeated AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM windows JOIN repeated USING (w)
), gone AS (
  SELECT r, list(i) AS at FROM covered GROUP BY r
), kept AS (
  SELECT d.r, d.doc_id, len(d.words) AS n_words, coalesce(len(g.at), 0) AS n_removed, d.words, coalesce(g.at, []) AS at
  FROM docs d LEFT JOIN gone g ON g.r = d.r
), numbered AS (
  SELECT r, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM docs
), joined AS (
  SELECT n.r, string_agg(n.word, ' ' ORDER BY n.i) AS text FROM numbered n ANTI JOIN covered c ON c.r = n.r AND c.i = n.i GROUP BY n.r
)
SELECT k.doc_id, CAST(k.n_words AS BIGINT) AS n_words, CAST(k.n_removed AS BIGINT) AS n_removed, sha256(coalesce(j.text, '')) AS kept_sha256
FROM kept k LEFT JOIN joined j ON j.r = k.r
"""

OP8 = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), starts AS (
  SELECT r, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS i FROM docs WHERE len(words) > 0
), shingles AS (
  SELECT DISTINCT r, md5(array_to_string(words[i : i + 3], ' ')) AS s FROM starts
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.r = c.a JOIN sizes y ON y.r = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), twoway AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(r, o) AS (
  SELECT r, r FROM docs UNION SELECT reach.r, twoway.b FROM reach JOIN twoway ON twoway.a = reach.o
), least AS (
  SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = reach.o GROUP BY reach.r
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id IS NOT DISTINCT FROM l.component_id AS kept
FROM docs d JOIN least l ON l.r = d.r LEFT JOIN sizes s ON s.r = d.r
"""

ORACLES = {"op8_near_dedup": OP8, "op7_substring_dedup": OP7, "op2_line_dedup": OP2, "op5_mixing": OP5}
