"""DuckDB SQL for the queries of this subpackage that SQL can express: exact by construction, and slower than the operators."""

from __future__ import annotations

_WORDS = r"""
docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM docs)"""

#: All windows of 50 words, the least document of each, and the words that later ones cover.
SUBSTRING_DEDUP = f"""
WITH {_WORDS},
windows AS (
  SELECT doc_id, p, word, CASE WHEN count(*) OVER ahead = 50 THEN md5(string_agg(word, ' ') OVER ahead) END AS h FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least AS (SELECT h, min(doc_id) AS lo FROM windows WHERE h IS NOT NULL GROUP BY h),
marked AS (SELECT v.doc_id, p, word, CASE WHEN v.doc_id > lo THEN 1 ELSE 0 END AS repeated FROM windows v LEFT JOIN least USING (h)),
covered AS (
  SELECT doc_id, p, word, max(repeated) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM marked),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS text
  FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Distinct shingle sets, their links by counting shared shingles, and the sets that each one reaches.
JACCARD_JOIN = f"""
WITH RECURSIVE {_WORDS},
runs AS (
  SELECT doc_id, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS n FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
grams AS (
  SELECT DISTINCT doc_id, gram FROM runs WHERE n = 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4),
digests AS (SELECT doc_id, count(*) AS n, md5(string_agg(md5(gram), '' ORDER BY gram)) AS digest FROM grams GROUP BY doc_id),
signed AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(digest, '') AS digest FROM docs LEFT JOIN digests USING (doc_id)),
sets AS (SELECT digest, any_value(n) AS n, min(doc_id) AS rep, count(*) AS n_copies FROM signed GROUP BY digest),
terms AS (SELECT rep, n, gram FROM sets JOIN grams ON doc_id = rep),
links AS (
  SELECT x.rep AS a, y.rep AS b FROM terms x JOIN terms y ON x.gram = y.gram AND x.rep <> y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
reach AS (SELECT rep AS node, rep AS root FROM sets UNION SELECT b, root FROM reach JOIN links ON a = node),
roots AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies, CAST(s.n AS INTEGER) AS n_shingles
FROM signed s JOIN sets t ON s.digest = t.digest JOIN roots ON node = rep LEFT JOIN degree ON a = rep
"""

SQL = {"op1_ngram_jaccard_join": JACCARD_JOIN, "op3_substring_dedup": SUBSTRING_DEDUP}
