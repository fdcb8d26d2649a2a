"""SQL for DuckDB of the registered queries that SQL can express."""

from __future__ import annotations

# Counts of all phrases, without a parse. Products are taken in 128 bits.
PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM starts
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM starts WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM starts WHERE i + 2 <= len(w)),
counted AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS g FROM counted WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, k, phrase, f, 1 AS c, g[1] AS front, CASE k WHEN 2 THEN g[2] ELSE g[2] || ' ' || g[3] END AS back FROM candidates
  UNION ALL SELECT lang, k, phrase, f, 2, g[1] || ' ' || g[2], g[3] FROM candidates WHERE k = 3),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.f AS a, p.f AS l, q.f AS r, x.c,
    CAST((1000000::HUGEINT * x.f * x.f) // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM cuts x JOIN counted p ON p.lang = x.lang AND p.phrase = x.front
  JOIN counted q ON q.lang = x.lang AND q.phrase = x.back),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS pick FROM scored) WHERE pick = 1),
longer AS (
  SELECT lang, g[1] || ' ' || g[2] AS phrase, f FROM candidates WHERE k = 3
  UNION ALL SELECT lang, g[2] || ' ' || g[3], f FROM candidates WHERE k = 3),
beaten AS (SELECT lang, phrase, max(f) AS f FROM longer GROUP BY lang, phrase),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN beaten b ON s.k = 2 AND b.lang = s.lang AND b.phrase = s.phrase
  WHERE b.f IS NULL OR 100 * b.f < 50 * s.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
    phrase, a, l, r, score FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op13_prefix_free_phrases": PHRASES}
