"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

#: Texts of one or two lines are windows of their own.
OP9 = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
threes AS (
  SELECT r, doc_id, unnest(range(len(lines) - 2)) AS p, lines FROM rows WHERE len(lines) >= 3),
windows AS (
  SELECT r, doc_id, p, 3 AS span, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS w FROM threes
  UNION ALL SELECT r, doc_id, 0, len(lines), text FROM rows WHERE len(lines) < 3),
numbered AS (
  SELECT r, p, span, row_number() OVER (PARTITION BY span, md5(w) ORDER BY doc_id NULLS FIRST, r, p) AS n
  FROM windows WHERE NOT regexp_full_match(w, '\s*')),
covered AS (SELECT DISTINCT r, p + k AS line FROM numbered, range(3) AS t(k) WHERE n > 1 AND k < span),
lined AS (SELECT r, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS s FROM rows),
kept AS (
  SELECT l.r, string_agg(l.s, chr(10) ORDER BY l.line) AS text, count(*) AS n
  FROM lined l ANTI JOIN covered c ON l.r = c.r AND l.line = c.line GROUP BY l.r)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines,
  (coalesce(len(d.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM rows d LEFT JOIN kept k ON d.r = k.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_windows": OP9}
