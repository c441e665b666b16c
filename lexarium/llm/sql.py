"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

SQL = {
    "p1_found": """
WITH d AS (SELECT doc_id, source, text FROM documents WHERE trim(source) <> ''),
n AS (SELECT source, count(*) AS rows_of_site FROM d GROUP BY source),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM d WHERE text IS NOT NULL),
k AS (SELECT doc_id, source, line_no, replace(lower(regexp_replace(line, '[^\\p{L}]', '', 'g')), 'ß', 'ss') AS key FROM l),
c AS (SELECT source, key FROM (SELECT source, key, count(DISTINCT doc_id) AS docs FROM k WHERE key <> '' GROUP BY ALL) JOIN n USING (source) WHERE docs >= 3 AND docs >= 0.08 * rows_of_site)
SELECT doc_id, line_no FROM k SEMI JOIN c USING (source, key)""",
    "p1_clean": """
WITH n AS (SELECT source, count(*) AS rows_of_site FROM documents WHERE trim(source) <> '' GROUP BY source),
l AS (SELECT doc_id, CASE WHEN trim(source) <> '' THEN source END AS source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, replace(lower(regexp_replace(line, '[^\\p{L}]', '', 'g')), 'ß', 'ss') AS key FROM l),
c AS (SELECT source, key, true AS gone FROM (SELECT source, key, count(DISTINCT doc_id) AS docs FROM k WHERE key <> '' AND source IS NOT NULL GROUP BY ALL) JOIN n USING (source) WHERE docs >= 3 AND docs >= 0.08 * rows_of_site),
j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (gone IS NULL), '') AS clean_text, count(gone) AS n_removed FROM k LEFT JOIN c USING (source, key) GROUP BY doc_id)
SELECT d.doc_id, clean_text, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN j USING (doc_id)""",
    "p4_found": """
WITH r AS (SELECT 'documents' AS rec_table, doc_id AS rec_id, text AS t FROM documents WHERE text IS NOT NULL UNION SELECT 'sections', section_id, content FROM sections WHERE content IS NOT NULL),
w AS (SELECT rec_table, rec_id, regexp_extract_all(lower(t), '([\\p{L}\\p{N}]+)', 1) AS w FROM r),
s AS (SELECT DISTINCT rec_table, rec_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT rec_table, rec_id, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT a.rec_table, a.rec_id AS id_a, c.rec_id AS id_b, count(*) AS shared FROM s a JOIN s c ON a.rec_table = c.rec_table AND a.g = c.g AND a.rec_id < c.rec_id GROUP BY ALL)
SELECT b.rec_table, id_a, id_b FROM b JOIN n x ON x.rec_table = b.rec_table AND x.rec_id = id_a JOIN n y ON y.rec_table = b.rec_table AND y.rec_id = id_b WHERE shared >= 0.7 * (x.n + y.n - shared)""",
    "p5_found": """
SELECT 'documents' AS rec_table, doc_id AS rec_id FROM documents d JOIN split_limits s ON s.rec_table = 'documents' AND upper(trim(s.kind)) = upper(trim(d.filetype)) WHERE length(text) > max_chars
UNION SELECT 'sections', section_id FROM sections d JOIN split_limits s ON s.rec_table = 'sections' AND upper(trim(s.kind)) = upper(trim(d.section_type)) WHERE length(content) > max_chars""",
    "p8_found": """
WITH c AS (SELECT case_id, regexp_extract_all(lower(t), '([\\p{L}\\p{N}]+)', 1) AS w FROM (SELECT case_id, unnest([query, expected_answer, passage]) AS t FROM eval_cases) WHERE t IS NOT NULL),
r AS (SELECT DISTINCT case_id, w[i:i + 9] AS run FROM (SELECT case_id, w, unnest(range(1, len(w) - 8)) AS i FROM c WHERE len(w) >= 10)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, w[i:i + 9] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10))
SELECT DISTINCT case_id, doc_id FROM t JOIN r USING (run)""",
}


def oracle_sql() -> dict[str, str]:
    """The SQL by query name."""
    return {k: v.strip() for k, v in SQL.items()}
