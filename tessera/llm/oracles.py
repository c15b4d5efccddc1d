"""DuckDB SQL for the corpus queries that SQL can express."""
from __future__ import annotations

from tessera.llm.oracle_vectors import CLUSTERING

SQL = {"op11_subvector_kmeans": CLUSTERING}

SQL["op1_chat_collapse"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv_id, turn, count(*) OVER w AS n, string_agg(turn || chr(1) || role || chr(1) || text, chr(2)) OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT conv_id, max(n) AS n, max_by(prefix, n) AS all_text FROM p GROUP BY conv_id),
proper AS (SELECT DISTINCT p.prefix FROM p JOIN whole USING (conv_id) WHERE p.n < whole.n),
kept AS (SELECT min(conv_id) AS conv_id FROM whole WHERE all_text NOT IN (SELECT prefix FROM proper) GROUP BY all_text)
SELECT conv_id, turn // 256 AS part, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, turn // 256
"""

SQL["op3_block_names"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SQL["op6_line_chunks"] = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
             length(line) >= 99 AND len(string_split(line, ' ')) >= 50 AS long FROM l),
e AS (SELECT *, (long OR coalesce(lead(long) OVER w, true) OR (h * 31 + coalesce(lag(h) OVER w, 0)) % 1000003 % 4 = 0) AS ends
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
k AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines, count(*) > 1 OR bool_or(long) AS eligible
      FROM c GROUP BY doc_id, c),
f AS (SELECT *, eligible AND trim(chunk) <> '' AND row_number() OVER (PARTITION BY chunk, eligible ORDER BY doc_id, c) > 1 AS gone FROM k)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (WHERE NOT gone), '') AS text, sum(lines)::BIGINT AS n_lines,
       coalesce(sum(lines) FILTER (WHERE gone), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE gone) AS n_chunks_removed
FROM f GROUP BY doc_id
"""

SQL["op9_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""

SQL["op2_jaccard_tiles"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

SQL["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5) // (n.n + 5 * v.v)) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v.v))) AS q
      FROM p JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
      UNION ALL
      SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      WHERE a.lang NOT IN (SELECT lang FROM k)
      UNION ALL
      SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
