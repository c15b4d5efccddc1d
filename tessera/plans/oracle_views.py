"""DuckDB SQL for the domain views of ``tessera.sources.views``.

Each function returns CTE text (``name AS (...)`` items, comma separated) that
an oracle query puts after ``WITH``. They mirror the Spark definitions
expression by expression.
"""
from __future__ import annotations

from tessera.sources.views import SHOP_URL, UNKNOWN_REGION


def products() -> str:
    return f"""
p_nv AS (SELECT count(*) AS n FROM embeddings),
p_ns AS (SELECT count(*) AS n FROM supplier),
v_products AS (
  SELECT s.s_name || '|' || md5('{SHOP_URL}' || CAST(pt.p_partkey AS VARCHAR)) AS product_id,
         pt.p_name AS material_name,
         pt.p_type AS description,
         replace(printf('%.2f', pt.p_retailprice), '.', ',') AS unit_price,
         (['€', '€/m²', '€/sqm'])[(pt.p_size % 3) + 1] AS unit,
         r.r_name AS region,
         s.s_name AS vendor,
         CAST(NULL AS VARCHAR) AS vat_rate,
         CAST(e.label AS VARCHAR) AS quality_score,
         CAST(DATE '2024-01-01' + CAST(pt.p_partkey % 60 AS INTEGER) AS TIMESTAMP) AS updated_at,
         '{SHOP_URL}' || CAST(pt.p_partkey AS VARCHAR) AS source,
         e.embedding AS embedding,
         pt.p_type AS category,
         pt.p_partkey AS partkey,
         TRY_CAST(replace(replace(replace(printf('%.2f', pt.p_retailprice), '.', ','), '.', ''), ',', '.')
                  AS DOUBLE)
           AS price_value
  FROM part pt
  JOIN embeddings e ON e.vec_id = pt.p_partkey % (SELECT n FROM p_nv)
  JOIN supplier s ON s.s_suppkey = pt.p_partkey % (SELECT n FROM p_ns)
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def queries() -> str:
    return f"""
q_nv AS (SELECT count(*) AS n FROM embeddings),
q_ns AS (SELECT count(*) AS n FROM supplier),
v_queries AS (
  SELECT e.vec_id AS query_id,
         CASE WHEN e.vec_id % 13 = 5 THEN '' ELSE 'material ' || CAST(e.vec_id AS VARCHAR) END AS query,
         CASE WHEN e.vec_id % 7 = 0 THEN NULL
              WHEN e.vec_id % 7 = 1 THEN '{UNKNOWN_REGION}'
              WHEN e.vec_id % 7 = 2 THEN ''
              ELSE r.r_name END AS region,
         s.s_name AS vendor,
         CASE WHEN e.vec_id % 9 = 4 THEN 3 WHEN e.vec_id % 9 = 5 THEN 10 ELSE 5 END AS q_limit,
         CASE WHEN e.vec_id % 13 = 5 THEN CAST([] AS DOUBLE[])
              ELSE list_transform(list_zip(e.embedding, x.embedding),
                                  lambda t: CAST(t[1] AS DOUBLE) + 0.5 * CAST(t[2] AS DOUBLE)) END AS embedding
  FROM embeddings e
  JOIN embeddings x ON x.vec_id = (e.vec_id + 1) % (SELECT n FROM q_nv)
  LEFT JOIN region r ON r.r_regionkey = e.vec_id % 5
  LEFT JOIN supplier s ON e.vec_id % 11 = 3 AND s.s_suppkey = e.vec_id % (SELECT n FROM q_ns))"""


def tier(sim: str) -> str:
    return (f"CASE WHEN {sim} IS NULL OR isnan({sim}) THEN 'low' WHEN {sim} > 0.8 THEN 'high' "
            f"WHEN {sim} > 0.6 THEN 'medium' ELSE 'low' END")


def ranked_matches(queries_cte: str = "v_queries", products_cte: str = "v_products",
                   cap: int = 5, fallback_k: int = 5, filters: bool = True, degrade: bool = True,
                   name: str = "m_ranked") -> str:
    """CTEs scoring every (query, product) pair and ranking them like the Spark matcher.

    Output CTE ``name``: query_id, rank, product_id, sim, degraded.
    """
    filt = ("(q.region IS NULL OR q.region = '' OR p.region = q.region) AND "
            "(q.vendor IS NULL OR q.vendor = '' OR p.vendor = q.vendor)") if filters else "TRUE"
    sim = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))"
    parts = [f"""SELECT q.query_id, q.q_limit, p.product_id, {sim} AS sim, 0 AS path
    FROM {name}_q q JOIN {products_cte} p ON {filt}"""]
    if filters and degrade:
        parts.append(f"""SELECT q.query_id, q.q_limit, p.product_id, {sim} AS sim, 1 AS path
    FROM {name}_q q CROSS JOIN {products_cte} p""")
    union = "\n    UNION ALL\n    ".join(parts)
    return f"""
{name}_q AS (SELECT * FROM {queries_cte} WHERE len(embedding) > 0),
{name}_c AS (
    {union}),
{name}_b AS (SELECT *, min(path) OVER (PARTITION BY query_id) AS best_path FROM {name}_c),
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, round(sim, 4) DESC, product_id) AS rn
  FROM {name}_b WHERE path = best_path),
{name} AS (
  SELECT query_id, CAST(rn AS INTEGER) AS rank, product_id, sim, (path = 1) AS degraded
  FROM {name}_r
  WHERE rn <= CASE WHEN path = 0 THEN least(q_limit, {cap}) ELSE {fallback_k} END)"""


def _pick_sql(options: list[str], key: str) -> str:
    items = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"([{items}])[({key} % {len(options)}) + 1]"


def transcripts() -> str:
    from tessera.sources.views import T_CITIES, T_INTROS, T_TASKS, T_VENDORS
    k = "o.o_orderkey"
    return f"""
v_transcripts AS (
  SELECT o.o_orderkey AS proposal_id,
         {_pick_sql(T_INTROS, k)} || {_pick_sql(T_TASKS, k)}
         || CASE WHEN {k} % 37 > 0 THEN ', about ' || CAST({k} % 37 AS VARCHAR) || ' m2'
                 ELSE ', size unknown' END
         || {_pick_sql(T_VENDORS, k)}
         || CASE WHEN o.o_custkey % 9 = 0 THEN ' with a price comparison' ELSE '' END
         || {_pick_sql(T_CITIES, 'c.c_nationkey')}
         || CASE WHEN {k} % 4 = 0 THEN ' on a tight budget' ELSE '' END
         || '.' AS transcript
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def feedback() -> str:
    from tessera.sources.views import VERDICT_BY_EVENT
    whens = " ".join(f"WHEN event_type = '{e}' THEN '{v}'" for e, v in VERDICT_BY_EVENT)
    return f"""
fb_no AS (SELECT count(*) AS n FROM orders),
v_feedback AS (
  SELECT event_id, event_id % (SELECT n FROM fb_no) AS proposal_id,
         md5('quote:' || CAST(event_id % (SELECT n FROM fb_no) AS VARCHAR)) AS quote_id,
         md5('quote:' || CAST(event_id % (SELECT n FROM fb_no) AS VARCHAR)) || ':0' AS task_id,
         CASE WHEN user_id % 10 = 7 THEN 'supplier' WHEN user_id % 2 = 0 THEN 'contractor' ELSE 'client' END
           AS user_type,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE CASE {whens} END END AS verdict,
         props AS comment, ts AS created_at
  FROM events)"""
