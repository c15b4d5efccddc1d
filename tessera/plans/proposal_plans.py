"""Registered proposal queries (transcript -> priced quote) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import confidence_tier
from tessera.operators import embed as E
from tessera.operators import proposal as PR
from tessera.operators import transcript as TR
from tessera.plans import oracle_rules as R
from tessera.plans import oracle_views as OV
from tessera.sources import views
from tessera.sources.tables import read_table


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(proposals, quote_lines) for every transcript."""
    parsed = TR.parse(views.transcripts(spark, sf_dir))
    catalog = views.products(spark, sf_dir)
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n_vec = views.row_count(spark, sf_dir, "embeddings")

    def encode(df, text_col):
        return E.table_encoder(df, text_col, vectors, n_vec)
    return PR.assemble(parsed, catalog, encode)


TOTAL_COLUMNS = ["proposal_id", "quote_id", "label", "n_tasks", "total_hours", "labor_cost", "vat_rate",
                 "n_materials", "margin_protected_price", "prices_sum", "confidence_score", "materials",
                 "estimated_duration", "total_estimate"]


def proposal_total(spark, sf_dir):
    return build(spark, sf_dir)[0].select(*TOTAL_COLUMNS)


def proposal_lines(spark, sf_dir):
    return build(spark, sf_dir)[1].select("quote_id", "task_id", "proposal_id", "product_id", "material",
                                          "similarity_score", "price_value", "region", "vendor", "degraded")


def proposal_confidence(spark, sf_dir):
    p = build(spark, sf_dir)[0]
    return p.select("proposal_id", "confidence_score", "n_materials", "materials")


def proposal_nested(spark, sf_dir):
    """The nested response record, read back field by field."""
    t = F.element_at("tasks", 1)
    return PR.nested(build(spark, sf_dir)[0]).select("proposal_id", "quote_id", F.size("tasks").alias("n_tasks"), t["label"].alias("label"),
                                                     F.array_join(t["materials"], ", ").alias("materials"), t["confidence_score"].alias("confidence_score"),
                                                     t["margin_protected_price"].alias("margin_protected_price"), "total_estimate")


def vat_documented(spark, sf_dir):
    parsed = TR.parse(views.transcripts(spark, sf_dir))
    return parsed.select("proposal_id", "renovation_type",
                         PR.documented_vat(F.col("renovation_type")).alias("vat_documented"))


def margin_documented(spark, sf_dir):
    p = build(spark, sf_dir)[0]
    parsed = TR.parse(views.transcripts(spark, sf_dir)).select("proposal_id", "renovation_type")
    j = p.join(parsed, "proposal_id")
    vat = PR.documented_vat(F.col("renovation_type"))
    return j.select("proposal_id", "prices_sum", vat.alias("vat_documented"),
                    PR.documented_price(F.col("prices_sum"), vat).alias("price_with_margin"))


def needs_clarification(spark, sf_dir):
    lines = build(spark, sf_dir)[1]
    tier = confidence_tier(F.col("similarity_score"))
    return lines.select("quote_id", "product_id", "material", tier.alias("confidence_tier"),
                        (tier == "low").alias("needs_clarification"))


def quote_latest(spark, sf_dir):
    """Two versions per quote (as-coded total, then the documented total); latest with its delta."""
    p = build(spark, sf_dir)[0]
    parsed = TR.parse(views.transcripts(spark, sf_dir)).select("proposal_id", "renovation_type")
    j = p.join(parsed, "proposal_id")
    vat = PR.documented_vat(F.col("renovation_type"))
    v2 = F.ceil(F.round(PR.documented_price(F.col("prices_sum"), vat) + F.col("labor_cost"), 6)).cast("long")
    hist = j.select("quote_id", F.lit(1).alias("version"), F.col("total_estimate").alias("total")).unionByName(
        j.select("quote_id", F.lit(2).alias("version"), v2.alias("total")))
    w = Window.partitionBy("quote_id").orderBy("version")
    hist = hist.withColumn("previous_total", F.lag("total").over(w))
    latest = hist.groupBy("quote_id").agg(F.max_by(F.struct("version", "total", "previous_total"), "version").alias("l"))
    return latest.select("quote_id", F.col("l.version").alias("version"), F.col("l.total").alias("total"),
                         F.col("l.previous_total").alias("previous_total"),
                         (F.col("l.total") - F.col("l.previous_total")).alias("delta"))


def ctes() -> str:
    """CTEs computing v_props (one row per proposal) and v_qlines (deduplicated lines)."""
    lookq = """
v_lines AS (
  SELECT proposal_id, region, vendor, unnest(materials) AS material,
         generate_subscripts(materials, 1) - 1 AS mat_pos FROM v_parsed),
v_lines2 AS (SELECT *, concat_ws(' ', vendor, material) AS lookup_text FROM v_lines),
v_lines3 AS (SELECT *, lookup_text || chr(31) || coalesce(region, '') AS lookup FROM v_lines2),
lk_nv AS (SELECT count(*) AS n FROM embeddings),
v_lookq AS (
  SELECT l.lookup AS query_id, l.region, CAST(NULL AS VARCHAR) AS vendor, 1 AS q_limit,
         CASE WHEN length(l.lookup_text) = 0 THEN CAST([] AS FLOAT[]) ELSE e.embedding END AS embedding
  FROM (SELECT DISTINCT lookup, lookup_text, region FROM v_lines3) l
  LEFT JOIN embeddings e ON e.vec_id = length(l.lookup_text) % (SELECT n FROM lk_nv))"""
    return ", ".join(c.strip() for c in [
        OV.products(), OV.transcripts(), R.parsed_cte(), R.task_rows_cte(), lookq,
        OV.ranked_matches(queries_cte="v_lookq", cap=1, fallback_k=1, name="lk"),
        f"""v_tt AS (
  SELECT proposal_id, count(*) AS n_tasks, sum(hours) AS total_hours, sum(labor) AS labor_cost,
         greatest(max(vat), {R.d(0)}) AS vat_rate
  FROM (SELECT proposal_id, {R.hours('task_name', 'area_m2')} AS hours,
               round({R.hours('task_name', 'area_m2')} * {R.hourly_rate("coalesce(city, 'Generic')")}, 2) AS labor,
               {R.vat('task_name')} AS vat FROM v_tasks) x
  GROUP BY proposal_id)""",
        """v_matched AS (
  SELECT l.proposal_id, l.mat_pos, l.material, m.product_id, m.sim, m.degraded, p.material_name, p.price_value,
         p.region AS product_region, p.vendor AS product_vendor
  FROM v_lines3 l JOIN lk m ON m.query_id = l.lookup JOIN v_products p ON p.product_id = m.product_id)""",
        """v_qlines AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id, product_id ORDER BY mat_pos) AS rn
                 FROM v_matched) WHERE rn = 1)""",
        """v_lt AS (
  SELECT c.proposal_id, c.n_materials, a.prices_sum, a.confidence_score, a.materials
  FROM (SELECT proposal_id, count(*) AS n_materials FROM v_matched GROUP BY 1) c
  JOIN (SELECT proposal_id, sum(price_value) AS prices_sum, round(CAST(sum(CAST(round(sim * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 100.0) / 100.0 AS confidence_score,
               string_agg(material_name, '|' ORDER BY mat_pos) AS materials
        FROM v_qlines GROUP BY 1) a USING (proposal_id))""",
        f"""v_props AS (
  SELECT b.proposal_id, md5('quote:' || CAST(b.proposal_id AS VARCHAR)) AS quote_id,
         coalesce(b.renovation_type, 'Tile bathroom walls') AS label,
         coalesce(tt.n_tasks, 0) AS n_tasks,
         coalesce(tt.total_hours, {R.d(0)}) AS total_hours,
         round(coalesce(tt.labor_cost, {R.d(0)}), 2) AS labor_cost,
         coalesce(tt.vat_rate, {R.d(0)}) AS vat_rate,
         coalesce(lt.n_materials, 0) AS n_materials,
         round(CAST(coalesce(lt.n_materials, 0) AS DOUBLE) * {R.d(11)} * ({R.d(1)} + coalesce(tt.vat_rate, {R.d(0)})), 4)
           AS margin_protected_price,
         CAST(coalesce(lt.n_materials, 0) AS DOUBLE) * {R.d(11)} * ({R.d(1)} + coalesce(tt.vat_rate, {R.d(0)}))
           AS margin_raw,
         round(coalesce(lt.prices_sum, {R.d(0)}), 2) AS prices_sum,
         coalesce(lt.prices_sum, {R.d(0)}) AS prices_raw,
         coalesce(lt.confidence_score, {R.d(0)}) AS confidence_score,
         coalesce(lt.materials, '') AS materials,
         CAST(ceil(coalesce(tt.total_hours, {R.d(0)}) / {R.d(24)}) AS BIGINT) AS duration_days,
         CAST(ceil(coalesce(tt.total_hours, {R.d(0)}) / {R.d(24)}) AS BIGINT) || ' day' AS estimated_duration,
         CAST(ceil(round(coalesce(lt.prices_sum, {R.d(0)})
              + CAST(coalesce(lt.n_materials, 0) AS DOUBLE) * {R.d(11)} * ({R.d(1)} + coalesce(tt.vat_rate, {R.d(0)}))
              + coalesce(tt.labor_cost, {R.d(0)}), 6)) AS BIGINT) AS total_estimate,
         b.renovation_type
  FROM v_parsed b LEFT JOIN v_tt tt USING (proposal_id) LEFT JOIN v_lt lt USING (proposal_id))""",
    ])


def doc_vat_sql(col: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} = 'new_build' THEN {R.d(0.2)} ELSE {R.d(0.1)} END"


def doc_price_sql(prices: str, vat: str) -> str:
    return f"round({prices} * {R.d(1.25)} * ({R.d(1)} + {vat}), 2)"


QUERIES = {
    "proposal_total": proposal_total,
    "proposal_lines": proposal_lines,
    "proposal_confidence": proposal_confidence,
    "proposal_nested": proposal_nested,
    "vat_documented": vat_documented,
    "margin_documented": margin_documented,
    "needs_clarification": needs_clarification,
    "quote_latest": quote_latest,
}

_W = "WITH " + ctes()
SQL = {
    "proposal_total": _W + " SELECT " + ", ".join(
        ["proposal_id", "quote_id", "label", "n_tasks", "total_hours", "labor_cost", "vat_rate", "n_materials",
         "margin_protected_price", "prices_sum", "confidence_score", "materials", "estimated_duration",
         "total_estimate"]) + " FROM v_props",
    "proposal_lines": _W + """ SELECT md5('quote:' || CAST(proposal_id AS VARCHAR)) AS quote_id,
        md5('quote:' || CAST(proposal_id AS VARCHAR)) || ':0' AS task_id, proposal_id, product_id, material,
        round(sim, 4) AS similarity_score, price_value, product_region AS region, product_vendor AS vendor, degraded
        FROM v_qlines""",
    "proposal_confidence": _W + " SELECT proposal_id, confidence_score, n_materials, materials FROM v_props",
    "proposal_nested": _W + """ SELECT proposal_id, quote_id, 1 AS n_tasks, label, replace(materials, '|', ', ') AS materials, confidence_score,
        margin_protected_price, total_estimate FROM v_props""",
    "vat_documented": "WITH " + ", ".join(c.strip() for c in [OV.transcripts(), R.parsed_cte()]) +
        f" SELECT proposal_id, renovation_type, {doc_vat_sql('renovation_type')} AS vat_documented FROM v_parsed",
    "margin_documented": _W + f""" SELECT proposal_id, prices_sum, {doc_vat_sql('renovation_type')} AS vat_documented,
        {doc_price_sql('prices_sum', doc_vat_sql('renovation_type'))} AS price_with_margin FROM v_props""",
    "needs_clarification": _W + f""" SELECT md5('quote:' || CAST(proposal_id AS VARCHAR)) AS quote_id, product_id,
        material, {OV.tier('round(sim, 4)')} AS confidence_tier, ({OV.tier('round(sim, 4)')}) = 'low'
        AS needs_clarification FROM v_qlines""",
    "quote_latest": _W + f""", v2 AS (
        SELECT quote_id, total_estimate AS v1,
               CAST(ceil(round({doc_price_sql('prices_sum', doc_vat_sql('renovation_type'))} + labor_cost, 6)) AS BIGINT)
               AS v2 FROM v_props)
        SELECT quote_id, 2 AS version, v2 AS total, v1 AS previous_total, v2 - v1 AS delta FROM v2""",
}
