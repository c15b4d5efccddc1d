"""Registered feedback and documented-analytics queries and their DuckDB oracles."""
from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from tessera.operators import feedback as FB
from tessera.operators.selection import medians, robust_scores
from tessera.plans import oracle_rules as R
from tessera.plans import oracle_views as OV
from tessera.plans import proposal_plans as PP
from tessera.session import scratch_path
from tessera.sources import views


def _fl(spark, sf_dir):
    _, lines = PP.build(spark, sf_dir)
    return FB.with_lines(views.feedback(spark, sf_dir), lines)


def feedback_valid(spark, sf_dir):
    v = FB.validate(views.feedback(spark, sf_dir))
    return v.select("event_id", "quote_id", "task_id", "user_type", "verdict", F.col("comment").alias("comments"),
                    "created_at", "status", "reason")


def feedback_append(spark, sf_dir):
    """The stored feedback after two batches, the second delivered twice."""
    fb = views.feedback(spark, sf_dir)
    path = scratch_path(spark, f"feedback-{uuid.uuid4().hex}")
    for batch, part in (("0", "event_id % 2 = 0"), ("1", "event_id % 2 = 1"), ("1", "event_id % 2 = 1")):
        FB.append_batch(fb.where(part), path, batch, datetime.datetime(2024, 2, 1, tzinfo=datetime.UTC))
    return spark.read.parquet(path).select("task_id", "quote_id", "user_type", "verdict", "comments", "created_at", "reason", "status",
                                           F.col("batch").cast("int").alias("batch"), F.year("received_at").alias("year_received"))


def feedback_rollup(spark, sf_dir):
    return FB.rollup(_fl(spark, sf_dir))


def adaptive_multiplier(spark, sf_dir):
    return FB.adaptive_multiplier(_fl(spark, sf_dir))


def adjusted_confidence(spark, sf_dir):
    """Quote-line scores adjusted by the smoothed acceptance of their (region, vendor)."""
    _, lines = PP.build(spark, sf_dir)
    mult = FB.adaptive_multiplier(FB.with_lines(views.feedback(spark, sf_dir), lines))
    return FB.adjust_confidence(lines, mult)


def calibration_curve(spark, sf_dir):
    return FB.calibration_curve(_fl(spark, sf_dir))


def rejection_signals(spark, sf_dir):
    return FB.rejection_signals(_fl(spark, sf_dir), views.products(spark, sf_dir))


def price_anomaly(spark, sf_dir):
    p = FB.price_anomalies(views.products(spark, sf_dir))
    return p.select("product_id", "category", "region", "price_value", "z", "is_anomaly")


def robust_price(spark, sf_dir):
    """Robust z-score of each price in its (category, region): by median and median absolute deviation."""
    p = robust_scores(views.products(spark, sf_dir), ["category", "region"], "price_value")
    return p.select("product_id", "category", "region", "price_value", "median", "mad", "robust_z")


def price_median_parts(spark, sf_dir):
    """Median price of nine tenths of the products, one group, and of the others."""
    p = views.products(spark, sf_dir)
    return medians(p.withColumn("part", F.when(F.col("partkey") % 10 > 0, F.lit("most"))), ["part"], "price_value", "median_price")


def vendor_price_ratio(spark, sf_dir):
    return FB.vendor_price_ratio(views.products(spark, sf_dir))


def unit_normalize(spark, sf_dir):
    p = views.products(spark, sf_dir)
    return p.select("product_id", "unit", FB.normalize_unit(F.col("unit")).alias("unit_normalized"))


def region_price(spark, sf_dir):
    return FB.region_price(views.products(spark, sf_dir))


def stale_products(spark, sf_dir):
    return FB.stale(views.products(spark, sf_dir))


def schema_validate(spark, sf_dir):
    """Parse the events' JSON properties by schema; unparseable or missing fields are invalid."""
    from tessera.sources.tables import read_table
    ev = read_table(spark, sf_dir, "events", "event_id", "props")
    parsed = ev.withColumn("p", F.from_json("props", "k int", {"mode": "PERMISSIVE"}))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.col("p.k").isNotNull().alias("is_valid"))


QUERIES = {
    "feedback_valid": feedback_valid,
    "feedback_append": feedback_append,
    "feedback_rollup": feedback_rollup,
    "adaptive_multiplier": adaptive_multiplier,
    "calibration_curve": calibration_curve,
    "adjusted_confidence": adjusted_confidence,
    "rejection_signals": rejection_signals,
    "price_anomaly": price_anomaly,
    "robust_price": robust_price,
    "price_median_parts": price_median_parts,
    "vendor_price_ratio": vendor_price_ratio,
    "unit_normalize": unit_normalize,
    "region_price": region_price,
    "stale_products": stale_products,
    "schema_validate": schema_validate,
}

_USERS = ", ".join(f"'{u}'" for u in ["contractor", "client"])
_VALID = f"""v_fbv AS (
  SELECT *, CASE WHEN coalesce(task_id, '') = '' THEN 'missing_task_id'
                 WHEN coalesce(quote_id, '') = '' THEN 'missing_quote_id'
                 WHEN coalesce(user_type, '') NOT IN ({_USERS}) THEN 'bad_user_type'
                 WHEN coalesce(verdict, '') = '' THEN 'missing_verdict' END AS reason
  FROM v_feedback)"""
_FL = "WITH " + PP.ctes() + ", " + OV.feedback().strip() + ", " + _VALID + """,
v_fl AS (
  SELECT f.*, l.product_id, l.material, round(l.sim, 4) AS similarity_score, l.price_value,
         l.product_region AS region, l.product_vendor AS vendor
  FROM v_fbv f JOIN v_qlines l ON l.proposal_id = f.proposal_id
  WHERE f.reason IS NULL)"""
_ACC = "CAST(verdict = 'accepted' AS DOUBLE)"
_P = "WITH " + OV.products().strip()
_Z = """v_z AS (
  SELECT *, round((price_value - avg(price_value) OVER w) / NULLIF(stddev_samp(price_value) OVER w, 0), 4) AS z
  FROM v_products WINDOW w AS (PARTITION BY category, region))"""

SQL = {
    "feedback_valid": "WITH " + OV.feedback().strip() + ", " + _VALID + """
        SELECT event_id, quote_id, task_id, user_type, verdict, comment AS comments, created_at,
               CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM v_fbv""",
    "feedback_append": "WITH " + OV.feedback().strip() + ", " + _VALID + """
        SELECT task_id, quote_id, user_type, verdict, comment AS comments, created_at, reason,
               CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, CAST(event_id % 2 AS INTEGER) AS batch,
               CAST(2024 AS INTEGER) AS year_received FROM v_fbv""",
    "feedback_rollup": _FL + f""" SELECT material, region, vendor, user_type, count(*) AS n,
        round(sum({_ACC}) * {R.d(1000000)} / CAST(count(*) AS DOUBLE)) / {R.d(1000000)} AS acceptance_rate
        FROM v_fl GROUP BY ROLLUP (material, region, vendor, user_type)""",
    "adaptive_multiplier": _FL + f""", g AS (SELECT region, vendor, count(*) AS n, sum({_ACC}) AS n_accepted
        FROM v_fl GROUP BY ALL)
        SELECT region, vendor, n, CAST(n_accepted AS BIGINT) AS n_accepted,
               round((n_accepted + {R.d(1)}) * {R.d(1000000)} / (CAST(n AS DOUBLE) + {R.d(2)})) / {R.d(1000000)}
                 AS smoothed_rate,
               round((n_accepted + {R.d(1)}) * {R.d(2)} * {R.d(1000000)} / ((CAST(n AS DOUBLE) + {R.d(2)}) * {R.d(1)})) / {R.d(1000000)} AS multiplier FROM g""",
    "adjusted_confidence": _FL + f""", g AS (SELECT region, vendor, count(*) AS n, sum({_ACC}) AS n_accepted
        FROM v_fl GROUP BY ALL),
        m AS (SELECT region, vendor, round((n_accepted + {R.d(1)}) * {R.d(2)} * {R.d(1000000)} / ((CAST(n AS DOUBLE) + {R.d(2)}) * {R.d(1)})) / {R.d(1000000)} AS multiplier FROM g),
        l AS (SELECT md5('quote:' || CAST(proposal_id AS VARCHAR)) AS quote_id, product_id, round(sim, 4) AS similarity_score,
                     product_region AS region, product_vendor AS vendor FROM v_qlines),
        a AS (SELECT l.*, round(least({R.d(1)}, l.similarity_score * coalesce(m.multiplier, {R.d(1)})), 4) AS adjusted_score
              FROM l LEFT JOIN m USING (region, vendor))
        SELECT quote_id, product_id, similarity_score, adjusted_score, {OV.tier('adjusted_score')} AS adjusted_tier FROM a""",
    "calibration_curve": _FL + f""" SELECT CAST(floor(similarity_score * 10) AS INTEGER) AS bucket, count(*) AS n,
        round(sum({_ACC}) * {R.d(1000000)} / CAST(count(*) AS DOUBLE)) / {R.d(1000000)} AS acceptance_rate
        FROM v_fl GROUP BY 1""",
    "rejection_signals": _FL + ", " + _Z + f""" SELECT f.event_id, f.quote_id, f.product_id,
        f.similarity_score < {R.d(0.6)} AS material_mismatch,
        coalesce(abs(z.z) > {R.d(2)}, false) AS price_anomaly,
        ({OV.tier('f.similarity_score')}) = 'high' AS confidence_miscalibrated
        FROM v_fl f LEFT JOIN v_z z USING (product_id) WHERE f.verdict = 'rejected'""",
    "price_anomaly": _P + ", " + _Z + f""" SELECT product_id, category, region, price_value, z,
        coalesce(abs(z) > {R.d(2)}, false) AS is_anomaly FROM v_z""",
    "robust_price": _P + """, m AS (SELECT *, median(price_value) OVER (PARTITION BY category, region) AS median FROM v_products),
        d AS (SELECT *, median(abs(price_value - median)) OVER (PARTITION BY category, region) AS mad FROM m)
        SELECT product_id, category, region, price_value, median, mad,
               CASE WHEN mad > 0 THEN round(0.6745::DOUBLE * (price_value - median) / mad, 4) END AS robust_z FROM d""",
    "price_median_parts": _P + """ SELECT CASE WHEN partkey % 10 > 0 THEN 'most' END AS part, median(price_value) AS median_price
        FROM v_products GROUP BY 1""",
    "vendor_price_ratio": _P + """, med AS (SELECT category, median(price_value) AS category_median FROM v_products GROUP BY 1),
        vm AS (SELECT vendor, category, avg(price_value) AS m,
                      round(avg(CAST(round(price_value * 100) AS BIGINT)) * 100) / 10000.0 AS vendor_mean,
                      count(*) AS n FROM v_products GROUP BY 1, 2)
        SELECT vendor, category, n, vendor_mean, round(category_median, 4) AS category_median,
               round(m / NULLIF(category_median, 0), 6) AS ratio FROM vm JOIN med USING (category)""",
    "unit_normalize": _P + " SELECT product_id, unit, CASE " + " ".join(
        f"WHEN unit = '{a}' THEN '{n}'" for a, n in FB.UNIT_ALIASES) + " ELSE unit END AS unit_normalized FROM v_products",
    "region_price": _P + """, o AS (SELECT avg(price_value) AS m FROM v_products)
        SELECT region, count(*) AS n,
               round(avg(CAST(round(price_value * 100) AS BIGINT)) * 100) / 10000.0 AS avg_price,
               round(avg(price_value) / (SELECT m FROM o), 6) AS multiplier FROM v_products GROUP BY 1""",
    "stale_products": _P + """, mx AS (SELECT max(updated_at) AS m FROM v_products)
        SELECT product_id, updated_at, CAST(date_diff('day', CAST(updated_at AS DATE), CAST((SELECT m FROM mx) AS DATE))
               AS INTEGER) AS age_days
        FROM v_products WHERE date_diff('day', CAST(updated_at AS DATE), CAST((SELECT m FROM mx) AS DATE)) > 30""",
    "schema_validate": """SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k,
        TRY_CAST(json_extract(props, '$.k') AS INTEGER) IS NOT NULL AS is_valid FROM events""",
}
