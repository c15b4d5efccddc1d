"""Registered queries over stored versions and kept rollups, and their DuckDB oracles."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.plan import stored
from tessera.operators import feedback as FB
from tessera.operators import history as H
from tessera.operators.rollups import DailyRollup
from tessera.plans import feedback_plans as FP
from tessera.plans import oracle_views as OV
from tessera.plans import proposal_plans as PP
from tessera.session import scratch_path
from tessera.sources import views
from tessera.sources.tables import read_table


def quote_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions of each order's quote: one to four, some days apart; every sixth quote is withdrawn two days after its last.

    quote_id, version, valid_from, withdrawn_at, total_cents.
    """
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    rows = orders.select("*", F.explode(F.sequence(F.lit(1), (F.lit(1) + k % 4).cast("int"))).alias("version"))
    hours = (k * 7 % 25) * 24 + k * 13 % 24 + (F.col("version") - 1) * (k % 5) * 24
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=hours.cast("int"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    last = (k % 6 == 0) & (F.col("version") == F.lit(1) + k % 4)
    return rows.select(F.md5(F.concat(F.lit("quote:"), k.cast("string"))).alias("quote_id"), "version", start.alias("valid_from"),
                       F.when(last, start + F.make_dt_interval(days=F.lit(2))).alias("withdrawn_at"),
                       F.call_function("div", cents * (F.lit(103) - F.lit(3) * F.col("version")), F.lit(100)).alias("total_cents"))


def quote_intervals(spark, sf_dir):
    """Validity interval of each stored version."""
    return H.validity(quote_versions(spark, sf_dir), ended="withdrawn_at").select("quote_id", "version", "valid_from", "valid_to", "total_cents")


def quote_asof(spark, sf_dir):
    """Each feedback with the version of its quote that was valid when it was given; none before the first and after the end."""
    versions = stored(quote_intervals(spark, sf_dir), "quote-versions")
    fb = views.feedback(spark, sf_dir).select("event_id", "quote_id", "created_at")
    return H.as_of(fb, versions, "created_at", ["version", "total_cents"])


_VERSIONS = """v_versions AS (
  SELECT md5('quote:' || CAST(o_orderkey AS VARCHAR)) AS quote_id, CAST(version AS INTEGER) AS version,
         TIMESTAMP '2024-01-01' + to_hours(CAST((o_orderkey * 7 % 25) * 24 + o_orderkey * 13 % 24 + (version - 1) * (o_orderkey % 5) * 24 AS INTEGER)) AS valid_from,
         CAST(round(o_totalprice * 100) AS BIGINT) * (103 - 3 * version) // 100 AS total_cents,
         o_orderkey % 6 = 0 AND version = 1 + o_orderkey % 4 AS last
  FROM orders, unnest(range(1, 5)) AS r(version) WHERE version <= 1 + o_orderkey % 4),
v_intervals AS (
  SELECT *, least(lead(valid_from) OVER (PARTITION BY quote_id ORDER BY valid_from, version),
                  CASE WHEN last THEN valid_from + INTERVAL 2 DAY END) AS valid_to FROM v_versions)"""


def _arrivals(spark, sf_dir) -> list[DataFrame]:
    """The feedback lines in three arrivals: the first half of January, the rest, and late rows of the first five days."""
    lines = stored(PP.build(spark, sf_dir)[1], "quote-lines")
    fb = views.feedback(spark, sf_dir)
    day = F.dayofmonth("created_at")
    late = F.coalesce((day <= 5) & (F.col("event_id") % 3 == 0), F.lit(False))
    first = F.coalesce(day <= 15, F.lit(True))
    return [FB.with_lines(part, lines) for part in (fb.where(first & ~late), fb.where(~first & ~late), fb.where(late))]


def _kept(spark, sf_dir) -> DailyRollup:
    table = DailyRollup(spark, scratch_path(spark, f"rollup-{uuid.uuid4().hex}"))
    for n, lines in enumerate(_arrivals(spark, sf_dir)):
        table.arrive(lines, n)
    return table


def rollup_incremental(spark, sf_dir):
    """The feedback rollup from partials kept over three arrivals, the last one late."""
    return _kept(spark, sf_dir).rollup()


def multiplier_incremental(spark, sf_dir):
    """Smoothed acceptance from the kept partials."""
    return _kept(spark, sf_dir).multipliers()


def calibration_incremental(spark, sf_dir):
    """Calibration curve from the kept partials."""
    return _kept(spark, sf_dir).calibration()


QUERIES = {
    "quote_intervals": quote_intervals,
    "quote_asof": quote_asof,
    "rollup_incremental": rollup_incremental,
    "multiplier_incremental": multiplier_incremental,
    "calibration_incremental": calibration_incremental,
}

SQL = {
    "quote_intervals": f"WITH {_VERSIONS} SELECT quote_id, version, valid_from, valid_to, total_cents FROM v_intervals",
    "quote_asof": f"""WITH {OV.feedback().strip()}, {_VERSIONS}
SELECT f.event_id, f.quote_id, f.created_at, v.version, v.total_cents
FROM v_feedback f LEFT JOIN v_intervals v
  ON v.quote_id = f.quote_id AND f.created_at >= v.valid_from AND (v.valid_to IS NULL OR f.created_at < v.valid_to)""",
    "rollup_incremental": FP.SQL["feedback_rollup"],
    "multiplier_incremental": FP.SQL["adaptive_multiplier"],
    "calibration_incremental": FP.SQL["calibration_curve"],
}
