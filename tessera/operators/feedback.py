"""Feedback on quotes: validation, append, and the analytics the feedback loop needs.

Feedback rows are keyed by (quote_id, task_id); quote lines carry the
products behind each quote, so every product-level rollup is one equi-join
on quote_id followed by grouping. No rollup collects a group's rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.numeric import mean_rounded, ratio_rounded
from tessera.functions.plan import join_keeping_nulls
from tessera.functions.vectors import confidence_tier
from tessera.operators.selection import medians

# Prior for the smoothed acceptance rate (ours): (accepted + a) / (n + a + b).
PRIOR_ACCEPT = 1.0
PRIOR_REJECT = 1.0
# Rejection-signal thresholds (ours).
MISMATCH_BELOW = fixed.TIER_MEDIUM
ANOMALY_Z = 2.0
# Unit aliases (ours): written form -> normalised unit.
UNIT_ALIASES = [("€/sqm", "€/m²"), ("€/m2", "€/m²"), ("€/sq m", "€/m²"), ("€/l", "€/litre")]


def validate(fb: DataFrame) -> DataFrame:
    """Add status ('accepted' / 'rejected') and the first failing rule as reason."""
    reason = (F.when(F.coalesce(F.col("task_id"), F.lit("")) == "", F.lit("missing_task_id"))
               .when(F.coalesce(F.col("quote_id"), F.lit("")) == "", F.lit("missing_quote_id"))
               .when(~F.coalesce(F.col("user_type"), F.lit("")).isin(*fixed.FEEDBACK_USER_TYPES),
                     F.lit("bad_user_type"))
               .when(F.coalesce(F.col("verdict"), F.lit("")) == "", F.lit("missing_verdict")))
    return (fb.withColumn("reason", reason)
              .withColumn("status", F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))))


def to_record(fb: DataFrame) -> DataFrame:
    """The stored feedback record; the request's ``comment`` is kept as ``comments``."""
    return fb.select("task_id", "quote_id", "user_type", "verdict", F.col("comment").alias("comments"),
                     "created_at")


def append(fb: DataFrame, path: str) -> None:
    """Append valid records to the feedback table (Parquet), rejects to ``path``_rejects."""
    v = validate(fb)
    to_record(v.where("status = 'accepted'")).write.mode("append").parquet(path)
    v.where("status = 'rejected'").write.mode("append").parquet(path.rstrip("/") + "_rejects")


def append_batch(fb: DataFrame, path: str, batch: str, received_at) -> None:
    """Append a batch of feedback, stamped with the server's time, in one write; written again, it replaces itself.

    Accepted records and rejects (with reason) lie in folders of their own under ``path``: ``status=.../batch=...``.
    """
    rows = validate(fb).select("task_id", "quote_id", "user_type", "verdict", F.col("comment").alias("comments"), "created_at", "reason",
                               F.lit(received_at).cast("timestamp").alias("received_at"), "status", F.lit(batch).alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").parquet(path)


def with_lines(fb: DataFrame, quote_lines: DataFrame) -> DataFrame:
    """Valid feedback joined to the products of its quote."""
    v = validate(fb).where("status = 'accepted'")
    lines = quote_lines.select("quote_id", "product_id", "material", "similarity_score", "price_value",
                               "region", "vendor")
    return v.join(lines, "quote_id")


def accepted(verdict: Column) -> Column:
    return (verdict == "accepted").cast("double")


def rollup(fl: DataFrame) -> DataFrame:
    """Counts and acceptance by material, region, vendor, user type with subtotals (ROLLUP)."""
    return (fl.rollup("material", "region", "vendor", "user_type")
              .agg(F.count("*").alias("n"),
                   ratio_rounded(F.sum(accepted(F.col("verdict"))), F.count("*"), 6).alias("acceptance_rate")))


def smoothed(counts: DataFrame, a: float = PRIOR_ACCEPT, b: float = PRIOR_REJECT) -> DataFrame:
    """Counts (region, vendor, n, n_accepted) with the smoothed acceptance rate and the confidence multiplier it implies."""
    n, yes = F.col("n") + F.lit(a + b), F.col("n_accepted") + F.lit(a)
    return counts.select("region", "vendor", "n", F.col("n_accepted").cast("long").alias("n_accepted"),
                         ratio_rounded(yes, n, 6).alias("smoothed_rate"), ratio_rounded(yes * F.lit(a + b), n * F.lit(a), 6).alias("multiplier"))


def adaptive_multiplier(fl: DataFrame, a: float = PRIOR_ACCEPT, b: float = PRIOR_REJECT) -> DataFrame:
    """Smoothed acceptance per (region, vendor) and the confidence multiplier it implies."""
    g = fl.groupBy("region", "vendor").agg(F.count("*").alias("n"), F.sum(accepted(F.col("verdict"))).alias("n_accepted"))
    return smoothed(g, a, b)


def calibration_curve(fl: DataFrame) -> DataFrame:
    """Acceptance per similarity decile (bucket = floor(score * 10))."""
    return (fl.withColumn("bucket", F.floor(F.col("similarity_score") * 10).cast("int"))
              .groupBy("bucket").agg(F.count("*").alias("n"),
                                     ratio_rounded(F.sum(accepted(F.col("verdict"))), F.count("*"), 6)
                                     .alias("acceptance_rate")))


def price_zscores(products: DataFrame) -> DataFrame:
    """z-score of each price within its (category, region).

    Group statistics come from a partial (map-side) aggregation joined back,
    not from a window over each group, so a group holding a large share of
    the rows is never buffered in one task.
    """
    stats = products.groupBy("category", "region").agg(F.avg("price_value").alias("_mean"),
                                                       F.stddev_samp("price_value").alias("_sd"))
    z = F.round(F.try_divide(F.col("price_value") - F.col("_mean"), F.col("_sd")), 4)
    return join_keeping_nulls(products, stats, ["category", "region"], "left").withColumn("z", z).drop("_mean", "_sd")


def price_anomalies(products: DataFrame, z: float = ANOMALY_Z) -> DataFrame:
    p = price_zscores(products)
    return p.withColumn("is_anomaly", F.coalesce(F.abs(F.col("z")) > z, F.lit(False)))


def rejection_signals(fl: DataFrame, products: DataFrame) -> DataFrame:
    """For rejected feedback: low similarity, price anomaly in (category, region), high tier rejected."""
    z = price_anomalies(products).select("product_id", "category", "is_anomaly")
    r = fl.where("verdict = 'rejected'").join(z, "product_id", "left")
    return r.select("event_id", "quote_id", "product_id",
                    (F.col("similarity_score") < MISMATCH_BELOW).alias("material_mismatch"),
                    F.coalesce(F.col("is_anomaly"), F.lit(False)).alias("price_anomaly"),
                    (confidence_tier(F.col("similarity_score")) == "high").alias("confidence_miscalibrated"))


def exact_median(df: DataFrame, group: str, value: str, alias: str = "median") -> DataFrame:
    """Exact median (mean of the two middle values for even counts) per group; no step sorts or holds a group."""
    return medians(df, [group], value, alias)


def vendor_price_ratio(products: DataFrame) -> DataFrame:
    """Vendor mean price over the category median (exact median), per (vendor, category)."""
    med = exact_median(products, "category", "price_value", "category_median")
    vm = products.groupBy("vendor", "category").agg(F.avg("price_value").alias("_mean"),
                                                    mean_rounded("price_value", 4, 2).alias("vendor_mean"),
                                                    F.count("*").alias("n"))
    return (join_keeping_nulls(vm, med, ["category"])
              .select("vendor", "category", "n", "vendor_mean",
                      F.round("category_median", 4).alias("category_median"),
                      F.round(F.try_divide(F.col("_mean"), F.col("category_median")), 6).alias("ratio")))


def normalize_unit(unit: Column) -> Column:
    expr = unit
    for alias, norm in reversed(UNIT_ALIASES):
        expr = F.when(unit == F.lit(alias), F.lit(norm)).otherwise(expr)
    return expr


def region_price(products: DataFrame) -> DataFrame:
    """Regional price level: region mean over the overall mean."""
    overall = products.select(F.avg("price_value")).scalar()
    g = products.groupBy("region").agg(F.count("*").alias("n"), F.avg("price_value").alias("_mean"),
                                       mean_rounded("price_value", 4, 2).alias("avg_price"))
    return g.select("region", "n", "avg_price", F.round(F.col("_mean") / overall, 6).alias("multiplier"))


def stale(products: DataFrame, max_age_days: int = 30) -> DataFrame:
    """Products whose update is older than ``max_age_days`` before the newest update."""
    newest = products.select(F.max("updated_at")).scalar()
    age = F.datediff(F.to_date(newest), F.to_date("updated_at"))
    return products.select("product_id", "updated_at", age.alias("age_days")).where(F.col("age_days") > max_age_days)


def adjust_confidence(quote_lines: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Fold feedback back into confidence: score x (region, vendor) multiplier, capped at 1,
    with the tier recomputed; pairs without feedback keep their score."""
    m = multipliers.select("region", "vendor", "multiplier")
    j = join_keeping_nulls(quote_lines, m, ["region", "vendor"], "left")
    adj = F.round(F.least(F.lit(1.0), F.col("similarity_score") * F.coalesce(F.col("multiplier"), F.lit(1.0))), 4)
    return j.select("quote_id", "product_id", "similarity_score", adj.alias("adjusted_score"),
                    confidence_tier(adj).alias("adjusted_tier"))
