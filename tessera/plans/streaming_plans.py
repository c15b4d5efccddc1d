"""Registered streaming queries: each runs a file stream to completion and returns
its final output, which must equal the batch form (same oracle SQL)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.plan import stored
from tessera.operators import match as M
from tessera.plans import catalog_plans as CP
from tessera.plans import feedback_plans as FP
from tessera.plans import match_plans as MP
from tessera.plans import oracle_views as OV
from tessera.plans import proposal_plans as PP
from tessera.session import scratch_path
from tessera.sources import views
from tessera.streaming import jobs
from tessera.streaming.acceptance import acceptance_stream

DELIVERIES = 4


def _dirs(spark, name):
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    return f"{base}/src", f"{base}/out", f"{base}/ckpt", base


def stream_feedback_daily(spark, sf_dir):
    src, out, ckpt, _ = _dirs(spark, "stream-daily")
    fb = views.feedback(spark, sf_dir)
    for _ in jobs.deliveries(fb, src, "created_at", DELIVERIES):
        res = jobs.daily_feedback_counts(spark, src, fb.schema, out, ckpt, files_per_batch=None)
    return res.select("day", "verdict", "n")


def stream_dedup(spark, sf_dir):
    src, out, ckpt, _ = _dirs(spark, "stream-dedup")
    fb = views.feedback(spark, sf_dir)
    # every fifth event is delivered twice
    dup = fb.unionByName(fb.where(F.col("event_id") % 5 == 0))
    for _ in jobs.deliveries(dup, src, "created_at", DELIVERIES):
        res = jobs.dedup_valid_feedback(spark, src, fb.schema, out, ckpt, files_per_batch=None)
    return res.select("event_id", "quote_id", "user_type", "verdict", "status")


def stream_upsert(spark, sf_dir):
    src, _, ckpt, base = _dirs(spark, "stream-upsert")
    b0, b1 = CP._batches(spark, sf_dir)
    # three overlapping deliveries: the last one repeats all updates, the ones before hold parts of them
    initial = b0
    for share in (b1.where("seq % 3 = 0"), b1.where("seq % 2 = 0"), b1):
        share.write.mode("append").parquet(src)
        res = jobs.upsert_stream(spark, src, b1.schema, f"{base}/table", ckpt, initial)
        initial = None
    return res.select("product_id", "unit_price", "batch_id")


def stream_lookups(spark, sf_dir):
    src, out, ckpt, _ = _dirs(spark, "stream-lookups")
    q = views.queries(spark, sf_dir)
    cat = views.products(spark, sf_dir)
    packed = M.PackedCatalog(cat)

    def finish(hits):
        return M.attach_products(hits, cat).select(*MP.TOPK_COLUMNS)
    try:
        for _ in jobs.deliveries(q, src, "query_id", DELIVERIES):
            res = jobs.lookup_stream(spark, src, q.schema, packed, out, ckpt, finish=finish, files_per_batch=None)
    finally:
        packed.unpersist()
    return res.select(*MP.TOPK_COLUMNS)


def stream_multiplier(spark, sf_dir):
    """Acceptance by (region, vendor) kept in a stream's state over four deliveries: every tenth event first comes with another
    verdict and is corrected later."""
    src, out, ckpt, _ = _dirs(spark, "stream-multiplier")
    lines = stored(PP.build(spark, sf_dir)[1], "quote-lines")
    fb = views.feedback(spark, sf_dir)
    wrong = fb.where("event_id % 10 = 3 AND verdict IS NOT NULL").withColumn(
        "verdict", F.when(F.col("verdict") == "accepted", F.lit("rejected")).otherwise(F.lit("accepted")))
    last = fb.select(F.max("event_id") + 1).scalar()
    told = wrong.withColumn("seq", F.col("event_id")).unionByName(
        fb.withColumn("seq", F.col("event_id") + F.when(F.col("event_id") % 10 == 3, last).otherwise(F.lit(0))))
    for _ in jobs.deliveries(told, src, "seq", DELIVERIES):
        res = acceptance_stream(spark, src, told.schema, lines, out, ckpt)
    return res


QUERIES = {
    "stream_multiplier": stream_multiplier,
    "stream_feedback_daily": stream_feedback_daily,
    "stream_dedup": stream_dedup,
    "stream_upsert": stream_upsert,
    "stream_lookups": stream_lookups,
}

SQL = {
    "stream_multiplier": FP.SQL["adaptive_multiplier"],
    "stream_feedback_daily": "WITH " + OV.feedback().strip() + """
        SELECT CAST(created_at AS DATE) AS day, verdict, count(*) AS n FROM v_feedback GROUP BY ALL""",
    "stream_dedup": FP.SQL["feedback_valid"].split(" SELECT event_id, quote_id")[0] + """
        SELECT event_id, quote_id, user_type, verdict, 'accepted' AS status FROM v_fbv WHERE reason IS NULL""",
    "stream_upsert": CP.SQL["catalog_upsert"],
    "stream_lookups": MP.SQL["match_topk"],
}
