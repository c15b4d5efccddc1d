"""The live acceptance equals the batch one after every delivery, with repeated, changed and withdrawn verdicts and a restart."""
import datetime as dt
import uuid

from pyspark.sql import functions as F

from tessera.operators import feedback as FB
from tessera.session import scratch_path
from tessera.streaming.acceptance import acceptance_stream

FEEDBACK = "event_id long, quote_id string, task_id string, user_type string, verdict string, comment string, created_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def event(i, quote, verdict, hours, user="client"):
    return (i, quote, "t", user, verdict, None, None if hours is None else T0 + dt.timedelta(hours=hours))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def quote_lines(spark):
    rows = [("q1", "p1", "EU", "v"), ("q1", "p2", "EU", "w"), ("q2", "p1", "EU", "v"), ("q3", "p3", None, "v")]
    return (spark.createDataFrame(rows, "quote_id string, product_id string, region string, vendor string")
            .withColumns({"material": F.lit("m"), "similarity_score": F.lit(0.5), "price_value": F.lit(1.0)}))


def run(spark, deliveries, **how):
    """The stream's result after each delivery, and the batch result of the newest record of each event so far."""
    base, lines, said = scratch_path(spark, f"acceptance-{uuid.uuid4().hex}"), quote_lines(spark), {}
    for rows in deliveries:
        spark.createDataFrame(rows, FEEDBACK).coalesce(1).write.mode("append").parquet(f"{base}/src")
        got = acceptance_stream(spark, f"{base}/src", FEEDBACK, lines, f"{base}/out", f"{base}/ckpt", **how)
        said.update({r[0]: r for r in rows if r[6] is not None})
        fb = spark.createDataFrame(list(said.values()), FEEDBACK)
        yield rows_of(got), rows_of(FB.adaptive_multiplier(FB.with_lines(fb, lines)))


def test_live_acceptance_equals_batch_after_each_delivery(spark):
    deliveries = [
        [event(i, f"q{i % 4}", "accepted" if i % 3 else "rejected", i) for i in range(40)],
        [event(3, "q3", "accepted", 3), event(5, "q1", "rejected", 5), event(6, "q2", "rejected", 6), event(50, "q1", "accepted", 50)],  # repeated, changed
        [event(5, "q1", None, 5), event(7, "q3", "accepted", 7, user="supplier"), event(60, "q2", "accepted", 2), event(61, "q9", "accepted", 60),
         event(62, "q1", "accepted", None)],  # withdrawn, invalid, late, of no known quote, without a time
        [event(5, "q1", "accepted", 5), event(3, "q3", "rejected", 3)],
    ]
    for got, expected in run(spark, deliveries):
        assert got == expected


def test_lines_are_forgotten_after_the_horizon_but_still_count(spark):
    deliveries = [[event(1, "q1", "accepted", 0), event(2, "q2", "rejected", 1)], [event(3, "q3", "accepted", 24 * 60)], [event(4, "q3", "accepted", 24 * 61)],
                  [event(1, "q1", "rejected", 0), event(5, "q2", "accepted", 24 * 61)]]
    steps = list(run(spark, deliveries, horizon_days=5))
    assert steps[2][0] == steps[2][1]
    # event 1 can no longer be changed: its first verdict stays
    counts = {(r[0], r[1]): (r[2], r[3]) for r in steps[3][0]}
    assert counts["EU", "v"] == (3, 2) and counts["EU", "w"] == (1, 1) and counts[None, "v"] == (2, 2)
