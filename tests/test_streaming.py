"""Streaming: append mode with a watermark drops late rows and withholds open windows."""
import datetime as dt
import os
import tempfile

from tessera.streaming import jobs

SCHEMA = "event_id long, verdict string, created_at timestamp_ntz"


def test_append_mode_drops_late_rows(spark):
    base = tempfile.mkdtemp(prefix="tessera-stream-")
    src = os.path.join(base, "src")
    d = dt.datetime

    def stage(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stage([(1, "accepted", d(2024, 1, 10, 8)), (2, "accepted", d(2024, 1, 10, 9)), (3, "rejected", d(2024, 1, 10, 9))])
    stage([(4, "accepted", d(2024, 1, 20, 8))])                     # watermark moves to Jan 19
    # Spark drops a row as late when it is older than the previous batch's watermark (Jan 9 09:00
    # here): Jan 5 is dropped, Jan 10 12:00 still counts, then Jan 10 is closed and emitted
    stage([(5, "accepted", d(2024, 1, 5, 8)), (6, "accepted", d(2024, 1, 10, 12))])
    # now the late-row watermark is Jan 19: both rows are dropped, Jan 10 is not emitted twice
    stage([(7, "accepted", d(2024, 1, 10, 13)), (8, "rejected", d(2024, 1, 6, 8))])
    out = jobs.daily_feedback_counts(spark, src, SCHEMA, os.path.join(base, "out"), os.path.join(base, "ck"),
                                     mode="append")
    got = sorted((str(r["day"]), r["verdict"], r["n"]) for r in out.collect())
    # Jan 20 is still open at the end and withheld
    assert got == [("2024-01-10", "accepted", 3), ("2024-01-10", "rejected", 1)]
