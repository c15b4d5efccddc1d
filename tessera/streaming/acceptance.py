"""Acceptance of each (region, vendor) kept live in a stream's keyed state, with changed and repeated verdicts taken back.

State, per (region, vendor) and one of SALTS parts of the line ids (so that a hot pair is not one task): how many lines count and how many of
them are accepted, and what each line last said (in buckets of lines, so that calls to the state do not grow with the lines). A line that comes again with the same verdict changes nothing; with another one
its old verdict is taken back first; with none it is taken out. The watermark runs ``horizon_days`` behind the newest event. What is older comes
too late and is left out, and a timer on event time forgets what the lines of a day said once the day is behind the watermark: they still
count, but can no longer be changed. The state lives in the RocksDB store and so outlasts a restart.
"""
from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import feedback as FB
from tessera.streaming.jobs import run_available

SALTS = 4
BUCKETS = 512  # of the lines of a key: what they said is read and written a bucket at a time
DAY_MS = 86_400_000
OUT = "region string, vendor string, salt int, n long, n_accepted long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Acceptance(StatefulProcessor):
    """Counts of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n long, n_accepted long")
        self.said = handle.getMapState("said", "bucket int", "lines string")

    def handleInputRows(self, key, rows, timerValues):
        n, yes = self.counts.get() if self.counts.exists() else (0, 0)
        days, told = set(), {}
        for pdf in rows:
            for line, verdict, day in zip(pdf["line"], pdf["verdict"], pdf["day_ms"]):
                told.setdefault(zlib.crc32(line.encode()) % BUCKETS, []).append((line, verdict, int(day)))
        for bucket, lines in told.items():  # a bucket is read and written once
            said = json.loads(self.said.getValue((bucket,))[0]) if self.said.containsKey((bucket,)) else {}
            for line, verdict, day in lines:
                if line in said:
                    n, yes = n - 1, yes - said.pop(line)[0]
                if verdict is None or verdict == "":
                    continue
                accepted = int(verdict == "accepted")
                n, yes = n + 1, yes + accepted
                said[line] = (accepted, day)
                days.add(day)
            self._keep(bucket, said)
        self.counts.update((n, yes))
        for day in days:
            self.handle.registerTimer(max(day + DAY_MS, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([(*key, n, yes)], columns=["region", "vendor", "salt", "n", "n_accepted"])

    def _keep(self, bucket: int, said: dict) -> None:
        if said:
            self.said.updateValue((bucket,), (json.dumps(said),))
        else:
            self.said.removeKey((bucket,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs()
        for (bucket,), (lines,) in list(self.said.iterator()):
            said = json.loads(lines)
            left = {k: x for k, x in said.items() if x[1] + DAY_MS > until}
            if len(left) < len(said):
                self._keep(bucket, left)
        return iter(())

    def close(self) -> None:
        pass


def acceptance_stream(spark: SparkSession, src: str, schema, quote_lines: DataFrame, out: str, ckpt: str, horizon_days: int = 30) -> DataFrame:
    """Take in the feedback present under ``src``; the smoothed acceptance so far, as ``feedback.adaptive_multiplier``.

    A line is a feedback event on one product of its quote. Rows without a time take no part. Called again with the same folders
    the stream goes on where it stopped.
    """
    lines = quote_lines.select("quote_id", "product_id", "region", "vendor")
    fb = FB.validate(spark.readStream.schema(schema).parquet(src)).where("quote_id IS NOT NULL AND created_at IS NOT NULL")
    # an invalid record says nothing: it takes back what its event said before
    verdict = F.when(F.col("status") == "accepted", F.col("verdict"))
    rows = (fb.withColumn("created_ts", F.col("created_at").cast("timestamp")).withWatermark("created_ts", f"{horizon_days} days")
            .join(lines, "quote_id")
            .select("region", "vendor", F.concat_ws("|", F.col("event_id").cast("string"), "product_id").alias("line"), verdict.alias("verdict"),
                    (F.unix_millis(F.date_trunc("day", "created_ts"))).alias("day_ms"), "created_ts"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
    counted = rows.groupBy("region", "vendor", "salt").transformWithStateInPandas(
        statefulProcessor=Acceptance(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same rows again on a replay

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        run_available(counted.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(sink))
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    try:
        told = spark.read.schema(f"{OUT}, epoch long").option("basePath", out).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        told = spark.createDataFrame([], f"{OUT}, epoch long")
    newest = told.groupBy("region", "vendor", "salt").agg(F.max_by(F.struct("n", "n_accepted"), "epoch").alias("c"))
    sums = newest.groupBy("region", "vendor").agg(F.sum("c.n").alias("n"), F.sum("c.n_accepted").alias("n_accepted"))
    return FB.smoothed(sums.where("n > 0"))
