"""Feedback rollups kept up to date: partial aggregates per day and key, merged instead of worked out again.

A partial holds what sums up: rows, accepted rows, and both by score bucket (a histogram of width 0.1), for each day, material,
region, vendor and user type. Rollups, the smoothed acceptance and the calibration curve are sums of partials, so they read a few
rows for each key and day instead of all feedback.

The table lies in folders ``day=.../arrival=n``. An arrival writes a new version of the days it has rows of and of no
other: the sum of the day's version before it and its own partials, or, where days are delivered anew, its own alone.
Written again, an arrival reads the same versions before it and replaces its own, so a retry changes nothing.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio_rounded
from tessera.operators import feedback as FB

KEYS = ["material", "region", "vendor", "user_type"]
FIELDS = "material string, region string, vendor string, user_type string, bucket int, n long, n_accepted long, day string, arrival long"
NO_DAY = "none"  # rows without a time


def partials(lines: DataFrame, time: str = "created_at") -> DataFrame:
    """Partials of feedback lines (``feedback.with_lines``)."""
    day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(NO_DAY))
    rows = lines.select(day.alias("day"), *KEYS, F.floor(F.col("similarity_score") * 10).cast("int").alias("bucket"),
                        F.coalesce((F.col("verdict") == "accepted").cast("long"), F.lit(0)).alias("_ok"))
    return rows.groupBy("day", *KEYS, "bucket").agg(F.count("*").alias("n"), F.sum("_ok").alias("n_accepted"))


class DailyRollup:
    """The table of partials under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(FIELDS).option("basePath", self.path).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], FIELDS)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version of each day (before an arrival)."""
        table = self._all()
        if before is not None:
            table = table.where(F.col("arrival") < before)
        last = F.broadcast(table.groupBy("day").agg(F.max("arrival").alias("arrival")))  # a row a day
        return table.join(last, ["day", "arrival"], "left_semi")

    def arrive(self, lines: DataFrame, arrival: int, replace: bool = False) -> list[str]:
        """Take in an arrival of feedback lines; ``replace``: it holds its days whole. Returns the days written."""
        own = partials(lines)
        if not replace:
            days = F.broadcast(own.select("day").distinct())  # a row a day
            before = self.read(arrival).join(days, "day", "left_semi").drop("arrival")
            own = (own.unionByName(before).groupBy("day", *KEYS, "bucket")
                   .agg(F.sum("n").alias("n"), F.sum("n_accepted").alias("n_accepted")))
        (own.withColumn("arrival", F.lit(arrival).cast("long")).repartition("day", F.pmod(F.xxhash64(*KEYS), F.lit(8)))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "arrival").parquet(self.path))
        return sorted(r["day"] for r in self._all().where(F.col("arrival") == arrival).select("day").distinct().collect())

    def vacuum(self) -> int:
        """Delete the versions that a later one of their day has taken the place of; returns their number."""
        versions = [(r["day"], r["arrival"]) for r in self._all().select("day", "arrival").distinct().collect()]
        newest = {d: max(a for x, a in versions if x == d) for d, _ in versions}
        old = [(d, a) for d, a in versions if a < newest[d]]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for d, a in old:
            at = hadoop(f"{self.path}/day={d}/arrival={a}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(old)

    # ---- what the partials sum up to
    def rollup(self) -> DataFrame:
        """As ``feedback.rollup``."""
        return self.read().rollup(*KEYS).agg(F.sum("n").alias("n"), ratio_rounded(F.sum("n_accepted"), F.sum("n"), 6).alias("acceptance_rate"))

    def multipliers(self) -> DataFrame:
        """As ``feedback.adaptive_multiplier``."""
        sums = self.read().groupBy("region", "vendor").agg(F.sum("n").alias("n"), F.sum("n_accepted").alias("n_accepted"))
        return FB.smoothed(sums)

    def calibration(self) -> DataFrame:
        """As ``feedback.calibration_curve``."""
        return self.read().groupBy("bucket").agg(F.sum("n").alias("n"), ratio_rounded(F.sum("n_accepted"), F.sum("n"), 6).alias("acceptance_rate"))
