"""Stored versions: validity intervals, and the version that was valid at a time (as-of join).

The as-of join is no range product. Both sides are united by key and day and a running last value over time gives
each row its version. A key is cut into the days on which it has rows, so that a quote with a large share
of all feedback is spread over its days; a first pass over versions and days alone says which version each day starts with.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def validity(versions: DataFrame, key: str = "quote_id", version: str = "version", start: str = "valid_from", ended: str | None = None) -> DataFrame:
    """``versions`` with ``valid_to``: the next version's start, but at most ``ended``; null while a version is valid.

    Of versions that start together the highest number is valid, the others for no time at all.
    """
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start, version))
    return versions.withColumn("valid_to", F.least(following, F.col(ended)) if ended else following)


def as_of(rows: DataFrame, versions: DataFrame, time: str, carry: list[str], key: str = "quote_id", version: str = "version",
          start: str = "valid_from", end: str = "valid_to", grain: str = "day") -> DataFrame:
    """``rows`` with the columns ``carry`` of the version of their key that was valid at ``time``; nulls if none was.

    A version is valid from ``start`` on and before ``end``. Rows without key or time have no version.
    """
    part: Column = F.date_trunc(grain, F.col("_t"))
    named = rows.columns
    payload = F.struct(F.col(end).alias("_end"), *[F.col(c) for c in carry])
    v = versions.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        F.col(key).alias("_k"), F.col(start).alias("_t"), F.col(version).alias("_n"), payload.alias("_v"))
    asked = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.struct(*named).alias("_row"))
    whole = F.col("_k").isNotNull() & F.col("_t").isNotNull()

    # The version that each day of a key starts with: days are few against rows.
    days = asked.where(whole).select("_k", part.alias("_t")).distinct()
    none_v, none_row = F.lit(None).cast(v.schema["_v"].dataType), F.lit(None).cast(asked.schema["_row"].dataType)
    number = v.schema["_n"].dataType
    both = v.select("_k", "_t", F.lit(0).alias("_kind"), "_n", "_v").unionByName(
        days.select("_k", F.col("_t").cast(v.schema["_t"].dataType).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(number).alias("_n"), none_v.alias("_v")))
    in_order = Window.partitionBy("_k").orderBy("_t", "_kind", "_n").rowsBetween(*RUNNING)
    seeds = both.withColumn("_v", F.last("_v", True).over(in_order)).where("_kind = 1")

    day_of = v.join(days.select("_k", F.col("_t").alias("_day")), "_k").where(part == F.col("_day"))
    every = (seeds.select("_k", part.alias("_day"), "_t", F.lit(0).alias("_kind"), "_n", "_v", none_row.alias("_row"))
             .unionByName(day_of.select("_k", "_day", "_t", F.lit(1).alias("_kind"), "_n", "_v", none_row.alias("_row")))
             .unionByName(asked.where(whole).select("_k", part.alias("_day"), F.col("_t").cast(v.schema["_t"].dataType).alias("_t"), F.lit(2).alias("_kind"),
                                                    F.lit(None).cast(number).alias("_n"), none_v.alias("_v"), "_row")))
    in_day = Window.partitionBy("_k", "_day").orderBy("_t", "_kind", "_n").rowsBetween(*RUNNING)
    found = every.withColumn("_v", F.last("_v", True).over(in_day)).where("_kind = 2")
    valid = F.col("_v").isNotNull() & (F.col("_v._end").isNull() | (F.col("_t") < F.col("_v._end")))
    out = found.select("_row.*", *[F.when(valid, F.col(f"_v.{c}")).alias(c) for c in carry])
    types = {f.name: f.dataType for f in versions.schema.fields}
    without = asked.where(~whole).select("_row.*", *[F.lit(None).cast(types[c]).alias(c) for c in carry])
    return out.unionByName(without)
