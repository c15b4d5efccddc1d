"""Medians of all groups at once without sorting a group: repeated histogram refinement.

Each wanted rank of each group has a bracket of values that holds it, at first from the group's smallest value to
its largest. A round counts the rows of every bracket in BINS equal bins (combined on the map side: a row for each
group, bin and task is all that moves) and goes on with the bin that holds the rank, from the smallest value in it to the
largest. When these are equal the rank is found, exactly. Rounds follow the range of the values, not their number, and a group that
holds most of the rows costs no more than others.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.plan import discard, join_keeping_nulls, stored

BINS = 1024


def medians(rows: DataFrame, groups: list[str], value: str, alias: str = "median") -> DataFrame:
    """(groups, ``alias``): the median of the finite values of each group, the mean of the middle two for even counts.

    Groups without a finite value are left out; a null is a group of its own.
    """
    v = F.col("_v")
    base = rows.select(*groups, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sizes = base.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)))
    open_ = stored(sizes.select(*groups, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi"), "ranks")
    tables, found = [open_], open_.where("_lo = _hi")
    while open_.where("_lo < _hi").take(1):
        brackets = open_.where("_lo < _hi").withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
        inside = join_keeping_nulls(base, brackets, groups).where(v.between(F.col("_from"), F.col("_to"))) if groups else \
            base.join(F.broadcast(brackets)).where(v.between(F.col("_from"), F.col("_to")))  # two rows
        # rising in v in floating point as well; halves keep the range finite
        width = F.col("_to") / 2 - F.col("_from") / 2
        share = F.when(width > 0, (v / 2 - F.col("_from") / 2) / width).otherwise((v > F.col("_from")).cast("double"))
        binned = inside.withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
        bins = (binned.groupBy(*groups, "_rank", "_below", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
                .groupBy(*groups, "_rank", "_below").agg(F.array_sort(F.collect_list(F.struct("_bin", "_c", "_lo", "_hi"))).alias("_bins")))  # BINS at most
        start = F.struct(F.col("_below").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
        held = F.aggregate("_bins", start, lambda a, b: F.when(a["lo"].isNotNull(), a).when(
            a["below"] + b["_c"] >= F.col("_rank"), F.struct(a["below"].alias("below"), b["_lo"].alias("lo"), b["_hi"].alias("hi"))).otherwise(
            F.struct((a["below"] + b["_c"]).alias("below"), a["lo"].alias("lo"), a["hi"].alias("hi"))))
        open_ = stored(bins.select(*groups, "_rank", held.alias("_h")).select(
            *groups, "_rank", F.col("_h.below").alias("_below"), F.col("_h.lo").alias("_lo"), F.col("_h.hi").alias("_hi")), "ranks")
        tables.append(open_)
        found = found.unionByName(open_.where("_lo = _hi"))
    out = stored(found.groupBy(*groups).agg(((F.min("_lo") + F.max("_lo")) / 2).alias(alias)), "medians")
    discard(*tables)
    return out


def robust_scores(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``rows`` with ``median`` and ``mad`` (median absolute deviation) of their group and ``robust_z``.

    robust_z is 0.6745 (value - median) / mad, to four decimals; null where mad is 0 or the value is missing or not finite.
    """
    centre = medians(rows, groups, value)
    joined = join_keeping_nulls(rows, centre, groups, "left")
    spread = medians(joined.withColumn("_off", F.abs(F.col(value) - F.col("median"))), groups, "_off", "mad")
    out = join_keeping_nulls(joined, spread, groups, "left")
    v = F.col(value).cast("double")
    z = F.round(F.lit(0.6745) * (v - F.col("median")) / F.col("mad"), 4)
    return out.withColumn("robust_z", F.when((F.col("mad") > 0) & ~F.isnan(v) & (F.abs(v) < float("inf")), z))
