"""Validity intervals, as-of joins, and rollups kept over arrivals."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import feedback as FB
from tessera.operators import history as H
from tessera.operators.rollups import DailyRollup
from tessera.session import scratch_path

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


VERSIONS = "quote_id string, version int, valid_from timestamp_ntz, gone timestamp_ntz, total long"


def test_validity_ends_with_the_next_version_or_before(spark):
    rows = [("a", 1, at(0), None, 10), ("a", 2, at(5), at(8), 20), ("a", 3, at(10), None, 30), ("b", 1, at(1), at(2), 40), ("b", 2, at(1), None, 50)]
    got = {(r.quote_id, r.version): r.valid_to for r in H.validity(spark.createDataFrame(rows, VERSIONS), ended="gone").collect()}
    assert got == {("a", 1): at(5), ("a", 2): at(8), ("a", 3): None, ("b", 1): at(1), ("b", 2): None}


def brute(rows, versions):
    out = []
    for r in rows:
        best = None
        if r[1] is not None and r[2] is not None:
            for q, n, a, b, total in versions:
                if q == r[1] and a <= r[2] and (best is None or (a, n) > (best[0], best[1])):
                    best = (a, n, b, total)
        ok = best is not None and (best[2] is None or r[2] < best[2])
        out.append((*r, best[1] if ok else None, best[3] if ok else None))
    return sorted(out, key=repr)


def test_as_of_with_gaps_ties_and_a_hot_key(spark):
    rnd = random.Random(3)
    versions = []
    for q in "abcdef":
        n = rnd.randrange(1, 6)
        starts = sorted(at(rnd.choice([0, 24, 24, 30, 48, 53, 90])) for _ in range(n))
        versions += [(q, i + 1, s, None if rnd.random() < 0.6 else s + dt.timedelta(hours=7), 100 * i) for i, s in enumerate(starts)]
    table = spark.createDataFrame([(q, n, a, b, t) for q, n, a, b, t in versions], VERSIONS)
    intervals = H.validity(table, ended="gone")
    flat = [(r.quote_id, r.version, r.valid_from, r.valid_to, r.total) for r in intervals.collect()]
    rows = [(i, "a" if i % 2 else rnd.choice("abcdefz"), at(rnd.choice([-5, 0, 6.9, 7, 24, 24.5, 30, 31, 48, 60, 89, 90, 97, 200]))) for i in range(400)]
    rows += [(900, None, at(5)), (901, "a", None), (901, "a", None), (902, "a", at(24)), (902, "a", at(24))]
    df = spark.createDataFrame(rows, "event_id long, quote_id string, created_at timestamp_ntz").repartition(3)
    got = H.as_of(df, intervals, "created_at", ["version", "total"])
    assert got.columns == ["event_id", "quote_id", "created_at", "version", "total"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, flat)


def test_as_of_without_versions_or_rows(spark):
    none = H.validity(spark.createDataFrame([], VERSIONS))
    rows = spark.createDataFrame([(1, "a", at(1))], "event_id long, quote_id string, created_at timestamp_ntz")
    assert [tuple(r) for r in H.as_of(rows, none, "created_at", ["version"]).collect()] == [(1, "a", at(1), None)]
    assert H.as_of(rows.where("event_id > 1"), none, "created_at", ["version"]).count() == 0


def test_hot_key_is_dealt_over_its_days(spark):
    rows = spark.range(3000).select("id", F.lit("hot").alias("quote_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 40)).alias("t"))
    versions = H.validity(spark.createDataFrame([("hot", 1, T0, None, 1), ("hot", 2, at(24 * 9 + 5), None, 2)], VERSIONS))
    got = H.as_of(rows, versions, "t", ["version"])
    assert {(r["version"], r["count"]) for r in got.groupBy("version").count().collect()} == {(1, 750), (2, 2250)}
    assert "hashpartitioning(_k#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "_day#" in plan.split("last(_v", 2)[1]


LINES = ("event_id long, material string, region string, vendor string, user_type string, verdict string, similarity_score double, "
         "created_at timestamp_ntz")


def lines(spark, n=600, seed=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["tile", "paint", None]), rnd.choice(["EU", None]), rnd.choice("uv"), rnd.choice(["client", "contractor"]),
             rnd.choice(["accepted", "rejected", "accepted"]), rnd.choice([0.05, 0.61, 0.72, 1.0, None]),
             None if i % 97 == 0 else at(24 * (i % 12) + i % 24)) for i in range(n)]
    return spark.createDataFrame(rows, LINES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark):
    return DailyRollup(spark, scratch_path(spark, f"rollup-{uuid.uuid4().hex}"))


def same(table, fl):
    assert rows_of(table.rollup()) == rows_of(FB.rollup(fl))
    assert rows_of(table.multipliers()) == rows_of(FB.adaptive_multiplier(fl))
    assert rows_of(table.calibration()) == rows_of(FB.calibration_curve(fl))


def test_kept_rollups_equal_batch_after_each_arrival(spark, table):
    fl = lines(spark)
    early, late = F.coalesce(F.dayofmonth("created_at") <= 6, F.lit(True)), F.col("event_id") % 5 == 0
    parts = [early & ~late, ~early, early & late]
    assert table.read().count() == 0
    seen = F.lit(False)
    for n, part in enumerate(parts):
        table.arrive(fl.where(part), n)
        seen = seen | part
        same(table, fl.where(seen))
    # a retried arrival changes nothing
    table.arrive(fl.where(parts[2]), 2)
    same(table, fl)


def test_an_arrival_rewrites_its_days_only_and_replaces_days_delivered_anew(spark, table):
    fl = lines(spark)
    first = table.arrive(fl, 0)
    assert len(first) == 13 and "none" in first
    day = fl.where(F.dayofmonth("created_at") == 3)
    files = lambda: {f for f in table._all().inputFiles()}
    before = files()
    assert table.arrive(day.limit(20), 1, replace=True) == ["2024-01-03"]
    assert before <= files() and all("day=2024-01-03/arrival=1" in f for f in files() - before)
    rest = fl.where(F.coalesce(F.dayofmonth("created_at") != 3, F.lit(True)))
    assert table.read().agg(F.sum("n")).first()[0] == rest.count() + 20
    assert table.vacuum() == 1 and table.vacuum() == 0
    assert table.read().agg(F.sum("n")).first()[0] == rest.count() + 20


def test_a_partial_row_sums_many(spark, table):
    fl = lines(spark).withColumn("material", F.lit("one")).withColumn("created_at", F.lit(T0).cast("timestamp_ntz"))
    table.arrive(fl, 0)
    assert table.read().count() < 60 and table.read().agg(F.sum("n")).first()[0] == 600
