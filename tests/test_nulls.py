"""Null groups keep their statistics; nothing is lost in deliveries; configuration files of any path."""
import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import feedback as FB
from tessera.sources import reference_data as RD
from tessera.streaming import jobs


def test_null_groups_keep_their_statistics(spark):
    rows = [(f"p{i}", None if i < 5 else "a", None if i % 2 else "r", "v", float(i % 5)) for i in range(10)]
    p = spark.createDataFrame(rows, "product_id string, category string, region string, vendor string, price_value double")
    z = {r["product_id"]: r["z"] for r in FB.price_zscores(p).collect()}
    assert len(z) == 10 and all(v is not None for v in z.values())
    got = {r["category"]: (r["category_median"], r["n"]) for r in FB.vendor_price_ratio(p).collect()}
    assert got == {None: (2.0, 5), "a": (2.0, 5)}


def test_null_pairs_keep_their_multiplier(spark):
    lines = spark.createDataFrame([("q", "p", None, "v", 0.5)],
                                  "quote_id string, product_id string, region string, vendor string, similarity_score double")
    m = spark.createDataFrame([(None, "v", 1.5)], "region string, vendor string, multiplier double")
    assert FB.adjust_confidence(lines, m).first()["adjusted_score"] == 0.75


@pytest.mark.parametrize("times", [[0, 1, 2, 3, 4, 5, 6], [0, 999_999_999], [None, None], [None, 5, 5], []])
def test_deliveries_keep_every_row_once(spark, times):
    base = tempfile.mkdtemp(prefix="tessera-deliveries-")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if t is None else start + dt.timedelta(microseconds=t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    seen = [spark.read.schema(df.schema).parquet(f"{base}/src").count() for _ in jobs.deliveries(df, f"{base}/src", "at", 3)]
    ids = sorted(r["id"] for r in spark.read.schema(df.schema).parquet(f"{base}/src").collect())
    assert ids == list(range(len(times))) and seen == sorted(seen)


def test_upsert_rewrites_only_the_buckets_of_a_batch(spark):
    base = tempfile.mkdtemp(prefix="tessera-upsert-")
    schema = "product_id string, unit_price string, batch_id int, seq long"
    first = spark.createDataFrame([(f"p{i}", "1", 0, i) for i in range(50)], schema)
    want = {f"p{i}": "1" for i in range(50)}
    for n, rows in enumerate([[("p1", "2", 1, 0), ("p1", "3", 1, 1)], [("p1", "4", 2, 0), ("new", "5", 2, 1)], [("p2", "6", 3, 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
        got = jobs.upsert_stream(spark, f"{base}/src", schema, f"{base}/table", f"{base}/ck", first if n == 0 else None)
        want.update({r[0]: r[1] for r in rows})
        assert {r["product_id"]: r["unit_price"] for r in got.collect()} == want
    written = spark.read.parquet(f"{base}/table")
    assert written.where("epoch = 0").select("bucket").distinct().count() == 1
    assert written.where("epoch = 1").select("bucket").distinct().count() <= 2


def test_rates_from_a_uri_and_malformed_files(spark):
    d = tempfile.mkdtemp(prefix="tessera-rates-")
    for name, body in (("city.json", json.dumps({"nice": 1.3})), ("vat.json", '{"default": 0.2, "Floor": 0.055}'),
                       ("items.json", '{"nail": {"unit": "each", "cost": 0.5}}'), ("bad.json", "{not json")):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(body)
    uri = f"file://{d}"
    assert [tuple(r) for r in RD.city_modifiers(spark, f"{uri}/city.json").collect()] == [("Nice", 1.3)]
    assert [tuple(r) for r in RD.vat_rates(spark, f"{uri}/vat.json").collect()] == [(0, "default", 0.2), (1, "floor", 0.055)]
    assert [tuple(r) for r in RD.rate_card(spark, f"{uri}/items.json").collect()] == [("nail", "each", 0.5)]
    assert RD.city_modifiers(spark, f"{uri}/none.json").count() == 4
    for read in (RD.city_modifiers, RD.vat_rates, RD.rate_card):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(spark, f"{uri}/bad.json").collect()
    with open(os.path.join(d, "t.csv"), "w") as fh:
        fh.write("default_hours,task_name,default_qty,default_material\n2,Fit Sink,1,sink\n")
    assert [tuple(r) for r in RD.task_templates(spark, f"{uri}/t.csv").collect()] == [("Fit Sink", 2.0, "sink", 1.0)]
