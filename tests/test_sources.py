"""Readers, writers and small contracts: JSON array read, conformance, config files, feedback append,
bulk load, nested proposal record, unknown rate-card items."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import feedback as FB
from tessera.operators import pricing as P
from tessera.operators import proposal as PR
from tessera.sources import catalog_io as IO
from tessera.sources import reference_data as RD


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-test-")


def test_json_array_and_corrupt_records(spark):
    d = _tmp()
    path = os.path.join(d, "products.json")
    recs = [{"product_id": "s|1", "material_name": "A", "description": None, "unit_price": "1,00", "unit": "€",
             "region": "France", "vendor": "S", "vat_rate": None, "quality_score": None, "source": "u1"},
            {"product_id": "s|2", "material_name": "B", "description": None, "unit_price": "2,00", "unit": "€",
             "region": "France", "vendor": "S", "vat_rate": None, "quality_score": None, "source": "u2"}]
    with open(path, "w") as fh:
        json.dump(recs, fh)
    df = IO.read_products_json(spark, path, multi_line=True)
    assert sorted(r["product_id"] for r in df.collect()) == ["s|1", "s|2"]
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as fh:
        fh.write('{"product_id": "ok"}\n{not json\n')
    rows = IO.read_products_json(spark, bad).collect()
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_conform_adds_missing_columns(spark):
    df = spark.createDataFrame([("p", "n")], "product_id string, material_name string")
    out = IO.conform(df)
    assert out.columns == [f.name for f in IO.CATALOG_SCHEMA.fields]


def test_config_files_and_defaults(spark):
    d = _tmp()
    mods = os.path.join(d, "city.json")
    with open(mods, "w") as fh:
        json.dump({"paris": 1.5, "NICE": 1.2}, fh)
    got = {r["city"]: r["multiplier"] for r in RD.city_modifiers(spark, mods).collect()}
    assert got == {"Paris": 1.5, "Nice": 1.2}
    vat = os.path.join(d, "vat.json")
    with open(vat, "w") as fh:
        fh.write('{"default": 0.2, "Floor": 0.055, "tiling": 0.1}')
    rules = P.vat_rules_from_table(RD.vat_rates(spark, vat))
    assert rules == [("default", 0.2), ("floor", 0.055), ("tiling", 0.1)]
    assert RD.vat_rates(spark, os.path.join(d, "missing.json")).count() == 9
    assert RD.rate_card(spark).count() == 6 and RD.task_templates(spark).count() == 6
    yml = os.path.join(d, "s.yaml")
    with open(yml, "w") as fh:
        fh.write("supplier: acme\nurl: https://www.acme.be/\noutput:\n  min_products: 7\n")
    row = RD.suppliers(spark, [yml]).first()
    assert (row["supplier"], row["min_products"], row["sitemap_urls"]) == ("acme", 7, [])


def test_feedback_append_and_rejects(spark):
    d = _tmp()
    fb = spark.createDataFrame([
        ("t1", "q1", "client", "accepted", "fine", None),
        ("t2", "q2", "supplier", "rejected", None, None),
        ("", "q3", "contractor", "accepted", None, None)],
        "task_id string, quote_id string, user_type string, verdict string, comment string, created_at timestamp")
    FB.append(fb, os.path.join(d, "feedback"))
    good = spark.read.parquet(os.path.join(d, "feedback"))
    bad = spark.read.parquet(os.path.join(d, "feedback_rejects"))
    assert good.count() == 1 and good.first()["comments"] == "fine"
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_user_type", "missing_task_id"]


def test_bulk_load_embeds_and_upserts(spark):
    rows = spark.createDataFrame([("s|1", "Tile", None, "1,00", 0), ("s|1", "Tile B", None, "2,00", 1),
                                  ("s|2", "Glue", "strong", "3,00", 2)],
                                 "product_id string, material_name string, description string, unit_price string, "
                                 "seq long")
    first = C.load_products(rows, None, 0)
    got = {r["product_id"]: r for r in first.collect()}
    assert got["s|1"]["material_name"] == "Tile B" and len(got["s|2"]["embedding"]) == 256
    again = C.load_products(rows.where("product_id = 's|2'").withColumn("unit_price", F.lit("4,00")), first, 1)
    got2 = {r["product_id"]: r["unit_price"] for r in again.collect()}
    assert got2 == {"s|1": "2,00", "s|2": "4,00"}


def test_nested_proposal_record(spark):
    df = spark.createDataFrame([(1, "q", "bathroom", "A|B", "1 day", 26.4, 0.9, 100)],
                               "proposal_id long, quote_id string, label string, materials string, "
                               "estimated_duration string, margin_protected_price double, confidence_score double, "
                               "total_estimate long")
    row = PR.nested(df).first()
    assert row["tasks"][0]["materials"] == ["A", "B"] and row["total_estimate"] == 100


def test_unknown_items_are_rejects(spark):
    items = spark.createDataFrame([("paint_litre",), ("gold_tap",)], "item string")
    assert [r["item"] for r in P.unknown_items(items, RD.rate_card(spark)).collect()] == ["gold_tap"]


def test_nested_names_with_a_bar_stay_whole(spark):
    df = spark.createDataFrame([(1, "q", "bathroom", "A|B|C", ["A|B", "C"], "1 day", 26.4, 0.9, 100)],
                               "proposal_id long, quote_id string, label string, materials string, material_list array<string>, "
                               "estimated_duration string, margin_protected_price double, confidence_score double, total_estimate long")
    assert PR.nested(df).first()["tasks"][0]["materials"] == ["A|B", "C"]


def test_feedback_batch_is_one_write_and_replaces_itself(spark):
    import datetime
    path = os.path.join(_tmp(), "feedback")
    schema = "task_id string, quote_id string, user_type string, verdict string, comment string, created_at timestamp"
    rows = [("t1", "q1", "client", "accepted", "fine", None), ("t2", "q2", "supplier", "rejected", None, None)]
    at = datetime.datetime(2024, 2, 1, 12, tzinfo=datetime.UTC)
    for batch in ("a", "b", "b"):
        FB.append_batch(spark.createDataFrame(rows, schema), path, batch, at)
    got = spark.read.parquet(path)
    assert sorted((r["status"], r["batch"], r["reason"]) for r in got.collect()) == [
        ("accepted", "a", None), ("accepted", "b", None), ("rejected", "a", "bad_user_type"), ("rejected", "b", "bad_user_type")]
    assert got.select("received_at").distinct().count() == 1


def test_upsert_rejects_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "product_id string, seq int")
    assert [(r["seq"], r["reject_reason"]) for r in C.upsert_rejects(df).collect()] == [(2, "missing_key")]
