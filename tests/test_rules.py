"""Golden cases for the transcript and pricing rules (expected values follow the rules)."""
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import parse_price_fr, title_words
from tessera.functions.vectors import confidence_tier
from tessera.operators import catalog as C
from tessera.operators import pricing as P
from tessera.operators import transcript as TR


def one(spark, col, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(col(F.col("x")).alias("y")).first()["y"]


def test_area_reads_integer_before_m2(spark):
    assert one(spark, TR.area_m2, "floor 12.5 m2") == 5.0
    assert one(spark, TR.area_m2, "bathroom of 12m²") == 12.0
    assert one(spark, TR.area_m2, "no area") is None


def test_city_first_by_position_and_comparison_trap(spark):
    assert one(spark, TR.labour_city, "price comparison") == "Paris"
    assert one(spark, TR.labour_city, "in LYON then paris") == "Lyon"
    assert one(spark, lambda c: TR.labour_city(c, word_boundary=True), "price comparison") is None


def test_renovation_type_last_match_wins(spark):
    assert one(spark, TR.renovation_type, "bathroom renovation") == "renovation"
    assert one(spark, TR.renovation_type, "new kitchen") == "kitchen"
    assert one(spark, TR.renovation_type, "nothing here") is None


def test_vendor_first_in_list_order(spark):
    assert one(spark, TR.vendor_mention, "manomano or castorama") == "castorama"
    assert one(spark, TR.vendor_mention, "Leroy Merlin glue") == "leroy merlin"


def test_task_rules_in_fixed_order(spark):
    tasks = one(spark, TR.tasks, "remove the old tiles and repaint")
    assert [t["task_name"] for t in tasks] == ["Floor Tiling (ceramic)", "Repaint Walls", "Demolition & Disposal"]
    tasks = one(spark, TR.tasks, "retile 8 m2, new toilet and vanity, plumbing")
    assert [t["task_name"] for t in tasks] == ["Floor Tiling (ceramic)", "Shower Plumbing (redo)",
                                               "Replace Toilet", "Install Vanity"]
    assert tasks[0]["area_m2"] == 8.0 and tasks[1]["area_m2"] is None


def test_material_phrases_distinct_sorted(spark):
    got = one(spark, TR.material_phrases, "Need waterproof glue from Leroy Merlin and white wall tiles, glue.")
    assert got == ["glue", "need waterproof glue", "white wall tiles"]


def test_place_earliest_position(spark):
    row = one(spark, TR.place_mention, "from Lyon to Paris")
    assert row["place"] == "Lyon" and row["region"] == "EUROPE"


@pytest.mark.parametrize("task,area,complexity,hours", [
    ("Floor Tiling (ceramic)", 3.0, None, 2.75),
    ("Floor Tiling (ceramic)", None, None, 4.0),
    ("Repaint Walls", 25.0, None, 2.5),
    ("Repaint Walls", 5.0, None, 1.0),
    ("Shower Plumbing (redo)", None, None, 6.0),
    ("Plumbing repair", None, None, 4.0),
    ("Replace Toilet", None, "high", 2.5),
    ("Replace Toilet", None, "low", 2.0),
    ("Ventilation", None, None, 4.0),   # 'ventilation' contains 'til'
    ("Something else", None, None, 3.0),
])
def test_hours(spark, task, area, complexity, hours):
    df = spark.createDataFrame([(task, area, complexity)], "t string, a double, c string")
    got = df.select(P.estimate_hours(F.col("t"), F.col("a"), F.col("c")).alias("h")).first()["h"]
    assert got == hours
    assert (got * 4) == int(got * 4)


@pytest.mark.parametrize("city,rate", [("Paris", 50.0), ("lyon", 44.0), ("Berlin", 40.0), (None, 40.0), ("", 40.0)])
def test_hourly_rate(spark, city, rate):
    df = spark.createDataFrame([(city,)], "c string")
    assert df.select(P.hourly_rate(P.city_multiplier(F.col("c"))).alias("r")).first()["r"] == rate


def test_labour_and_material_cost(spark):
    df = spark.createDataFrame([(6.0, "Paris", 12.0, 5.0)], "h double, c string, cost double, q double")
    m = P.city_multiplier(F.col("c"))
    row = df.select(P.labour_cost(F.col("h"), m).alias("l"),
                    P.material_cost(F.col("q"), P.unit_cost(F.col("cost"), m)).alias("mc")).first()
    assert row["l"] == 300.0 and row["mc"] == 75.0


def test_vat_first_keyword_in_priority_order(spark):
    rules = [("default", 0.2), ("tiling", 0.1), ("floor", 0.055)]
    df = spark.createDataFrame([("Floor tiling",), ("Paint",), (None,)], "t string")
    got = [r["v"] for r in df.select(P.vat_rate(F.col("t"), rules).alias("v")).collect()]
    assert got == [0.1, 0.2, 0.2]


def test_price_scan_and_unit_clean(spark):
    assert one(spark, C.first_price, "soit 12,99 € / m2") == "12,99 €/m²"
    assert one(spark, C.first_price, "1.299,00 €") == "299,00 €"
    assert one(spark, C.first_price, "Prix 7,50 €/m2Ajouter au panier") == "7,50 €/m²"
    assert one(spark, C.first_price, "no price") is None


def test_title_case_and_region(spark):
    assert one(spark, title_words, "leroy_merlin") == "Leroy_Merlin"
    assert one(spark, C.region_from_host, "https://www.castorama.fr/") == "France"
    assert one(spark, C.region_from_host, "https://shop.example.it/x") == "Italy"
    assert one(spark, C.region_from_host, "https://example.com") == "Unknown"


def test_confidence_tier_and_nan(spark):
    df = spark.createDataFrame([(0.8,), (0.81,), (0.6,), (float("nan"),), (None,)], "s double")
    got = [r["t"] for r in df.select(confidence_tier(F.col("s")).alias("t")).collect()]
    assert got == ["medium", "high", "low", "low", "low"]


def test_french_price_parse(spark):
    df = spark.createDataFrame([("1.299,00",), ("12.99",), ("abc",)], "p string")
    got = [r["v"] for r in df.select(parse_price_fr(F.col("p")).alias("v")).collect()]
    assert got[0] == 1299.0 and got[1] == 1299.0 and got[2] is None


def test_duration_days():
    assert math.ceil(25 / 24) == 2
