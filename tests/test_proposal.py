"""Proposal assembly on hand-made rows: margin before de-dup, de-dup first kept, totals."""
from pyspark.sql import functions as F

from tessera.operators import proposal as PR
from tessera.operators import transcript as TR


def test_two_phrases_same_product(spark):
    t = spark.createDataFrame([(1, "Need tile glue and ceramic tile for the bathroom floor, 3 m2")],
                              "proposal_id long, transcript string")
    parsed = TR.parse(t)
    cat = spark.createDataFrame([("p1", "Tile A", "10,00", 10.0, [1.0, 0.0], "EUROPE", "S1")],
                                "product_id string, material_name string, unit_price string, price_value double, "
                                "embedding array<float>, region string, vendor string")

    def encode(df, col):
        return df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    props, lines = PR.assemble(parsed, cat, encode)
    row = props.first()
    assert row["n_materials"] == 2            # both phrases counted for the margin term
    assert row["materials"] == "Tile A"        # one product after de-dup
    assert abs(row["margin_protected_price"] - 2 * 11 * 1.2) < 1e-9
    assert row["prices_sum"] == 10.0
    assert row["confidence_score"] == 1.0
    # tiling 3 m2 -> 2.75 h at 40/h = 110.0; total = ceil(10 + 26.4 + 110)
    assert row["labor_cost"] == 110.0 and row["total_estimate"] == 147
    assert row["estimated_duration"] == "1 day"
    assert lines.count() == 1


def test_no_tasks_no_materials(spark):
    t = spark.createDataFrame([(2, "hello")], "proposal_id long, transcript string")
    cat = spark.createDataFrame([("p1", "Tile A", "10,00", 10.0, [1.0, 0.0], "EUROPE", "S1")],
                                "product_id string, material_name string, unit_price string, price_value double, "
                                "embedding array<float>, region string, vendor string")
    props, _ = PR.assemble(TR.parse(t), cat, lambda df, c: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))))
    row = props.first()
    assert row["total_estimate"] == 0 and row["label"] == "Tile bathroom walls" and row["vat_rate"] == 0.0
