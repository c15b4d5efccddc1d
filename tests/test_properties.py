"""Property tests: many generated inputs evaluated in one Spark job each."""
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import parse_price_fr
from tessera.operators import pricing as P
from tessera.sources.views import price_display

TASKS = ["Floor Tiling (ceramic)", "Repaint Walls", "Shower Plumbing (redo)", "Replace Toilet",
         "Install Vanity", "Demolition & Disposal", "Other"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(TASKS),
                          st.one_of(st.none(), st.floats(min_value=-5, max_value=500, allow_nan=False)),
                          st.sampled_from([None, "high", "low", "standard"])), min_size=1, max_size=40))
def test_hours_are_quarter_hours_and_positive(spark, rows):
    df = spark.createDataFrame(rows, "t string, a double, c string")
    for r in df.select(P.estimate_hours(F.col("t"), F.col("a"), F.col("c")).alias("h")).collect():
        assert r["h"] > 0 and math.isclose(r["h"] * 4, round(r["h"] * 4))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=999_999), min_size=1, max_size=40))
def test_price_display_parses_back(spark, cents):
    df = spark.createDataFrame([(c / 100.0,) for c in cents], "p double")
    out = df.select("p", parse_price_fr(price_display(F.col("p"))).alias("q")).collect()
    assert all(abs(r["p"] - r["q"]) < 1e-9 for r in out)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=20), min_size=1, max_size=60))
def test_exact_median_matches_numpy(spark, values):
    import numpy as np
    from tessera.operators.feedback import exact_median
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, p double")
    got = exact_median(df, "g", "p").first()["median"]
    assert got == float(np.median(values))
