"""Medians by histogram refinement against numpy."""
import math
import random

import numpy as np

from tessera.operators.selection import medians, robust_scores

INF = float("inf")


def by_group(rows):
    out = {}
    for g, v in rows:
        if v is not None and math.isfinite(v):
            out.setdefault(g, []).append(v)
    return out


def test_medians_of_all_groups_at_once(spark):
    rnd = random.Random(2)
    rows = [("hot", rnd.choice([rnd.gauss(100, 5), float(rnd.randrange(50)), 7.0])) for _ in range(9000)]  # nine tenths of the rows, many ties
    rows += [(rnd.choice([None, "a", "b"]), rnd.lognormvariate(0, 9)) for _ in range(900)]
    rows += [("one", 3.5), ("two", -1.0), ("two", 4.0), ("same", 2.0), ("same", 2.0), ("none", None), ("nan", float("nan")), ("nan", 1.0), ("inf", INF), ("inf", -INF)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 5e-324, 0.0, 1e-320, -1e-320, 1.0)] + [("near", x) for x in (1.0, math.nextafter(1.0, 2), 5e-324, 1e-323)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["median"] for r in medians(df, ["g"], "v").collect()}
    assert got == {g: (min(m) + max(m)) / 2 for g, vs in by_group(rows).items() for m in [sorted(vs)[(len(vs) - 1) // 2: len(vs) // 2 + 1]]}


def test_median_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "v double")
    assert medians(df, [], "v").first()["median"] == 50.0
    assert medians(df.where("v < 0"), ["v"], "v").count() == 0


def test_robust_scores(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", 5.0), (None, 1.0), (None, 3.0), ("a", None), ("a", INF)]
    got = robust_scores(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    assert len(got) == len(rows)
    for r in got:
        vs = np.array(by_group(rows)[r["g"]])
        assert r["median"] == np.median(vs) and r["mad"] == np.median(np.abs(vs - np.median(vs)))
        fine = r["v"] is not None and math.isfinite(r["v"]) and r["mad"] > 0
        assert (r["robust_z"] == round(0.6745 * (r["v"] - r["median"]) / r["mad"], 4)) if fine else r["robust_z"] is None


def test_no_window_over_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert "Window" not in robust_scores(df, ["g"], "v")._jdf.queryExecution().toString()
