"""Packs stream past held lookups: what a search writes does not grow with pairs, and equal vectors are scored once whatever their filters."""
import numpy as np
from pyspark.sql import functions as F
from test_match import _clusters, _data, brute, collect

from tessera.functions.plan import discard, stored
from tessera.operators import ann
from tessera.operators import match as M
from tessera.operators import packs as PK

PLAIN = {"use_filters": False, "degrade": False, "filters": ()}


def test_stored_packs_are_not_shuffled_and_rows_are_not_copied_for_pairs(spark):
    packs = stored(spark.range(400).select(F.col("id").alias("pblock"), F.lit("p").alias("b")).repartition(8), "few-packs")
    asked = spark.range(300).select(F.array("id").alias("q_ids"))

    def told(batches):
        import pyarrow as pa
        for kinds in PK.cells(batches):
            n = {kind: len(list(mine)) for kind, mine in kinds}
            yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]])], ["lookups", "packs"])

    made = PK.grid(packs, asked, (3, 5), told, "lookups long, packs long")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # the lookups, once
    got = made.collect()
    assert len(got) == 15 and sum(r["lookups"] for r in got) == 3 * 300 and sum(r["packs"] for r in got) == 5 * 400
    discard(packs)


def test_one_list_of_candidates_however_many_packs_stream_past(spark, monkeypatch):
    P, Q, prods, qs, cat, q = _data(spark)
    monkeypatch.setattr(PK, "HELD_BYTES", 1000)
    search = M.Search(q, cat, M.MatchConfig(block_rows=10, **PLAIN))
    assert search.catalog.packs.count() >= 30
    assert search.cands.where("query_id IS NOT NULL").count() == 40 * 5
    search.close()
    for few in (0, 1 << 20):  # all by matrix products, all one by one
        monkeypatch.setattr(M, "FEW_PAIRS", few)
        assert collect(M.top_k(q, cat, M.MatchConfig(block_rows=10))) == brute(P, Q, prods, qs)
        assert collect(M.top_k(q, cat, M.MatchConfig(block_rows=10, prune=True, cells=8))) == brute(P, Q, prods, qs)


def test_equal_vectors_of_different_regions_are_scored_once(spark):
    rng = np.random.default_rng(21)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    prods = [(f"p{i:04d}", v[i % 200].tolist(), ["EU", "AF", "AS"][i % 3], f"v{i % 7}") for i in range(3000)]
    cat = spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string")
    Q = rng.normal(size=(50, 8))
    qs = [(i, Q[i].tolist(), None, None, 5) for i in range(50)]
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>, region string, vendor string, q_limit int")
    search = M.Search(q, cat, M.MatchConfig(block_rows=256))
    assert collect(search.hits()) == brute(np.array([v[i % 200] for i in range(3000)]), Q, prods, qs)
    assert search.report().first()["cells"] == 50 * 200
    search.close()


def test_two_filters_and_nearly_equal_scores_give_the_rows_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(PK, "HELD_BYTES", 4000)
    rng = np.random.default_rng(22)
    base = rng.normal(size=(30, 16))
    P = (base[rng.integers(0, 30, 900)] + 1e-5 * rng.normal(size=(900, 16))).astype(np.float32)  # scores tie at four decimals
    prods = [(f"p{i:04d}", P[i].tolist(), [None, "EU", "AF"][i % 3], [f"v{i % 11}", None][i % 13 == 0]) for i in range(900)]
    Q = base[rng.integers(0, 30, 80)] + 0.1 * rng.normal(size=(80, 16))
    qs = [(i, Q[i].tolist(), [None, "EU", "", "AF"][i % 4], [None, f"v{i % 11}", "none"][i % 3], 5) for i in range(80)]
    cat = spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string")
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>, region string, vendor string, q_limit int")
    unit = P.astype(float) / np.linalg.norm(P.astype(float), axis=1, keepdims=True)
    want = {}
    for i, _, region, vendor, _ in qs:
        s = np.round(unit @ (Q[i] / np.linalg.norm(Q[i])), 4)
        passed = [j for j in range(900) if region in (None, "", prods[j][2]) and vendor in (None, prods[j][3])]
        want[i] = ([prods[j][0] for j in sorted(passed or range(900), key=lambda j: (-s[j], j))[:5]], not passed)
    for few in (0, 4096):
        monkeypatch.setattr(M, "FEW_PAIRS", few)
        assert collect(M.top_k(q, cat, M.MatchConfig(block_rows=32))) == want


def test_index_search_gives_one_list_for_each_lookup_of_a_task(spark, monkeypatch):
    P, Q, prods, qs, cat, q = _clusters(spark)
    index = ann.AnnIndex.build(cat, q, cells=20, probes=20, block_rows=64)
    whole = sorted(map(tuple, index.search(q, 5).drop("sim").collect()))
    monkeypatch.setattr(PK, "HELD_BYTES", 3000)
    monkeypatch.setattr(ann, "LISTED", 7)
    assert sorted(map(tuple, index.search(q, 5).drop("sim").collect())) == whole
    index.delete()
