"""Matcher: exact top-k against brute force, degrade path, grid path, ties, properties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import match as M


def _data(spark, n_prod=300, n_q=40, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    P = rng.normal(size=(n_prod, dim)).astype(np.float32)
    P[7] = P[3]  # an exact tie
    Q = rng.normal(size=(n_q, dim))
    regions = ["EU", "AF", "AS"]
    prods = [(f"p{i:04d}", P[i].tolist(), regions[i % 3], f"v{i % 5}") for i in range(n_prod)]
    qs = [(i, Q[i].tolist(), (regions[i % 3] if i % 4 else None) if i % 10 != 9 else "NOWHERE", None, 5)
          for i in range(n_q)]
    cat = spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string")
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>, region string, vendor string, q_limit int")
    return P, Q, prods, qs, cat, q


def brute(P, Q, prods, qs, k=5):
    Pn = P.astype(np.float64) / np.linalg.norm(P.astype(np.float64), axis=1, keepdims=True)
    out = {}
    for qi, (qid, _, reg, _, _) in enumerate(qs):
        qv = Q[qi] / np.linalg.norm(Q[qi])
        s = Pn @ qv
        idx = [j for j in range(len(prods)) if reg in (None, "") or prods[j][2] == reg]
        degraded = not idx
        if degraded:
            idx = list(range(len(prods)))
        order = sorted(idx, key=lambda j: (-round(float(s[j]), 4), prods[j][0]))[:k]
        out[qid] = ([prods[j][0] for j in order], degraded)
    return out


def collect(hits):
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], ([], r["degraded"]))[0].append(r["product_id"])
    return got


def test_exact_topk_matches_brute_force(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    got = collect(M.top_k(q, cat, M.MatchConfig(block_rows=64)))
    assert got == brute(P, Q, prods, qs)


def test_grid_path_equals_broadcast_path(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    a = collect(M.top_k(q, cat, M.MatchConfig(block_rows=50)))
    b = collect(M.top_k(q, cat, M.MatchConfig(block_rows=50, max_broadcast_bytes=0, query_block_rows=7)))
    assert a == b


def test_degrade_gives_five_unfiltered(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    got = collect(M.top_k(q, cat))
    for qid, (ids, degraded) in got.items():
        if qid % 10 == 9:
            assert degraded and len(ids) == 5
        else:
            assert not degraded


def test_topk_prefix_property(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    k3 = collect(M.top_k(q, cat, M.MatchConfig(cap=3, fallback_k=3)))
    k5 = collect(M.top_k(q, cat))
    for qid in k5:
        assert k5[qid][0][:3] == k3[qid][0]


def test_limit_is_capped(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    q10 = q.withColumn("q_limit", F.lit(10))
    got = collect(M.top_k(q10, cat))
    assert all(len(ids) == 5 for ids, _ in got.values())


def test_empty_query_reported(spark):
    df = spark.createDataFrame([(1, "", []), (2, "tile", [1.0, 0.0])],
                               "query_id long, query string, embedding array<double>")
    assert [r["query_id"] for r in M.empty_queries(df).collect()] == [1]


def test_similarity_bounds_and_symmetry(spark):
    from tessera.functions.vectors import cosine
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, -1.0, 0.5]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("ab"), cosine(F.col("b"), F.col("a")).alias("ba")).collect()
    assert -1.0 <= rows[0]["ab"] <= 1.0 and rows[0]["ab"] == pytest.approx(rows[0]["ba"])
    assert rows[1]["ab"] is None  # zero norm: null, not an error


def test_zero_limit_degrades(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    q0 = q.withColumn("q_limit", F.lit(0))
    got = collect(M.top_k(q0, cat))
    assert all(degraded and len(ids) == 5 for ids, degraded in got.values())


def test_hot_region_is_not_a_hot_task(spark):
    """A region holding most of the catalog: packs are cut by position, not by region."""
    rng = np.random.default_rng(5)
    P = rng.normal(size=(400, 8)).astype(np.float32)
    prods = [(f"p{i:04d}", P[i].tolist(), "HOT" if i % 10 else "COLD", "v") for i in range(400)]
    cat = spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string")
    q = spark.createDataFrame([(1, rng.normal(size=8).tolist(), "HOT", None, 5)],
                              "query_id long, embedding array<double>, region string, vendor string, q_limit int")
    packed = M.PackedCatalog(cat.repartition(4), M.MatchConfig(block_rows=64))
    packs = packed.packs.select("n_rows", "values").collect()
    assert max(r["n_rows"] for r in packs) <= 64 and sum(r["n_rows"] for r in packs) == 400
    packed.unpersist()
    assert M.top_k(q, cat).count() == 5


def test_packed_catalog_reuse_equals_fresh(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    packed = M.PackedCatalog(cat, M.MatchConfig(block_rows=64))
    a = collect(M.top_k(q, packed, M.MatchConfig(block_rows=64)))
    b = collect(M.top_k(q, cat, M.MatchConfig(block_rows=64)))
    assert a == b == brute(P, Q, prods, qs)
    packed.unpersist()


def test_plan_cuts_topk_map_side_and_keeps_catalog_in_place(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    df = entry.queries()["match_topk"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan                    # partial top-k before the shuffle
    assert "hashpartitioning(product_id" not in plan     # the catalog is never shuffled
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unusable_vectors_leave_their_neighbours_alone(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    odd = [("x0", [1.0] * 99, "EU", "v"), ("x1", [0.0] * 16, "EU", "v"), ("x2", None, "EU", "v"), ("x3", [], "EU", "v"),
           ("x4", [float("nan")] + [1.0] * 15, "EU", "v"), ("x5", [None] + [1.0] * 15, "EU", "v"),
           ("x6", [float("inf")] + [1.0] * 15, "EU", "v")]
    spoiled = cat.unionByName(spark.createDataFrame(odd, cat.schema)).coalesce(1)
    asked = q.unionByName(spark.createDataFrame([(1000, [1.0] * 99, None, None, 5), (1001, [1.0] * 50, None, None, 5)], q.schema))
    want = brute(P, Q, prods, qs)
    for cfg in (M.MatchConfig(), M.MatchConfig(max_broadcast_bytes=0, block_rows=50, query_block_rows=7)):
        got = collect(M.top_k(asked, spoiled, cfg))
        assert got.pop(1000)[0] == ["x0"]  # the only product of its length
        assert got == want
    reasons = {r["product_id"]: r["reason"] for r in M.vector_rejects(spoiled).collect()}
    assert reasons == {"x0": "odd_length", "x1": "zero_vector", "x2": "missing_vector", "x3": "missing_vector",
                       "x4": "not_finite", "x5": "not_finite", "x6": "not_finite"}


def test_index_over_unusable_vectors_and_all_cells_equals_exact(spark):
    from tessera.operators import ann
    P, Q, prods, qs, cat, q = _data(spark)
    odd = spark.createDataFrame([("x0", [1.0] * 9, "EU", "v"), ("x1", [0.0] * 16, "EU", "v"), ("x2", None, "EU", "v")], cat.schema)
    cfg = M.MatchConfig(use_filters=False, degrade=False, filters=())
    full = ann.ann_top_k(q, cat.unionByName(odd), k=5, nlist=6, nprobe=6)
    exact = M.top_k(q, cat, cfg)
    assert ann.recall_at_k(full, exact).where("recall < 1").count() == 0


# ---- routes and bounds
def test_lookups_ask_only_the_packs_on_their_routes(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    search = M.Search(q.where("region = 'EU'"), cat, M.MatchConfig(block_rows=20))
    got, r = collect(search.hits()), search.report().first()
    assert got == {k: v for k, v in brute(P, Q, prods, qs).items() if qs[k][2] == "EU"}
    assert 0 < r["cells"] <= r["grid"] / 2 and 0 < r["asked"] < r["pairs"] / 2
    search.close()


def test_fallback_reads_nothing_when_nothing_is_empty(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    full = M.Search(q.where("region <> 'NOWHERE'"), cat)
    assert [x.rpartition("/")[2].rsplit("-", 1)[0] for x in (t._stored_at for t in full.kept)].count("candidates") == 1
    assert full.cands.where("path = 1").count() == 0
    some = M.Search(q, cat)
    assert sum("/candidates-" in t._stored_at for t in some.kept) == 2
    assert {r["query_id"] for r in some.cands.where("path = 1").select("query_id").distinct().collect()} == {i for i in range(40) if i % 10 == 9}


def test_equal_vectors_are_scored_once_and_all_of_them_found(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(6, 8)).astype(np.float32)
    prods = [(f"p{i:04d}", v[i % 6].tolist(), ["EU", None, ""][i % 3], f"v{i % 2}") for i in range(600)]
    cat = spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string")
    Q = rng.normal(size=(9, 8))
    qs = [(i, Q[i].tolist(), ["EU", None, ""][i % 3], None, 5) for i in range(9)]
    q = spark.createDataFrame(qs, "query_id long, embedding array<double>, region string, vendor string, q_limit int")
    search = M.Search(q, cat)
    assert collect(search.hits()) == brute(np.array([v[i % 6] for i in range(600)]), Q, prods, qs)
    assert search.report().first()["cells"] < 9 * 600 / 10


def _clusters(spark, n_prod=1500, n_q=60, dim=24, groups=30, seed=11):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    P = (centre[rng.integers(0, groups, n_prod)] + 0.15 * rng.normal(size=(n_prod, dim))).astype(np.float32)
    Q = centre[rng.integers(0, groups, n_q)] + 0.15 * rng.normal(size=(n_q, dim))
    regions = ["EU", "AF", "AS"]
    prods = [(f"p{i:04d}", P[i].tolist(), regions[i % 3], f"v{i % 5}") for i in range(n_prod)]
    qs = [(i, Q[i].tolist(), [None, "EU", "NOWHERE"][i % 3], None, 5) for i in range(n_q)]
    return (P, Q, prods, qs, spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string"),
            spark.createDataFrame(qs, "query_id long, embedding array<double>, region string, vendor string, q_limit int"))


def test_pruned_search_equals_exact_and_skips_most_packs(spark):
    P, Q, prods, qs, cat, q = _clusters(spark)
    search = M.Search(q, cat, M.MatchConfig(block_rows=64, prune=True, cells=30))
    assert collect(search.hits()) == brute(P, Q, prods, qs)
    r = search.report().first()
    assert r["asked"] < 0.5 * r["pairs"] and r["cells"] < 0.5 * r["grid"]
    search.close()


def test_pruned_search_on_unclustered_vectors_and_few_rows(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    for cells in (0, 8):
        assert collect(M.top_k(q, cat, M.MatchConfig(block_rows=32, prune=True, cells=cells))) == brute(P, Q, prods, qs)
    few = cat.where("product_id < 'p0003'")
    assert collect(M.top_k(q, few, M.MatchConfig(prune=True))) == brute(P[:3], Q, prods[:3], qs)
    q0 = q.withColumn("q_limit", F.lit(0))
    assert all(degraded and len(ids) == 5 for ids, degraded in collect(M.top_k(q0, cat, M.MatchConfig(prune=True))).values())


def test_upper_bounds_hold():
    from tessera.operators import packs
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.normal(size=(50, 12))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    parts = []
    for part in np.split(x[np.argsort(x[:, 0])], 10):
        c = part.mean(axis=0)
        c /= np.linalg.norm(c)
        parts.append({"centroid": c.tobytes(), "least": float((part @ c).min()), "most": (q @ part.T).max(axis=1)})
    bound = packs.upper_bounds(q, parts)
    assert all((bound[:, i] >= p["most"]).all() for i, p in enumerate(parts)) and (bound < 0.999).any()


# ---- saved index over compressed vectors
def test_index_is_saved_opened_and_deleted(spark):
    from tessera.operators import ann
    P, Q, prods, qs, cat, q = _clusters(spark)
    made = ann.AnnIndex.build(cat, q, k=5, cells=30)
    again = ann.AnnIndex.open(spark, made.path)
    assert again.model.probes == made.model.probes < 30 and again.model.recall >= 0.97
    a, b = (sorted(map(tuple, i.search(q, 5).collect())) for i in (made, again))
    assert a == b and len(a) == 5 * 60
    exact = M.top_k(q, cat, M.MatchConfig(use_filters=False, degrade=False, filters=()))
    assert ann.recall_at_k(again.search(q, 5), exact).agg(F.avg("recall")).first()[0] >= 0.95
    vectors = {p: np.array(v, float) for p, v, *_ in prods}
    for i, _, product, sim in a:
        assert sim == pytest.approx(Q[i] @ vectors[product] / np.linalg.norm(Q[i]) / np.linalg.norm(vectors[product]), abs=1e-12)
    with pytest.raises(ValueError):
        again.search(q, ann.KEEP + 1)
    made.delete()
    with pytest.raises(Exception):
        ann.AnnIndex.open(spark, made.path)


def test_index_of_many_equal_vectors_and_hot_cell(spark):
    """A vector of half the rows: all of its smallest ids are found, and packs stay bounded."""
    from tessera.operators import ann
    rng = np.random.default_rng(13)
    v = rng.normal(size=(200, 16)).astype(np.float32)
    prods = [(f"p{i:04d}", v[0 if i % 2 else i % 200].tolist(), "EU", "v") for i in range(2000)]
    cat = spark.createDataFrame(prods, "product_id string, embedding array<float>, region string, vendor string")
    q = spark.createDataFrame([(1, v[0].tolist()), (2, [0.0] * 16), (3, [1.0] * 3), (4, None)], "query_id long, embedding array<double>")
    index = ann.AnnIndex.build(cat, q, cells=8, block_rows=64)
    assert index.packs.agg(F.max("n_rows")).first()[0] <= 64
    assert [(r["query_id"], r["product_id"]) for r in index.search(q, 5).orderBy("rank").collect()] == [
        (1, p) for p, x, *_ in prods if np.array_equal(np.float32(x), v[0])][:5]


def test_codes_take_a_byte_a_part_and_approximate_inner_products():
    from tessera.operators import ann
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2000, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.Quantizer.fit(x, 12)
    cell = ann.assigned(x, model.centres)
    codes = model.codes(x, cell)
    assert codes.shape == (2000, 8) and codes.dtype == np.uint8
    at = np.flatnonzero(cell == 3)
    assert np.abs(model.near(x[:50], 3, codes[at]) - x[:50] @ x[at].T).mean() < 0.06
    again = ann.Quantizer.of_row(dict(zip(("dim", "centres", "books", "probes", "recall"), model.row())))
    assert np.array_equal(again.near(x[:5], 3, codes[at]), model.near(x[:5], 3, codes[at]))
