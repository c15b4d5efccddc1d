"""Centroid clustering and nearest neighbours against numpy, and on awkward rows."""
import hashlib

import numpy as np
import pytest

from tessera.llm import dimension_scan, subvectors

SF = "/root/testdata/sf0.1"
FIELDS = "vec_id bigint, embedding array<float>, cluster string, list int, ids string, distance int"


def unit(rng, n, d):
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, ids, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, "y", 2) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, FIELDS)


# ---- centroid clustering
def lloyd(ids, vectors, k=8, rounds=10):
    x = np.floor(np.asarray(vectors, float) * 1024).astype(int)
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), list(vectors[i])))
    c = x[order[:k]].copy()
    for step in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        for j in range(len(c)):
            if step < rounds and (a == j).any():
                c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    return a, d[np.arange(len(x)), a], c


def test_dictionaries_lose_nothing_and_join_blocks_of_copies():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (400, 12))
    x[100:] = x[rng.integers(0, 3, 300)]
    x[:100] = x[:1]
    blocks = subvectors.dictionaries(x)
    assert np.array_equal(np.hstack([v[c] for v, c in blocks]), x)
    assert max(v.shape[1] for v, _ in blocks) > 1
    c = rng.integers(-300, 300, (5, 12))
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    cluster, distance = subvectors.nearest(blocks, c)
    assert np.array_equal(cluster, d.argmin(axis=1)) and np.array_equal(distance, d.min(axis=1))


def test_clusters_equal_exact_lloyd_with_copies_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(subvectors, "PACK", 50)
    rng = np.random.default_rng(2)
    vectors = list(unit(rng, 150, 64)) + [unit(rng, 1, 64)[0]] * 80  # a third of the rows are copies
    ids = [*range(225), 7, 7, None, None, 226]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    df = frame(spark, ids + [900 + i for i in range(len(odd))], vectors + odd).repartition(5)
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                 for r in subvectors.clustered(df).collect())
    a, d, c = lloyd(ids, vectors)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    assert got == sorted((str(ids[i]), a[i], d[i], d[a == a[i]].sum(), d.sum(), sha[a[i]]) for i in range(len(ids)))


def test_fewer_vectors_than_clusters_and_none(spark):
    v = unit(np.random.default_rng(3), 3, 64)
    rows = subvectors.clustered(frame(spark, [1, 2, 3], v)).collect()
    assert sorted(r["cluster"] for r in rows) == [0, 1, 2] and {r["distance"] for r in rows} == {0}
    none = subvectors.clustered(frame(spark, [], []))
    assert none.count() == 0 and none.columns == subvectors.clustered(frame(spark, [1], v[:1])).columns


def test_integers_too_large_for_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        subvectors.clustered(frame(spark, [1], [[1e6] * 64])).collect()


# ---- nearest neighbours
def brute(rows, k, every):
    """(query_id, rank) to (vec_id, score): the exact answer for rows (id, vector) as used."""
    rows = list(dict.fromkeys((i, tuple(float(x) for x in v)) for i, v in rows))
    out = {}
    for q in {i for i, _ in rows if i % every == 0}:
        v = min(x for i, x in rows if i == q)
        scores: dict[int, float] = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                s = 0.0
                for a, b in zip(x, v):
                    s += a * b
                scores[i] = max(s, scores.get(i, -np.inf))
        for n, (i, s) in enumerate(sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k]):
            out[q, n + 1] = (i, s)
    return out


def found(df, **how):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in dimension_scan.nearest_neighbours(df, **how).collect()}


def test_beta_quantiles():
    rng = np.random.default_rng(5)
    for a, b in ((8, 24.5), (16, 16.5), (24, 0.5)):
        assert abs(dimension_scan.beta_quantile(0.99, a, b) - np.quantile(rng.beta(a, b, 400_000), 0.99)) < 0.005


def test_few_candidates_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(6)
    short = [(i, v) for i, v in enumerate(3 * unit(rng, 30, 5))]
    copies = [(100 + i, short[3][1]) for i in range(60)]
    rows = short + copies + [(7, short[9][1]), (7, short[9][1]), (20, short[11][1]), (200, [1.0, 2.0]), (201, [2.0, 1.0]), (220, [1.0])]
    odd = [(300, None), (320, []), (340, [0.0] * 5), (360, [None] + [1.0] * 4), (380, [float("nan")] * 5), (400, [float("inf")] * 5), (None, [1.0] * 5)]
    df = frame(spark, [i for i, _ in rows + odd], [v for _, v in rows + odd]).repartition(3)
    got = found(df, k=6, every=20)
    assert got == brute(rows, 6, 20)
    assert found(df, k=500, every=20) == brute(rows, 500, 20)
    assert found(frame(spark, [], [])) == {}


def test_recall_scores_and_order(spark, monkeypatch):
    """Several lists, packs and early ends: recall of at least 0.9, and every score exact."""
    monkeypatch.setattr(dimension_scan, "SAMPLE", 400)
    monkeypatch.setattr(dimension_scan, "PACK", 150)
    monkeypatch.setattr(dimension_scan, "QUERIES", 7)
    rng = np.random.default_rng(7)
    centres = unit(rng, 12, 64)
    v = centres[rng.integers(0, 12, 3000)] + 0.7 * unit(rng, 3000, 64)
    v[1000:2000] = v[5]  # a third of the rows are copies
    rows = list(enumerate(v.astype(np.float32)))
    got, exact = found(frame(spark, [i for i, _ in rows], [x for _, x in rows])), brute(rows, 20, 20)
    assert set(got) == set(exact)
    score = {}
    for (q, _), (i, s) in got.items():
        score.setdefault(q, {})[i] = s
    hit = [sum(exact[q, r][0] in score[q] for r in range(1, 21)) / 20 for q in score]
    assert np.mean(hit) >= 0.95
    for (q, r), (i, s) in got.items():
        expected = 0.0
        for a, b in zip(v[q].astype(float).tolist(), v[i].astype(float).tolist()):
            expected += b * a
        assert s == expected and (r == 1 or (got[q, r - 1][1], -got[q, r - 1][0]) > (s, -i))


def test_most_candidates_are_given_up_early():
    rng = np.random.default_rng(8)
    x = unit(rng, 4000, 64).astype(float)
    model = dimension_scan.Model(x[:2000], 4000, 1.0, 20)
    y, q = model.turned(x), model.turned_query(x[:40])
    bounds = model.bounds(q, model.probed(q))
    last = len(model.cuts) - 1
    model.shares[last - 1:] = [model.shares[last - 1]] * 2  # count what is left before the last block
    blocks = [np.ascontiguousarray(y[:, a:b]) for a, b in model.cuts]
    blocks[last] = np.zeros_like(blocks[last])
    q[:, model.cuts[last][0]:] = 0
    model.k = len(x)
    left = sum(len(rows) for _, rows in model.scan(blocks, q, bounds))
    assert left < 0.5 * len(x) * len(q)


def test_recall_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = found(spark.read.parquet(f"{SF}/embeddings.parquet"))
    asked = np.flatnonzero(ids % 20 == 0)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = {(ids[q], ids[j]) for q, row in zip(asked, np.argsort(-s, axis=1)[:, :20]) for j in row}
    assert len(got) == len(best) and len(best & {(q, i) for (q, _), (i, _) in got.items()}) >= 0.9 * len(best)
