"""Groups of packs and parts of lookups: results as from one task, and what moves does not grow with their pairs."""
import numpy as np
from pyspark.sql import functions as F
from test_match import _clusters, _data, brute, collect

from tessera.operators import ann
from tessera.operators import match as M
from tessera.operators import packs as PK

PLAIN = {"use_filters": False, "degrade": False, "filters": ()}


def test_candidates_grow_with_lookups_not_with_pairs(spark):
    P, Q, prods, qs, cat, q = _data(spark)
    search = M.Search(q, cat, M.MatchConfig(block_rows=10, **PLAIN))
    assert search.catalog.packs.count() >= 30
    assert search.cands.where("query_id IS NOT NULL").count() == 40 * 5
    search.close()


def test_many_groups_and_parts_give_the_same_rows(spark, monkeypatch):
    P, Q, prods, qs, cat, q = _clusters(spark)
    by_price = {"cap": 3, "degrade": False, "min_score": 0.2, "order_extra": True, "filters": ("region",)}
    cat = cat.withColumn("price", F.xxhash64("product_id") % 50)
    whole = [sorted(map(tuple, M.top_k(q, cat, M.MatchConfig(**by_price), "price").drop("sim").collect())),
             sorted(map(tuple, ann.AnnIndex.build(cat, q, cells=20, probes=20).search(q, 5).drop("sim").collect()))]
    monkeypatch.setattr(PK, "GROUP_BYTES", 60_000)
    monkeypatch.setattr(PK, "PART_LOOKUPS", 25)
    monkeypatch.setattr(PK, "LOOKUP_ROWS", 20)
    monkeypatch.setattr(M, "SCORE_VECTORS", 16)
    assert min(PK.grid_shape(spark, 200_000, 60)) > 1
    small = {"block_rows": 64}
    assert collect(M.top_k(q, cat, M.MatchConfig(**small))) == brute(P, Q, prods, qs)
    assert collect(M.top_k(q, cat, M.MatchConfig(prune=True, cells=30, **small))) == brute(P, Q, prods, qs)
    assert [sorted(map(tuple, M.top_k(q, cat, M.MatchConfig(**by_price, **small), "price").drop("sim").collect())),
            sorted(map(tuple, ann.AnnIndex.build(cat, q, cells=20, probes=20, block_rows=64).search(q, 5).drop("sim").collect()))] == whole


def test_packs_hold_floats_as_given_and_doubles_as_unit_vectors(spark):
    *_, cat, q = _data(spark)
    sizes = []
    for rows in (cat, cat.withColumn("embedding", F.col("embedding").cast("array<double>"))):
        packed = M.PackedCatalog(rows, M.MatchConfig())
        sizes.append(packed.packs.agg(F.sum(F.length("vectors"))).first()[0])
        packed.unpersist()
    assert sizes == [299 * 16 * 4, 299 * 16 * 8]


def test_large_rows_reach_python_in_small_batches(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(PK, "BATCH_BYTES", 100_000)
    rows = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 50_000).cast("binary").alias("b"))

    def counted(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows for b in batches])], ["n"])

    with PK.small_batches(spark):
        sizes = [r["n"] for r in rows.mapInArrow(counted, "n long").collect()]
    assert max(sizes) <= 3 and sum(sizes) == 40
    assert "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll


def test_tying_rows_are_ordered_some_lookups_at_a_time(spark, monkeypatch):
    P, Q, prods, qs, cat, q = _data(spark)
    same = cat.withColumn("embedding", F.expr("transform(embedding, x -> float(1))"))
    whole = collect(M.top_k(q, same))
    monkeypatch.setattr(M, "TIED_ROWS", 7)
    assert collect(M.top_k(q, same)) == whole
    assert whole[0][0] == [f"p{i:04d}" for i in range(5)]


def test_a_search_leaves_no_packs_lookups_or_index(spark):
    from tessera.session import scratch_path
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(scratch_path(spark, ""))
    left = lambda: {str(f.getPath().getName()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    *_, cat, q = _data(spark)
    before = left()
    assert M.top_k(q, cat).count() and ann.ann_top_k(q, cat).count()
    assert {name.rsplit("-", 1)[0] for name in left() - before if not name.startswith(".")} == {"candidates", "ann-found"}


def test_each_group_and_part_is_a_task_of_its_own(spark):
    from pyspark.sql.types import StructType
    packs = spark.range(200).select(F.col("id").alias("pblock"), F.lit("p").alias("b"))
    asked = spark.range(300).select(F.array("id").alias("q_ids"))

    def told(batches):
        import pyarrow as pa
        met = [len({k for k, _ in kinds if k in (0, 1)}) for kinds in PK.cells(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([len(met)]), pa.array([sum(met)])], ["cells", "kinds"])

    out = [tuple(r) for r in PK.grid(packs, asked, (7, 3), told, StructType().add("cells", "long").add("kinds", "long")).collect()]
    assert out == [(1, 2)] * 21


def test_parts_grow_with_the_bytes_of_the_lookups(spark):
    assert PK.grid_shape(spark, 100 * PK.GROUP_BYTES, 1 << 16, 8 * PK.PART_BYTES) == (100, 8)
    assert PK.grid_shape(spark, 100 * PK.GROUP_BYTES, 1 << 16, PK.PART_BYTES // 2) == (100, 1)


def test_tasks_of_a_search_do_without_pandas(spark):
    def told(batches):
        import pyarrow as pa
        next(PK.cells([]), None)
        yield pa.RecordBatch.from_arrays([pa.array([hasattr(PK, "pd")])], ["pandas"])

    assert not spark.range(1).mapInArrow(told, "pandas boolean").first()[0]


def test_a_pack_grows_with_its_rows_not_with_combinations_of_filters(spark):
    from pyspark.sql import types as T
    rows = spark.range(600).select(
        F.format_string("p%04d", "id").alias("product_id"), F.array(*[(F.sin(F.col("id") * (i + 1)) + 0.1).cast("float") for i in range(4)]).alias("embedding"),
        *[F.concat(F.lit(f"{n}-"), (F.col("id") * m % 97).cast("string")).alias(n) for n, m in (("a", 1), ("b", 5), ("c", 11), ("d", 23))])
    packed = M.PackedCatalog(rows, M.MatchConfig(filters=("a", "b", "c", "d")))
    lists = [f.name for f in packed.packs.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name != "values"]
    most = packed.packs.select(F.max(F.greatest(*[F.size(n) for n in lists], F.lit(0)) / F.col("n_rows"))).first()[0]
    packed.unpersist()
    assert most <= 1


def test_of_equal_vectors_and_filters_the_first_rows_stay_nulls_too(spark):
    import random
    random.seed(3)
    data = [(f"p{i:03d}", [1.0, float(i % 3)], random.choice(["r", None, "s"]), random.choice(["v", None]), random.choice([1.0, 2.0, None])) for i in range(300)]
    random.shuffle(data)
    rows = spark.createDataFrame(data, "product_id string, embedding array<float>, region string, vendor string, price double")
    for by_price in (False, True):
        cfg = M.MatchConfig(cap=3, fallback_k=3, order_extra=by_price)
        packed = M.PackedCatalog(rows, cfg, "price")
        got = []
        for p in packed.packs.collect():
            v = PK.matrix(p["vectors"], p["n_vectors"], p["dim"])
            owner = np.frombuffer(p["owner"], np.int32)
            got += [(tuple(v[o].tolist()), a, b, i) for o, i, a, b in zip(owner, p["ids"], *p["values"])]
        packed.unpersist()
        want = {}
        for i, e, a, b, x in sorted(data, key=lambda r: (r[4] if by_price and r[4] is not None else 0, r[0])):
            if not by_price or x is not None:
                want.setdefault((tuple(e), a, b), []).append(i)
        assert sorted(map(repr, got)) == sorted(repr((*k, i)) for k, v in want.items() for i in v[:3])


def test_long_vectors_make_packs_of_fewer_rows(spark):
    long = "transform(sequence(1, 4096), x -> float(sin(x * (id + 1))))"
    rows = spark.range(40).coalesce(1).select(F.format_string("p%02d", "id").alias("product_id"), F.expr(long).alias("embedding"),
                                              F.lit("r").alias("region"), F.lit("v").alias("vendor"))
    packed = M.PackedCatalog(rows, M.MatchConfig())
    n, most = packed.packs.agg(F.sum("n_vectors"), F.max(F.length("vectors"))).first()
    packed.unpersist()
    assert n == 40 and most <= 256 << 10
    asked = rows.select(F.expr("cast(substr(product_id, 2) as long)").alias("query_id"), "embedding", F.lit("").alias("w_region"))
    asked = asked.withColumns({"q_limit": F.lit(5), "dim": F.size("embedding"), "embedding": F.col("embedding").cast("array<double>")})
    n, most = PK.pack_lookups(asked, ("region",), PK.LOOKUP_ROWS).agg(F.sum(F.size("q_ids")), F.max(F.length("q_mat"))).first()
    assert n == 40 and most <= 256 << 10


def test_a_group_holds_its_vectors_once():
    import tracemalloc
    rng = np.random.default_rng(5)
    given = rng.random((40, 400, 64), np.float32)

    def pack(i):
        return {"dim": 64, "n_vectors": 400, "vectors": given[i].tobytes(), "owner": np.arange(400, dtype=np.int32).tobytes(), "ids": [f"p{i:02d}{j:03d}" for j in range(400)],
                "extra": [None] * 400, "values": [["r"] * 400], "centroid": b"", "least": -1.0}

    M.Group([pack(0)], M.MatchConfig())
    tracemalloc.start()
    group = M.Group((pack(i) for i in range(40)), M.MatchConfig())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (group.held[64] == given.reshape(-1, 64)).all()
    assert peak < 1.6 * given.nbytes
