"""Packs of catalog vectors, and the lookups that each pack is asked.

A pack holds up to ``block_rows`` catalog rows that lie next to each other by filter values and vector
cell: the distinct vectors as one matrix (float elements as they are given, doubles as unit vectors), and behind each vector the rows that share it. Of rows with
equal vector and equal filter values only the first ``keep`` in ranking order can be in any result, so no more are kept.

Lookups are packed by the filters they set. A task holds a part of the lookups, of bounded size, and a group of packs streams past
them (``grid``); nothing is copied to disk for the pairs of the two. The filter values found in the packs tell which
rows a lookup has to ask; no other is scored for it. With a centroid and the least
cosine to it, a pack bounds the similarity that a lookup can find in it: the angle between the two is at least the angle to the
centroid less the pack's widest angle.
"""
from __future__ import annotations

import itertools
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 4096  # vectors that the cells of an index are fitted on
GROUP_BYTES = 256 << 20  # of packs that stream through a task
HELD_BYTES = 8 << 20  # of vectors and ids of packs that a task looks at together
BATCH_BYTES = 2 << 20  # of packs and lookups that pass from the JVM to Python at once, about
PART_LOOKUPS = 1 << 16  # lookups that a task holds, about
PART_BYTES = 12 << 20  # of lookups that a task holds, about
LOOKUP_ROWS = 1024  # lookups of a pack, at most
ROW_BYTES = 192 << 10  # of vectors, in doubles, that a pack holds: the JVM copies rows, and arrays of 512 KB or more cost it whole regions
SCAN_ROWS = 16  # packs that a scan decodes at once
# of stored packs: few large rows, else looked at every 100 rows, become one page, and are compressed and decompressed whole
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size": str(256 << 10), "parquet.enable.dictionary#vectors": "false",
         "parquet.enable.dictionary#owner": "false"}
MOST_TASKS = 4096  # of a grid; with more, groups are larger
BUCKET_ROWS = 1 << 14  # catalog rows whose equal vectors lie near each other, about: few enough for a task to look at together

PACK_FIELDS = ("pblock long, dim int, n_given int, n_rows int, n_vectors int, vectors binary, ids array<string>, owner binary, "
               "values array<array<string>>, extra array<double>, centroid binary, least double")
LOOKUP_PACK_FIELDS = "dim int, mask int, wanted array<array<string>>, q_ids array<long>, q_limits array<int>, q_mat binary"


def usable(v) -> F.Column:
    """Vectors with a direction: not empty, every element there and finite, one of them not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def unit(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows have one) of an Arrow list column of equal lengths."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    ok = (norm > 0) & np.isfinite(norm)
    return x / np.where(ok, norm, 1.0)[:, None], ok


def vector_column(rows: DataFrame) -> F.Column:
    """The ``embedding`` of ``rows``: floats as they are, half as wide as doubles; other elements as doubles."""
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col("embedding") if single else F.col("embedding").cast("array<double>")


def matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """The ``n`` vectors of a pack as they are stored: floats as given, or doubles of length 1."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * dim else np.float64).reshape(-1, dim)


def units(stored: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of a ``matrix``, in doubles; the same as ``unit`` gives."""
    if stored.dtype == np.float64:
        return stored
    x = stored.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


@contextmanager
def small_batches(spark: SparkSession, stored_packs: bool = False):
    """Batches of large rows, as those of a ``grid``, are cut by bytes while this is open, not by 10,000 rows.

    ``stored_packs``: scans decode SCAN_ROWS rows at once, for they read packs, of which a whole file has fewer than Spark's 4096.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES} | ({"spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS} if stored_packs else {})
    before = {name: spark.conf.getAll.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pack_rows(dim: int, most: int, least: int) -> tuple[int, int]:
    """(most, least) rows of a pack of vectors of length ``dim``: fewer than asked if those would be more than ROW_BYTES."""
    most = min(most, max(1, ROW_BYTES // (8 * dim)))
    return most, min(least, max(1, most // 2))


def runs(batches, lead: list[str], block_rows: int, cut_rows: int):
    """Tables of consecutive rows: at most ``block_rows``, cut where the length lead[0] changes and, from ``cut_rows`` rows on, where any column of
    ``lead`` does; of long vectors fewer (``pack_rows``)."""
    held, n, last = [], 0, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in lead))) if batch.num_rows else []
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(starts, starts[1:]):
            if n and (keys[a][0] != last[0] or (keys[a] != last and n >= pack_rows(last[0], block_rows, cut_rows)[1])):
                yield pa.Table.from_batches(held)
                held, n = [], 0
            last = keys[a]
            most, _ = pack_rows(last[0], block_rows, cut_rows)
            while a < b:
                take = min(b - a, most - n)
                held.append(batch.slice(a, take))
                a, n = a + take, n + take
                if n == most:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def numbered():
    """Numbers of the packs of this task, unique over all tasks."""
    from pyspark import TaskContext
    context = TaskContext.get()
    return itertools.count((context.partitionId() if context else 0) << 24)


# ---- cells
def fit_cells(rows: DataFrame, cells: int, seed: int = 7) -> dict[int, np.ndarray]:
    """Centroids of ``cells`` cells by length of vector: spherical k-means on a bounded sample (smallest id hashes)."""
    drawn = rows.orderBy(F.xxhash64("product_id")).limit(SAMPLE_ROWS).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
    out, rng = {}, np.random.default_rng(seed)
    for dim, vectors in by_dim.items():
        x = np.array(vectors, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # farthest-first seeds: the next is the vector least like all before
        centre, best = [x[int(rng.integers(len(x)))]], np.full(len(x), -2.0)
        for _ in range(min(cells, len(x)) - 1):
            best = np.maximum(best, x @ centre[-1])
            centre.append(x[int(best.argmin())])
        c = np.array(centre)
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
        out[dim] = c
    return out


def with_cell(rows: DataFrame, centres: dict[int, np.ndarray] | None) -> DataFrame:
    """``rows`` (with ``embedding`` and ``dim``) and the cell of each vector; 0 without centres."""
    if not centres:
        return rows.withColumn("cell", F.lit(0))
    at_dim, at_vec = rows.columns.index("dim"), rows.columns.index("embedding")

    def run(batches):
        for batch in batches:
            dims, cell = batch.column(at_dim).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in centres:
                    x, _ = unit(batch.column(at_vec).take(pa.array(at)), dim)
                    cell[at] = (x @ centres[dim].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, rows.withColumn("cell", F.lit(0)).schema)


# ---- packs of the catalog
def buckets(n_rows: int, cells: int = 0) -> int:
    """Buckets over which the vectors (of each cell) are dealt by their hash."""
    return max(1, -(-n_rows // (BUCKET_ROWS * max(1, cells))))


def pack_catalog(rows: DataFrame, filters: tuple, block_rows: int, keep: int, by_extra: bool, n_buckets: int = 1) -> DataFrame:
    """Packs of ``rows`` (product_id, embedding, filters, extra, dim, cell), clustered by bucket of the vector, first filter and cell."""
    names = [f"v_{f}" for f in filters]
    rows = rows.select("product_id", "embedding", "extra", "dim", "cell", *[F.col(f).cast("string").alias(n) for f, n in zip(filters, names)])
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("embedding"), F.lit(n_buckets)))
    lead = ["dim", *names[:1], "cell"]
    rows = (rows.hint("rebalance", "cell", "_bucket")
            .sortWithinPartitions("dim", "_bucket", *lead[1:], F.xxhash64("embedding"), *names[1:], "product_id").drop("_bucket"))

    def make(table: pa.Table, pblock: int) -> dict | None:
        dim = table.column("dim")[0].as_py()
        x, ok = unit(table.column("embedding"), dim)
        if not ok.any():
            return None
        given = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[ok]
        x, table = np.ascontiguousarray(x[ok]), table.filter(pa.array(ok))
        _, first, owner = np.unique(x.view(np.dtype((np.void, x.strides[0]))).ravel(), return_index=True, return_inverse=True)
        owner, extra = owner.ravel(), table.column("extra").to_numpy()
        place = pc.rank(table.column("product_id"), tiebreaker="dense").to_numpy()
        # rows of one vector by (extra,) id, of those with equal filter values the first ``keep``
        rows = np.flatnonzero(~np.isnan(extra)) if by_extra else np.arange(len(owner))
        rows = rows[np.lexsort((place[rows], *([extra[rows]] if by_extra else []), owner[rows]))]
        codes = [pc.fill_null(table.column(n).combine_chunks().dictionary_encode().indices, -1).to_numpy()[rows] for n in names]
        alike = np.lexsort((*codes, owner[rows]))  # stable: rows alike stay in order
        key = np.stack([owner[rows], *codes])[:, alike]
        begins = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))[:len(rows)]
        nth = np.empty(len(rows), np.int64)
        nth[alike] = np.arange(len(rows)) - np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))
        rows = rows[nth < keep]
        if not len(rows):
            return None
        kept, owner = np.unique(owner[rows], return_inverse=True)
        v = x[first[kept]]
        held = given[first[kept]] if given.dtype == np.float32 else v
        middle = v.mean(axis=0)
        norm = np.linalg.norm(middle)
        centre = middle / norm if norm > 0 else middle
        table = table.take(pa.array(rows))
        values = [table.column(n).to_pylist() for n in names]
        return {"pblock": pblock, "dim": dim, "n_given": int(ok.sum()), "n_rows": len(rows), "n_vectors": len(v), "vectors": held.tobytes(),
                "ids": table.column("product_id").to_pylist(),
                "owner": owner.astype(np.int32).tobytes(), "values": values, "extra": extra[rows],
                "centroid": centre.tobytes(), "least": float((v @ centre).min()) if norm > 0 else -1.0}

    schema = pa.schema([("pblock", pa.int64()), ("dim", pa.int32()), ("n_given", pa.int32()), ("n_rows", pa.int32()), ("n_vectors", pa.int32()), ("vectors", pa.binary()),
                        ("ids", pa.list_(pa.string())), ("owner", pa.binary()), ("values", pa.list_(pa.list_(pa.string()))),
                        ("extra", pa.list_(pa.float64())), ("centroid", pa.binary()), ("least", pa.float64())])

    def run(batches):
        numbers = numbered()
        for table in runs(batches, lead, block_rows, block_rows // 8):
            pack = make(table, next(numbers))
            if pack:
                yield pa.RecordBatch.from_pylist([pack], schema)

    return rows.mapInArrow(run, PACK_FIELDS)


# ---- lookups
def pack_lookups(lookups: DataFrame, filters: tuple, block_rows: int) -> DataFrame:
    """Packs of lookups that set the same filters, with the values that each wants.

    lookups: query_id, embedding, q_limit, dim, w_<filter> (empty: not set).
    """
    names = [f"w_{f}" for f in filters]
    mask = F.lit(0)
    for i, n in enumerate(names):
        mask = mask + F.when(F.col(n) != "", F.lit(1 << i)).otherwise(F.lit(0))
    rows = lookups.where(F.col("query_id").isNotNull()).select("query_id", "embedding", "q_limit", "dim", mask.alias("mask"), *names)
    rows = rows.hint("rebalance", "query_id").sortWithinPartitions("dim", "mask", "query_id")
    lead = ["dim", "mask"]

    def run(batches):
        for table in runs(batches, lead, block_rows, 1):
            dim = table.column("dim")[0].as_py()
            x, ok = unit(table.column("embedding"), dim)
            t = table.filter(pa.array(ok))
            if t.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([t.column("mask")[0].as_py()], pa.int32()),
                     pa.array([[t.column(n).to_pylist() for n in names]], pa.list_(pa.list_(pa.string()))),
                     pa.array([t.column("query_id").to_pylist()], pa.list_(pa.int64())), pa.array([t.column("q_limit").to_pylist()], pa.list_(pa.int32())),
                     pa.array([x[ok].tobytes()], pa.binary())],
                    ["dim", "mask", "wanted", "q_ids", "q_limits", "q_mat"])

    return rows.mapInArrow(run, LOOKUP_PACK_FIELDS)


# ---- packs and lookups together
def grid_shape(spark: SparkSession, held_bytes: int, lookups: int, asked_bytes: int = 0) -> tuple[int, int]:
    """(groups of packs, parts of the lookups): a part is what a task holds, a group what streams past it."""
    groups = max(1, -(-held_bytes // GROUP_BYTES))
    wanted = max(-(-spark.sparkContext.defaultParallelism // groups), -(-lookups // PART_LOOKUPS), -(-asked_bytes // PART_BYTES))
    parts = max(1, min(wanted, -(-lookups // LOOKUP_ROWS)))
    return min(groups, max(1, MOST_TASKS // parts)), parts


def grid(packs: DataFrame, lookup_packs: DataFrame, shape: tuple[int, int], work, fields: str) -> DataFrame:
    """Every group of packs with every part of the lookups in one task: ``work(batches)`` as in mapInArrow, over ``cells(batches)``.

    A task reads its part of the lookups, then the packs of its group one after another. Groups are read again from
    where the packs are stored for each part, and parts from one shuffle of the lookups, so what is written does not grow with the pairs
    of the two. Of the pairs of rows that the join stands for, only those with a first pack or first lookups leave it. Run it with
    ``small_batches``: else a batch is as large as all that a task reads.
    """
    groups, parts = shape
    if packs.rdd.getNumPartitions() >= groups:
        held = packs.coalesce(groups)  # stored packs: no shuffle
    else:
        held = packs.repartitionById(groups, F.pmod(F.xxhash64("pblock"), F.lit(groups)).cast("int"))
    asked = lookup_packs.repartitionById(parts, F.pmod(F.xxhash64("q_ids"), F.lit(parts)).cast("int"))
    place = F.expr("monotonically_increasing_id() & 8589934591")  # among the rows of a partition
    held = held.select(F.struct(*packs.columns).alias("_pack"), place.alias("_nth_pack"))
    asked = asked.select(F.struct(*lookup_packs.columns).alias("_lookups"), place.alias("_nth_lookups"))
    # a cartesian product takes the first pack with all lookups, then each further pack with all lookups
    both = held.hint("shuffle_replicate_nl").join(asked, (F.col("_nth_pack") == 0) | (F.col("_nth_lookups") == 0))
    both = both.select(F.when(F.col("_nth_pack") == 0, F.col("_lookups")).alias("_lookups"), F.when(F.col("_nth_lookups") == 0, F.col("_pack")).alias("_pack"))
    return both.mapInArrow(work, fields)


def cells(batches):
    """(0, iterator over the lookups) and (1, iterator over the packs) of a task of a ``grid``, as dicts of Arrow scalars' values.

    The first pack comes beside lookups; it is kept until these are through.
    """
    def rows():
        kept = None
        for batch in batches:
            of = {name: batch.column(name) for name in ("_lookups", "_pack")}
            for i in range(batch.num_rows):
                asked, pack = (of[name].slice(i, 1) for name in ("_lookups", "_pack"))
                if asked.null_count == 0:
                    yield 0, fields_of(asked)
                    kept = pack if pack.null_count == 0 else kept
                    continue
                if kept is not None:
                    yield 1, fields_of(kept)
                    kept = None
                yield 1, fields_of(pack)
        if kept is not None:
            yield 1, fields_of(kept)

    found = rows()
    first = next(found, None)
    if first is not None:
        yield ((kind, (r for _, r in mine)) for kind, mine in itertools.groupby(itertools.chain([first], found), key=lambda r: r[0]))


def fields_of(one: pa.StructArray) -> dict:
    """The fields of the only row: lists as Arrow arrays, the rest as Python values."""
    out = {}
    for f in one.type:
        x = pc.struct_field(one, f.name)
        out[f.name] = x[0].values if pa.types.is_list(f.type) and x[0].is_valid else x[0].as_py()
    return out


def held_together(packs, size: int | None = None):
    """Lists of consecutive packs, of about HELD_BYTES of vectors and ids each."""
    size, some, n = size or HELD_BYTES, [], 0
    for p in packs:
        some.append(p)
        n += len(p["vectors"]) + (p["ids"].nbytes if isinstance(p["ids"], pa.Array) else 0)
        if n >= size:
            full, some, n = some, [], 0
            yield full
            full.clear()  # what the caller made of them stays, they do not
    if some:
        yield some


def upper_bounds(q: np.ndarray, packs: list[dict]) -> np.ndarray:
    """Largest cosine that each lookup can have with a vector of each pack."""
    dim = q.shape[1]
    centre = np.frombuffer(b"".join(p["centroid"] for p in packs)).reshape(-1, dim)
    wide = np.arccos(np.clip([p["least"] for p in packs], -1, 1))
    gap = np.arccos(np.clip(q @ centre.T, -1, 1)) - wide
    return np.where(~centre.any(axis=1), 1.0, np.cos(np.maximum(gap, 0))) + 1e-9
