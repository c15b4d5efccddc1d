"""Approximate nearest neighbours: inverted lists whose scan gives candidates up after part of their dimensions.

Largest inner products are nearest neighbours once every vector gets one more component,
sqrt(largest norm^2 - norm^2), and queries a zero: |q - x|^2 = |q|^2 + largest norm^2 - 2 q.x. The longer vectors are turned by
a random orthogonal matrix and stored, list by list, in blocks of columns. Under such a rotation the share of a squared distance
that lies in the first d of D dimensions follows the Beta(d/2, (D-d)/2) distribution. So after each block of columns a
hypothesis test compares the partial distance with what a candidate inside the query's bound would show, but for a chance of ERROR: who
exceeds it is given up. The bound is the distance of the K-th nearest found so far, at first one that 2 K sampled vectors keep.

Lists come from k-means on a bounded sample (SAMPLE rows, the smallest hashes of the ids); every vector is indexed. The number of
lists probed is the least at which the sample's own nearest neighbours are found in a share of COVER, so it follows the data.
Copies are one vector in the index, with its K smallest ids, which is all that a result can hold of them; queries
that are copies are searched once. Lists and queries move in packs, so a list may hold any share of the rows: its packs are
joined by a shuffle on the list, which the planner may split.

Scores are worked out on the original vectors, in double precision, component after component.

Defined results: rows whose vector is null, empty or zero or holds null or non-finite components take no part, nor do rows without
an id. Vectors meet only vectors of their own length. Repeated rows count once. Rows that share an id but not the vector
are candidates each, never of their own id; the query is then the smallest vector. A query with fewer candidates than ``k`` gets all.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

K = 20
EVERY = 20  # ids divisible by this are queries
SAMPLE = 8_192  # vectors that lists, probes and first bounds are worked out from
LEAST = 32  # sampled vectors a list, at least
COVER = 0.98
ERROR = 0.0005  # of one test
COLUMNS = 16  # of a block
PACK = 4_096  # vectors of a pack of the index
QUERIES = 256  # of a pack of queries
SEED = 13

INDEX = "list int, ids array<array<bigint>>, vectors binary, blocks array<binary>"
ASKED = "list int, ids array<bigint>, vectors binary, bounds binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, each once."""
    v = F.col("embedding")
    rows = (embeddings.where(F.col("vec_id").isNotNull() & (F.size(v) > 0))
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).distinct()


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): distinct vectors with their ``k`` + 1 smallest ids in order."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    return (rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
            .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def beta_quantile(p: float, a: float, b: float) -> float:
    """Quantile of the Beta distribution, by summing its density over a fine grid."""
    x = (np.arange(200_000) + 0.5) / 200_000
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    total = np.cumsum(np.exp(log - log.max()))
    return float(x[min(len(x) - 1, np.searchsorted(total, p * total[-1]))])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


class Model:
    """Rotation, lists, probes and tests for vectors of one length, worked out from a sample."""

    def __init__(self, sample: np.ndarray, n: int, norm: float, k: int):
        rng = np.random.default_rng(SEED)
        self.norm, self.k = norm, k + 1  # a query's own row is found too
        size = sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        self.cuts = [(a, min(size, a + COLUMNS)) for a in range(0, size, COLUMNS)]
        if len(self.cuts) > 1 and size - self.cuts[-1][0] < COLUMNS // 2:
            self.cuts[-2:] = [(self.cuts[-2][0], size)]
        self.shares = [beta_quantile(1 - ERROR, b / 2, (size - b) / 2) for _, b in self.cuts[:-1]] + [1.0]
        self.sample = self.turned(sample)
        lists = max(1, min(math.ceil(math.sqrt(n) / 4), len(sample) // LEAST))
        self.centroids = self.sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(8):
            near = self.assigned(self.sample)
            count = np.bincount(near, minlength=lists)
            total = np.zeros_like(self.centroids)
            np.add.at(total, near, self.sample)
            self.centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], self.centroids)
        self.near = self.assigned(self.sample)
        self.counts = np.bincount(self.near, minlength=lists)
        self.probes = self.needed(sample)

    def turned(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.turn

    def turned_query(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))]) @ self.turn

    def assigned(self, x: np.ndarray) -> np.ndarray:
        return squared(x, self.centroids).argmin(axis=1)

    def needed(self, sample: np.ndarray) -> int:
        """Lists to probe so that a share of COVER of the sample's nearest neighbours lies in them."""
        asked = self.turned_query(sample[:512])
        d = squared(asked, self.sample)
        best = np.argsort(d, axis=1, kind="stable")[:, :self.k]
        order = squared(asked, self.centroids).argsort(axis=1).argsort(axis=1)
        rank = np.take_along_axis(order, self.near[best], axis=1)
        found = [(rank < p).mean() for p in range(1, len(self.centroids) + 1)]
        return 1 + int(np.argmax(np.array(found) >= COVER)) if found[-1] >= COVER else len(found)

    def probed(self, asked: np.ndarray) -> list[np.ndarray]:
        """Lists of each query: the needed ones, and more until the sample's part of them could fill a result."""
        order = squared(asked, self.centroids).argsort(axis=1)
        enough = (np.cumsum(self.counts[order], axis=1) < self.k).sum(axis=1) + 1
        return [row[:max(self.probes, int(e))] for row, e in zip(order, enough)]

    def bounds(self, asked: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        """Squared distance within which twice the wanted number of sampled vectors of the probed lists lie.

        Twice: a test may give up a candidate near the bound, and enough must be left.
        """
        out = np.full(len(asked), np.inf)
        if len(self.sample) < 2 * self.k:
            return out
        distance, probed = squared(asked, self.sample), np.zeros((len(asked), len(self.centroids)), bool)
        for row, own in zip(probed, lists):
            row[own] = True
        distance[~probed[:, self.near]] = np.inf
        return np.partition(distance, 2 * self.k - 1, axis=1)[:, 2 * self.k - 1] * (1 + 1e-9)

    def scan(self, blocks: list[np.ndarray], asked: np.ndarray, bounds: np.ndarray):
        """(query, row) of the candidates that no test gives up. blocks: a pack's columns, block by block."""
        (_, first), parts = self.cuts[0], [asked[:, a:b] for a, b in self.cuts]
        start = squared(parts[0], blocks[0])
        for i, bound in enumerate(bounds):
            alive = np.flatnonzero(start[i] <= bound * self.shares[0])
            partial = start[i, alive]
            for j in range(1, len(blocks)):
                gap = blocks[j][alive] - parts[j][i]
                partial = partial + np.einsum("ij,ij->i", gap, gap)
                keep = partial <= bound * self.shares[j]
                alive, partial = alive[keep], partial[keep]
            if len(alive) > self.k:
                bounds[i] = bound = min(bound, np.partition(partial, self.k - 1)[self.k - 1] * (1 + 1e-9))
                alive = alive[partial <= bound]
            yield i, alive


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q``, added up from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[j]
    return total


def runs(batches, size: int, make):
    """Packs of up to ``size`` consecutive rows of one list (column 0), made by ``make`` from a table."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if held and held[0].column(0)[0].as_py() != batch.column(0)[at].as_py():
                yield make(pa.Table.from_batches(held))
                held, n = [], 0
            lists = batch.column(0).to_numpy()[at:]
            same = len(lists) if (lists == lists[0]).all() else int(np.argmax(lists != lists[0]))
            take = min(same, size - n)
            held.append(batch.slice(at, take))
            at, n = at + take, n + take
            if n == size:
                yield make(pa.Table.from_batches(held))
                held, n = [], 0
    if held:
        yield make(pa.Table.from_batches(held))


def matrix(column, size: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def by_list(rows: DataFrame) -> DataFrame:
    """Rows of a list next to each other; lists are dealt over tasks, large ones over several."""
    return rows.hint("rebalance", "list").sortWithinPartitions("list")


def index(classes: DataFrame, model: Model, size: int) -> DataFrame:
    def placed(batches):
        for batch in batches:
            x = matrix(batch.column(0), size)
            near = model.assigned(model.turned(x)) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(1)], ["list", "embedding", "ids"])

    def packed(batches):
        def make(t: pa.Table) -> pa.RecordBatch:
            x = matrix(t.column(1), size)
            y = model.turned(x)
            blocks = [np.ascontiguousarray(y[:, a:b]).tobytes() for a, b in model.cuts]
            return pa.RecordBatch.from_arrays(
                [pa.array([t.column(0)[0].as_py()], pa.int32()), pa.array([t.column(2).to_pylist()], pa.list_(pa.list_(pa.int64()))),
                 pa.array([x.tobytes()], pa.binary()), pa.array([blocks], pa.list_(pa.binary()))], ["list", "ids", "vectors", "blocks"])
        yield from runs(batches, PACK, make)

    rows = classes.select("embedding", "ids").mapInArrow(placed, "list int, embedding array<double>, ids array<bigint>")
    return by_list(rows).mapInArrow(packed, INDEX)


def asked_lists(asked: DataFrame, model: Model, size: int) -> DataFrame:
    """Packs of queries for each list that they probe."""
    def placed(batches):
        for batch in (b.slice(at, QUERIES) for b in batches for at in range(0, b.num_rows, QUERIES)):
            x = matrix(batch.column(1), size)
            y = model.turned_query(x)
            lists = model.probed(y)
            bound = model.bounds(y, lists)
            row = np.repeat(np.arange(len(x)), [len(p) for p in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), batch.column(0).take(pa.array(row)),
                                              batch.column(1).take(pa.array(row)), pa.array(bound[row])], ["list", "qid", "embedding", "bound"])

    def packed(batches):
        def make(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([t.column(0)[0].as_py()], pa.int32()), pa.array([t.column(1).to_pylist()], pa.list_(pa.int64())),
                 pa.array([matrix(t.column(2), size).tobytes()], pa.binary()), pa.array([t.column(3).to_numpy().tobytes()], pa.binary())],
                ["list", "ids", "vectors", "bounds"])
        yield from runs(batches, QUERIES, make)

    rows = asked.select("qid", "embedding").mapInArrow(placed, "list int, qid bigint, embedding array<double>, bound double")
    return by_list(rows).mapInArrow(packed, ASKED)


def found_in(indexed: DataFrame, queries: DataFrame, model: Model, size: int) -> DataFrame:
    """(qid, ids, score): of each pack of the index, the best candidates of each query that probes its list."""
    both = indexed.join(queries.select("list", F.col("ids").alias("qids"), F.col("vectors").alias("asked"), "bounds"), "list")

    def run(batches):
        for batch in batches:
            for r in batch.select(["ids", "vectors", "blocks", "qids", "asked", "bounds"]).to_pylist():
                x, q = (np.frombuffer(r[c]).reshape(-1, size) for c in ("vectors", "asked"))
                blocks = [np.frombuffer(b).reshape(-1, z - a) for b, (a, z) in zip(r["blocks"], model.cuts)]
                qid, ids, score = [], [], []
                for i, rows in model.scan(blocks, model.turned_query(q), np.frombuffer(r["bounds"]).copy()):
                    s = products(x[rows], q[i])
                    least = np.array([r["ids"][j][0] for j in rows.tolist()], np.int64)
                    best = np.lexsort((least, -s))[:model.k]
                    qid += [r["qids"][i]] * len(best)
                    ids += [r["ids"][j] for j in rows[best].tolist()]
                    score += s[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(score, pa.float64())],
                                                 ["qid", "ids", "score"])

    return both.select("ids", "vectors", "blocks", "qids", "asked", "bounds").mapInArrow(run, "qid bigint, ids array<bigint>, score double")


def nearest_neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    rows = usable(embeddings)
    classes = written(classes_of(rows, k), "scan-classes")
    queries = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "scan-queries")
    asked = written(queries.groupBy("embedding").agg(F.min("vec_id").alias("qid")), "scan-asked")
    named = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(asked, "embedding").select("query_id", "qid")

    length, v = F.size("embedding"), F.col("embedding")
    norm = F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
    sizes = classes.groupBy(length.alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy("size").collect()
    found = embeddings.sparkSession.createDataFrame([], "qid bigint, ids array<bigint>, score double")
    for s in sizes:
        size = s["size"]
        own = classes.where(length == size)
        drawn = own.orderBy(F.xxhash64(F.col("ids")[0]), "embedding").limit(SAMPLE).select("embedding").collect()
        model = Model(np.array([r["embedding"] for r in drawn]), s["n"], s["norm"] * (1 + 1e-12), k)
        indexed = written(index(own, model, size), "scan-index")
        packs = written(asked_lists(asked.where(length == size), model, size), "scan-probes")
        found = found.unionByName(found_in(indexed, packs, model, size))

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    hits = (found.select("qid", F.explode("ids").alias("vec_id"), "score").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (named.join(written(hits, "scan-hits"), "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
