"""Centroid clustering: exact integer k-means over subvector dictionaries.

Vectors become integers, ``floor(1024 * x)`` of each component, and are stored once in packs of
up to PACK rows. A pack cuts the dimensions into blocks and keeps, for each block, the dictionary
of its distinct subvectors and a code for each row, so nothing is lost. Neighbouring blocks are
joined into wider ones for as long as the joint dictionary stays small against the rows.

A round works out the exact distance of every dictionary entry to every centroid, once, and
sums these partial distances by code; the sums that the new centroids need come from counts of
codes, so a vector is never unpacked. A task gives one row of sums for each centroid, and
only these (a row for each centroid and task) are shuffled. No vector moves after packing.

Defined results. Kept are vectors of exactly ``dim`` components, none null or non-finite; other rows
give no result. Rows are one vector each, repeated ids and repeated rows too. The first centroids are the
``k`` rows of smallest sha256 of ``"3:" + vec_id`` (a null id counts as empty text; equal hashes by
components); fewer rows give fewer centroids, no rows an empty result. Distances tie towards the smaller centroid.
All arithmetic is exact: an integer beyond 2^27, whose squared distances a long would not hold, ends the job
with a message.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024
PACK = 16_384  # rows of a pack
SHARE = 8  # a joint dictionary may have one entry for so many rows
LARGEST = 1 << 27

PACK_FIELDS = "ids array<bigint>, widths array<int>, subvectors array<binary>, codes array<binary>"


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct subvectors, code of each row) of an integer matrix."""
    if block.shape[1] == 1:
        values, codes = np.unique(block[:, 0], return_inverse=True)
        return values[:, None], codes
    values, codes = np.unique(block, axis=0, return_inverse=True)
    return values, codes.reshape(-1)


def dictionaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Dictionary and codes of each block of dimensions, in order; blocks are joined while the dictionary is small."""
    blocks = [dictionary(x[:, [i]]) for i in range(x.shape[1])]
    most = max(1, len(x) // SHARE)
    while True:
        out, i = [], 0
        while i < len(blocks):
            if i + 1 < len(blocks):
                (a, ca), (b, cb) = blocks[i], blocks[i + 1]
                pairs, codes = np.unique(ca * len(b) + cb, return_inverse=True)
                if len(pairs) <= most:
                    out.append((np.hstack([a[pairs // len(b)], b[pairs % len(b)]]), codes))
                    i += 2
                    continue
            out.append(blocks[i])
            i += 1
        if len(out) == len(blocks):
            return blocks
        blocks = out


def packs(vectors: DataFrame, dim: int) -> DataFrame:
    """The kept vectors, in packs."""
    def packed(ids: list, x: np.ndarray) -> pa.RecordBatch:
        blocks = dictionaries(x)
        columns = [[ids], [[v.shape[1] for v, _ in blocks]], [[v.astype("<i8").tobytes() for v, _ in blocks]],
                   [[c.astype("<u2" if len(v) <= 1 << 16 else "<u4").tobytes() for v, c in blocks]]]
        types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ids", "widths", "subvectors", "codes"])

    def run(batches):
        ids, parts, held = [], [], 0
        for batch in batches:
            x = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE)
            if x.size and np.abs(x).max() > LARGEST:
                raise OverflowError(f"a component beyond {LARGEST} / {SCALE}: its squared distances do not fit a long")
            ids += batch.column(0).to_pylist()
            parts.append(x.astype(np.int64))
            held += len(x)
            while held >= PACK:
                x = np.concatenate(parts)
                yield packed(ids[:PACK], x[:PACK])
                ids, parts, held = ids[PACK:], [x[PACK:]], held - PACK
        if held:
            yield packed(ids, np.concatenate(parts))

    return vectors.mapInArrow(run, PACK_FIELDS)


def unpacked(batch: pa.RecordBatch):
    """(ids, [(subvectors, codes)]) of each pack."""
    ids, widths, subvectors, codes = (batch.column(i) for i in range(4))
    for r in range(batch.num_rows):
        blocks = []
        for w, v, c in zip(widths[r].as_py(), subvectors[r].as_py(), codes[r].as_py()):
            v = np.frombuffer(v, "<i8").reshape(-1, w)
            blocks.append((v, np.frombuffer(c, "<u2" if len(v) <= 1 << 16 else "<u4")))
        yield ids[r].values, blocks


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row: partial distances of dictionary entries, summed by code."""
    total, at = np.zeros((len(blocks[0][1]), len(centroids)), np.int64), 0
    for values, codes in blocks:
        part = centroids[:, at: at + values.shape[1]]
        total += np.stack([((values - c) ** 2).sum(axis=1) for c in part], axis=1)[codes]
        at += values.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def sums(packed: DataFrame, centroids: list[list[int]]) -> list:
    """Per centroid with vectors: number, summed squared distance and summed components."""
    dim = len(centroids[0])
    names = ["cluster", "n", "inertia", *[f"s{i}" for i in range(dim)]]

    def run(batches):
        c = np.array(centroids, np.int64)
        n, inertia, total = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64)
        for batch in batches:
            for _, blocks in unpacked(batch):
                cluster, distance = nearest(blocks, c)
                n += np.bincount(cluster, minlength=len(c))
                np.add.at(inertia, cluster, distance)
                at = 0
                for values, codes in blocks:
                    seen = np.bincount(cluster * len(values) + codes, minlength=len(c) * len(values)).reshape(len(c), -1)
                    total[:, at: at + values.shape[1]] += seen @ values
                    at += values.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(n), pa.array(inertia), *[pa.array(t) for t in total.T]], names)

    rows = packed.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    return rows.where("n > 0").groupBy("cluster").agg(*[F.sum(x).alias(x) for x in names[1:]]).collect()


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors of smallest salted hash of their id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(digest, "embedding").limit(k).select("embedding").collect()
    return [[int(np.floor(x * SCALE)) for x in r["embedding"]] for r in rows]


def usable(embeddings: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows with ``dim`` components, none null or non-finite."""
    v = F.col("embedding")
    return (embeddings.where(F.size(v) == dim)
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")))


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, salt: str = "3:") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    fields = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    spark, vectors = embeddings.sparkSession, usable(embeddings, dim)
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        return spark.createDataFrame([], fields)
    packed = written(packs(vectors, dim), "subvector-packs")
    for _ in range(rounds):
        for r in sums(packed, centroids):
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    inertia = [0] * len(centroids)
    for r in sums(packed, centroids):
        inertia[r["cluster"]] = r["inertia"]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        c, of, names = np.array(centroids, np.int64), np.array(inertia, np.int64), pa.array(digests)
        for batch in batches:
            for ids, blocks in unpacked(batch):
                cluster, distance = nearest(blocks, c)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(of[cluster]),
                     pa.array(np.full(len(cluster), sum(inertia))), names.take(pa.array(cluster))],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(run, fields)
