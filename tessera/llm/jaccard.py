"""N-gram Jaccard join: near-duplicate documents by size-banded tiles, bitmap signatures and exact intersection.

A document's set holds the hashes (64 bits) of its distinct word n-grams. Two sets
link when their Jaccard similarity reaches the threshold, and then their sizes and
their symmetric difference are bounded. Candidates are found without loss:

- Sizes fall into bands; a set is entered in its own band and in the one below
  when a set of that band could link to it.
- In a band any two linked sets differ in at most D hashes. The hash range is cut
  into D + 1 + e parts, so in at least e + 1 of them the two sets agree. A set's keys
  are the hashes of its non-empty parts, and each choice of e + 1 of its empty ones. So many
  spare parts (e) are taken that sets hardly ever have e + 1 empty ones: keys stay in proportion to a
  set's size, and unrelated sets meet only where they hold the same n-grams.
- Sets that share a key (a tile) are candidates. Copies of one set are one class
  with one representative, so only different sets meet.

Pairs are then cut down by parity bitmaps: the bits in which two signatures differ
are a lower bound of the symmetric difference, so an upper bound of the overlap.
What is left is intersected exactly, as sorted arrays. Only components are asked
for, so a tile needs no pair of sets that are linked already: the first two rounds
take stars within tiles, the third takes every pair of a tile whose sets are still
in different components, block against block.

Defined results: a null or empty text has no n-grams and is linked with nothing; a
text of fewer words is one n-gram. Rows that share a doc_id are one document: it
is linked if any of them is. A null doc_id gets the component of its copies, null
without any. Component ids are the smallest doc_id of the component.
"""
from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import is_empty, utf8, written

RATIO = 1.2  # of a band's upper to its lower size
SPREAD = 0.02  # choices of empty parts a set may have on average
SMALL_SPREAD = 20  # the same where sets are too small for that
STAR = 64  # sets of one star
TILE = 4096  # sets of a block in the exact round
SKETCH = 4  # 64-bit words of the short signature that travels with a key
CACHE = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text (A-Z in lower case, words between ASCII white space)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        h, n = h[None, :], len(h)
    else:
        h = np.lib.stride_tricks.sliding_window_view(h, n)
    x = np.full(h.shape[0], n, np.uint64)
    for i in range(n):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[:, i])
    return np.unique(x)


class Bands:
    """Size bands for sets that link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differ(self, total):
        """Most elements in which two linked sets of ``total`` elements together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    @cache
    def lower(self, band: int) -> int:
        if band == 0:
            return 1
        below = self.lower(band - 1)
        return max(below + 1, math.ceil(below * RATIO))

    def band(self, size: int) -> int:
        b = 0
        while self.lower(b + 1) <= size:
            b += 1
        return b

    @cache
    def bands(self, size: int) -> tuple[int, ...]:
        """Bands of the sizes from the smallest that can link up to ``size``."""
        return tuple(range(self.band(max(1, -(-size * self.num // self.den))), self.band(size) + 1))

    @cache
    def parts(self, band: int) -> tuple[int, int]:
        """(parts, clean): of so many parts, at least ``clean`` are equal in two linked sets; (0, 0) if only equal sets link."""
        high = self.lower(band + 1) - 1
        d = self.differ(high + high * self.den // self.num)
        if d == 0:
            return 0, 0
        low = self.lower(band)

        def choices(e: int) -> float:
            empty = (d + 1 + e) * math.exp(-low / (d + 1 + e))
            return math.exp(min(300.0, (e + 1) * math.log(empty) - math.lgamma(e + 2)))

        spare = next((e for e in range(2 * d) if choices(e) <= SPREAD), None)
        if spare is None:
            spare = next((e for e in (2, 3) if choices(e) <= SMALL_SPREAD), 1)
        return d + 1 + spare, spare + 1

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Keys of a set (sorted hashes)."""
        out, x = [], np.sort(mixed(x))  # even over the hash range, whatever the hashes given
        for band in self.bands(len(x)):
            m, clean = self.parts(band)
            if not m:
                continue
            part = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            there = part[begin]
            salt = np.uint64(band << 40 | m)
            out.append(mixed(np.add.reduceat(mixed(x + salt), begin) + mixed(there + salt)))
            if len(there) <= m - clean:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), there, assume_unique=True)
                chosen = np.array(list(combinations(empty.tolist(), clean)), np.uint64)
                k = np.full(len(chosen), salt + np.uint64(1 << 60), np.uint64)
                for i in range(clean):
                    k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
                out.append(k)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """Parity bitmap with at least four bits for each element in which linked sets can differ; a power of two of 64-bit words."""
        words = 1 << max(0, math.ceil(math.log2(max(1, 4 * self.differ(2 * len(x)) / 64))))
        words = max(words, SKETCH)
        return bitmap(x, words)


def bitmap(x: np.ndarray, words: int) -> np.ndarray:
    odd = np.bincount((x % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer words of the same set."""
    return np.bitwise_xor.reduce(signature.reshape(-1, words), axis=0)


def node_type(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def summaries(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Per row: doc_id, n_shingles, the class of its set (c1, c2) and its signature."""
    def run(batches):
        hashes = Hashes()
        for batch in batches:
            size, c1, c2, bits = [], [], [], []
            for text in utf8(batch.column(1)):
                x = shingles(text, n, hashes)
                size.append(len(x))
                c1.append(int(mixed(x).sum(dtype=np.uint64).view(np.int64)))
                c2.append(int(mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                bits.append(bands.signature(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                                              pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "c1", "c2", "bits"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, bits binary")


def tile_keys(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(key, c1): the keys of every set. A task gives the keys of copies once."""
    def run(batches):
        hashes, seen = Hashes(), set()
        for batch in batches:
            keys, owners = [], []
            for text in utf8(batch.column(1)):
                x = shingles(text, n, hashes)
                c1 = int(mixed(x).sum(dtype=np.uint64).view(np.int64))
                if len(x) and c1 not in seen:
                    seen.add(c1)
                    k = bands.keys(x)
                    keys.append(k.view(np.int64))
                    owners.append(np.full(len(k), c1, np.int64))
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(owners)
                for i in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i: i + (1 << 18)]), pa.array(owner[i: i + (1 << 18)])], ["key", "c1"])

    return docs.mapInArrow(run, "key bigint, c1 bigint")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, hashes): sorted arrays of the documents in ``nodes``."""
    rows = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").select("doc_id", "text")

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            sets = [shingles(t, n, hashes).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return rows.mapInArrow(run, "node bigint, hashes binary")


def bounded(pairs: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose overlap, as far as the signatures bound it, can reach the threshold."""
    one = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("sb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = []
            for i, (s, t) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                w = min(len(s), len(t))
                differ = int(np.bitwise_count(folded(s, w) ^ folded(t, w)).sum())
                if differ <= bands.differ(int(na[i] + nb[i])):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs that link, by intersection of the sorted arrays."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if bands.den * both >= bands.num * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node of an edge (large-star and small-star steps)."""
    def star(e, larger_only):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger_only:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if larger_only:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    mark = None
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        e = written(star(written(star(e, True), "large-star"), False), "small-star")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "components")


def open_tiles(tiles: DataFrame, roots: DataFrame | None) -> DataFrame:
    """tiles with ``root`` (the node itself if unlinked), for the keys that still hold several components."""
    rows = (tiles.withColumn("root", F.col("node")) if roots is None
            else tiles.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    if roots is None:
        return rows
    key = Window.partitionBy("key")
    return rows.withColumns({"_lo": F.min("root").over(key), "_hi": F.max("root").over(key)}).where("_lo <> _hi").drop("_lo", "_hi")


def star_pairs(rows: DataFrame) -> DataFrame:
    """One set of each component of a key, STAR at a time in order of size, each with the first."""
    leaders = rows.groupBy("key", "root").agg(F.min("node").alias("node"), F.min("n_shingles").alias("n_shingles"))
    order = Window.partitionBy("key").orderBy("n_shingles", "node")
    placed = leaders.withColumn("_star", F.floor((F.row_number().over(order) - 1) / STAR))
    star = Window.partitionBy("key", "_star").orderBy("n_shingles", "node")
    return placed.withColumn("_first", F.first("node").over(star)).where("node <> _first").select(
        F.greatest("node", "_first").alias("a"), F.least("node", "_first").alias("b")).distinct()


def all_pairs(rows: DataFrame, bands: Bands) -> DataFrame:
    """Every pair of sets of a key in different components that the short signatures do not rule out, block against block."""
    order = Window.partitionBy("key").orderBy("n_shingles", "node")
    placed = rows.withColumns({"_tile": F.floor((F.row_number().over(order) - 1) / TILE).cast("int"),
                               "_last": F.floor((F.count("*").over(Window.partitionBy("key")) - 1) / TILE).cast("int")})
    met = placed.select("key", "node", "root", "n_shingles", "sketch", "_tile", F.explode(F.sequence(F.lit(0), "_last")).alias("_other"))
    met = met.select("key", F.least("_tile", "_other").alias("t1"), F.greatest("_tile", "_other").alias("t2"), "_tile", "node", "root",
                     "n_shingles", "sketch")
    blocks = met.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "node")

    def compare(block: pa.Table):
        """Pairs of rows of equal (key, t1, t2): each row against the one d rows below it, for d = 1, 2, ..."""
        key = np.stack([block.column(i).to_numpy() for i in range(3)], axis=1).astype(np.int64)
        tile, node, root, size = (block.column(i).to_numpy() for i in range(3, 7))
        bits = np.frombuffer(b"".join(block.column(7).to_pylist()), np.uint64).reshape(-1, SKETCH)
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))
        apart = key[:, 1] != key[:, 2]
        at, d = np.arange(len(node) - 1), 1
        while len(at := at[at + d < len(node)]) and len(at := at[group[at] == group[at + d]]):
            other = at + d
            good = (root[at] != root[other]) & (~apart[at] | (tile[at] != tile[other]))
            i, j = at[good], other[good]
            limit = (size[i] + size[j]) * (bands.den - bands.num) // (bands.den + bands.num)
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            good = (np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= limit) & (bands.den * small >= bands.num * large)
            if good.any():
                a, b = node[i[good]], node[j[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
            d += 1

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # All rows of the last group may not be here yet: hold them back.
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            same = (key == key[-1]).all(axis=1)
            first = int(np.argmax(same))
            if first:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = []
            elif held and any(held[-1].column(i)[0].as_py() != batch.column(i)[0].as_py() for i in range(3)):
                yield from compare(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(first))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return blocks.mapInArrow(run, "a bigint, b bigint").distinct()


def linked_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id. Sets link when den * intersection >= num * union."""
    bands = Bands(num, den)
    docs = node_type(docs)
    rows = written(summaries(docs, n, bands), "jaccard-summaries")
    own = ["c1", "c2", "n_shingles"]
    reps = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*own).agg(F.min("doc_id").alias("node"))
    short = F.udf(lambda b: folded(np.frombuffer(b, np.uint64), SKETCH).tobytes(), "binary", useArrow=True)
    classes = rows.join(reps, own).where("doc_id = node").select("node", *own, "bits").dropDuplicates(["node", *own])
    classes = written(classes.withColumn("sketch", short("bits")), "jaccard-classes")

    key = Window.partitionBy("key")
    shared = (tile_keys(docs, n, bands).withColumns({"_lo": F.min("c1").over(key), "_hi": F.max("c1").over(key)})
              .where("_lo <> _hi").select("key", "c1").distinct())
    tiles = written(shared.join(classes.select("c1", "node", "n_shingles", "sketch"), "c1").drop("c1"), "jaccard-tiles")

    edges = roots = None
    for step in ("star", "star", "all"):
        rest = open_tiles(tiles, roots)
        pairs = star_pairs(rest) if step == "star" else all_pairs(rest, bands)
        pairs = written(bounded(pairs, classes.select("node", "n_shingles", "bits"), bands), f"jaccard-{step}")
        if is_empty(pairs):
            continue
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = written(sets_of(docs, nodes, n), "jaccard-sets")
        found = written(verified(pairs, sets, bands), "jaccard-links")
        if is_empty(found):
            continue
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges)
    named = classes.select(*own, "node")
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    named = named.groupBy(*own).agg(F.min("node").alias("_root"))
    return rows.join(named, own, "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_root")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component (its smallest doc_id), all columns kept."""
    gone = linked_components(docs, n, num, den).where("doc_id <> component_id OR doc_id IS NULL AND component_id IS NOT NULL").select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")
