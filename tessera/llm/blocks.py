"""Dictionary blocks: per-word work on a corpus without a shuffled row per token.

The texts of an Arrow batch are cut into blocks of bounded size. In a block each
distinct word has a number and each text is the array of its words' numbers, in
order of position. Only distinct words travel: a block sends one row for each
hash bucket of words (``word_rows``), the bucket's group works on each distinct
word once (``by_bucket``), and the values come back to the block, where they meet
its texts' numbers again (``reassemble``).

The two passes over the texts must cut the same blocks, as two scans of a stored
table do. A block's name holds its place, a hash of its ids and of its words, so
a pass over rows in another order finds no values for its blocks and fails; it
cannot give a wrong result. Write such a table first.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 4 << 20  # of text; a worker holds some twenty times as much in arrays
BUCKETS_A_PARTITION = 8
LEVEL = 1
CHANGED = "a block has no texts or no values: the table's rows changed between two passes; write it first"


class Numbering(dict):
    """Word to its number, given in order of first appearance."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


@dataclass
class Block:
    name: str
    rows: pa.RecordBatch  # the carried columns of the block's texts
    codes: np.ndarray  # word numbers of all texts, one text after another
    lengths: np.ndarray  # words of each text
    words: list[bytes]


def packed(array: np.ndarray) -> bytes:
    """uint32 numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(array.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def packed_long(array: np.ndarray) -> bytes:
    return packed(array.astype("<u8").view("<u4"))


def unpacked_long(blob: bytes) -> np.ndarray:
    return unpacked(blob).view("<u8").astype(np.int64)


def packed_bytes(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings as (lengths, contents)."""
    return (packed(np.fromiter(map(len, parts), np.uint32, len(parts))),
            zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts)))


def unpacked_bytes(lengths: bytes, contents: bytes) -> list[bytes]:
    ends = np.cumsum(unpacked(lengths), dtype=np.int64).tolist()
    body = zstandard.ZstdDecompressor().decompress(contents)
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def cut(batches, text_at: int, splitter: Callable, block_bytes: int) -> Iterator[Block]:
    """Blocks of the batches' texts. ``splitter()`` has add(text: bytes) and finish() -> (codes, lengths, words)."""
    place = f"{TaskContext.get().partitionId()}"
    n = 0
    for batch in batches:
        texts = batch.column(text_at).cast(pa.binary())
        start = size = 0
        split = splitter()
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            size += len(text)
            split.add(text)
            if size >= block_bytes or i == batch.num_rows - 1:
                codes, lengths, words = split.finish()
                rows = batch.slice(start, i + 1 - start)
                mark = xxhash.xxh64(str(rows.column(0).to_pylist()).encode())
                for w in words:
                    mark.update(w)
                    mark.update(b"\x00")
                split = None
                yield Block(f"{place}-{n}-{mark.hexdigest()}", rows, codes, lengths, words)
                del rows, codes, lengths, words
                n, start, size, split = n + 1, i + 1, 0, splitter()


def bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)


def bucket_count(spark: SparkSession) -> int:
    return BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs with its positions, in order."""
    order = np.argsort(bucket, kind="stable")
    values, starts = np.unique(bucket[order], return_index=True)
    for value, part in zip(values.tolist(), np.split(order, starts[1:])):
        if len(part):
            yield value, part


def word_rows(docs: DataFrame, splitter: Callable, buckets: int, weigh: Callable[[Block], np.ndarray] | None = None,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, bucket, lengths, words, weights): the distinct words of each block, one row a bucket.

    ``docs``: columns to carry, text last. ``weigh`` gives each word of a block a number.
    """
    at = len(docs.columns) - 1

    def run(batches):
        for block in cut(batches, at, splitter, block_bytes):
            weights = weigh(block) if weigh else np.zeros(len(block.words), np.uint32)
            rows = {"block": [], "bucket": [], "lengths": [], "words": [], "weights": []}
            for bucket, part in groups(bucket_of(block.words, buckets)):
                lengths, words = packed_bytes([block.words[i] for i in part.tolist()])
                for k, v in zip(rows, (block.name, bucket, lengths, words, packed(weights[part]))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema(
                [("block", pa.string()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary()), ("weights", pa.binary())]))

    return docs.mapInArrow(run, "block string, bucket int, lengths binary, words binary, weights binary")


def by_bucket(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the group of each bucket."""
    return rows.groupBy("bucket").applyInArrow(work, schema)


def reassemble(docs: DataFrame, values: DataFrame, splitter: Callable, buckets: int,
               work: Callable[[dict, np.ndarray, np.ndarray, dict], list[pa.Array]], carry: list[str], fields: str,
               weigh: Callable[[Block], np.ndarray] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``carry`` of ``docs`` with ``fields``, which ``work`` makes of a block's texts and its words' values.

    ``values``: block, bucket and what by_bucket made. ``work`` gets the block's row (with the words' ``weights``), its codes
    and lengths, and for each bucket the positions of its words with the row of values.
    """
    at = len(docs.columns) - 1
    carried = T.StructType([docs.schema[c] for c in carry])

    def run(batches):
        for block in cut(batches, at, splitter, block_bytes):
            weights = weigh(block) if weigh else np.zeros(0, np.uint32)
            columns = [pa.array([block.rows.column(i).to_pylist()], pa.list_(block.rows.column(i).type)) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.name])] + columns + [pa.array([packed(x)], pa.binary()) for x in (
                    block.codes, block.lengths, bucket_of(block.words, buckets), weights)],
                ["block", *[f"c{i}" for i in range(len(carry))], "codes", "lengths", "buckets", "weights"])

    fields_of = T.StructType([T.StructField("block", T.StringType())] + [
        T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(carried)] + [
        T.StructField(c, T.BinaryType()) for c in ("codes", "lengths", "buckets", "weights")])
    texts = docs.mapInArrow(run, fields_of)
    out = T.StructType(carried.fields + T.StructType.fromDDL(fields).fields)
    names = out.names

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r["bucket"]: r for r in right.to_pylist()}
        parts = []
        for row in left.to_pylist():
            codes, lengths, bucket = (unpacked(row[c]) for c in ("codes", "lengths", "buckets"))
            mine = {}
            for b, part in groups(bucket.astype(np.int64)):
                if b not in found:
                    raise RuntimeError(CHANGED)
                mine[b] = (part, found[b])
            kept = [pa.array(row[f"c{i}"], left.schema.field(f"c{i}").type.value_type) for i in range(len(carry))]
            parts.append(pa.Table.from_arrays(kept + work(row, codes, lengths.astype(np.int64), mine), names))
        if not parts:
            raise RuntimeError(CHANGED)
        return pa.concat_tables(parts)

    return texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(join, out)
