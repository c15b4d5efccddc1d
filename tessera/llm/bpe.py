"""Byte-level BPE encoding and decoding with a public rank file.

Texts are split as the vocabularies' pattern does: contractions, runs of letters,
of numbers, of other signs (each with a space before it), runs of white space.
Each distinct pre-token of a block travels once to the bucket of its hash, is encoded there once, and its ids return
to the block, where they take the places of the pre-token (see blocks). Decoding
joins ids with the table of token bytes, whose size the vocabulary fixes.

Defined results: a null or empty text has no tokens; each input row gives one
row, null and repeated ids too; a text of any length is encoded whole.
"""
from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks

# The characters that Unicode calls white space.
WHITE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, BLANK, MARK = range(5)
BETWEEN = 0x110000
SAFE = re.compile(r"\S ")
PIECE = 1 << 19
# Odd multipliers of the two hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
DIGESTS = "doc_id bigint, n_tokens bigint, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def classes() -> np.ndarray:
    """Class of each code point, as the pattern's alternatives tell them apart; beyond the last one, the mark between texts."""
    table = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, chars in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{WHITE}]+")):
        for m in regex.finditer(chars, every):
            table[m.start(): m.end()] = kind
    table[BETWEEN] = MARK
    return table


@cache
def class_table() -> np.ndarray:
    """The table, built once a worker."""
    return classes()


def starts_of(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point.

    Pre-tokens are runs of one class. A space right before such a run belongs to it. White space that a text goes on after
    gives up its last character: to the run if it is a space, else as a pre-token by itself. An apostrophe that begins a run
    without a space takes the letters of a contraction.
    """
    after = np.append(kinds[1:], MARK)
    begin = np.empty(len(points), bool)
    begin[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
    last = (kinds == BLANK) & (after != BLANK) & (after != MARK)
    begin |= last
    begin[1:][(last & (points == 32))[:-1]] = False
    quote = np.flatnonzero(begin & (points == 39))
    if len(quote):
        padded = np.append(points, [BETWEEN] * 3)
        one, two = padded[quote + 1], padded[quote + 2]
        length = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) & (True if len(c) == 1 else two == ord(c[1]))
            length[hit & (length == 0)] = 1 + len(c)
        at, length = quote[length > 0], length[length > 0]
        begin[at + 1] = False
        end = at + length
        begin[end[end < len(begin)]] = True
    return begin


class Splitter:
    """Pre-tokens of texts, found and numbered in numpy.

    A pre-token is known by two 64-bit hashes of its code points; only one of each kind is sliced out. Were two kinds to agree
    in the first hash, the second would tell, and the block is numbered by the strings themselves.
    """

    def __init__(self, table: np.ndarray):
        self.table, self.counts = table, []
        self.waiting: list[str] = []
        self.size = 0
        self.seen: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, text: bytes) -> None:
        text, parts = text.decode("utf-8", "replace"), 0
        while len(text) > PIECE:
            # A space after a character that is not white space always begins a pre-token.
            cut = SAFE.search(text, PIECE)
            if cut is None:
                break
            self.push(text[: cut.end() - 1])
            text, parts = text[cut.end() - 1:], parts + 1
        self.push(text)
        self.counts.append(parts + 1)

    def push(self, text: str) -> None:
        self.waiting.append(text)
        self.size += len(text)
        if self.size >= PIECE:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        joined = "\0".join(self.waiting) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in self.waiting])
        points[ends - 1] = BETWEEN
        kinds = self.table[points]
        begin = np.flatnonzero(starts_of(points, kinds))
        length = np.diff(begin, append=len(points))
        place = np.arange(len(points)) - np.repeat(begin, length)
        values, most = points.astype(np.uint64) + np.uint64(1), int(length.max())
        hashes = []
        for base in BASES:
            powers = np.cumprod(np.full(most, base, np.uint64))
            hashes.append(np.add.reduceat(values * powers[place], begin))
        real = kinds[begin] != MARK
        begin, length = begin[real].astype(np.int32), length[real].astype(np.int32)
        each = np.diff(np.searchsorted(begin, ends), prepend=0)
        self.seen.append((joined, begin, length, each, hashes[0][real], hashes[1][real]))
        self.waiting, self.size = [], 0

    def finish(self):
        self.flush()
        if not self.seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        joined, begin, length, each, first, second = zip(*self.seen)
        offsets = np.cumsum([0] + [len(b) for b in begin]).tolist()
        first, second = np.concatenate(first), np.concatenate(second)
        begin, length = np.concatenate(begin), np.concatenate(length)

        def word(i):
            return joined[bisect_right(offsets, i) - 1][begin[i]: begin[i] + length[i]]

        _, index, codes, times = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
        if not np.array_equal(second, second[index][codes]):
            numbers = blocks.Numbering()
            codes, times = np.array([numbers[word(i)] for i in range(len(begin))], np.int64), np.ones(len(numbers))
            words = list(numbers)
        else:
            words = [word(i) for i in index.tolist()]
        rank = np.argsort(-times, kind="stable")  # small numbers for frequent words compress better
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        upto = np.concatenate([[0], np.cumsum(np.concatenate(each))])[np.cumsum(self.counts)]
        return place[codes], np.diff(upto, prepend=0), [words[i].encode() for i in rank.tolist()]


ENCODERS: dict = {}


def whole_encoder(table):
    """Encodes a string as one pre-token; built once a worker for a broadcast vocabulary."""
    if table.value is not ENCODERS.get("ranks"):
        ENCODERS["ranks"] = table.value
        ENCODERS["one"] = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={}).encode_ordinary
    return ENCODERS["one"]


def encode(docs: DataFrame, ranks: dict[bytes, int], block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = blocks.bucket_count(spark)
    table = spark.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size

    def splitter():
        return Splitter(class_table())

    def work(group: pa.Table) -> pa.Table:
        one = whole_encoder(table)
        ids: dict[bytes, list[int]] = {}
        out = {"block": [], "bucket": [], "counts": [], "ids": []}
        for block, bucket, lengths, words in zip(*(group.column(c).to_pylist() for c in ("block", "bucket", "lengths", "words"))):
            found = []
            for w in blocks.unpacked_bytes(lengths, words):
                if (i := ids.get(w)) is None:
                    i = ids[w] = one(w.decode())
                found.append(i)
            for k, v in zip(out, (block, bucket, blocks.packed(np.fromiter(map(len, found), np.uint32, len(found))),
                                  blocks.packed(np.array([x for i in found for x in i], np.uint32)))):
                out[k].append(v)
        return pa.table(out, pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())]))

    values = blocks.by_bucket(blocks.word_rows(rows, splitter, buckets, block_bytes=block_bytes), work,
                              "block string, bucket int, counts binary, ids binary")

    def place(row, codes, lengths, mine):
        words = sum(len(part) for part, _ in mine.values())
        sizes, starts, flat, at = np.zeros(words, np.int64), np.zeros(words, np.int64), [], 0
        for part, value in mine.values():
            counts = blocks.unpacked(value["counts"]).astype(np.int64)
            sizes[part] = counts
            starts[part] = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            flat.append(blocks.unpacked(value["ids"]))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        word_ends = np.concatenate([[0], np.cumsum(lengths)])
        counts, out = [], []
        for a, b in zip(word_ends[:-1].tolist(), word_ends[1:].tolist()):
            each = sizes[codes[a:b]]
            ends = np.cumsum(each)
            n = int(ends[-1]) if len(ends) else 0
            counts.append(n)
            out.append(flat[np.repeat(starts[codes[a:b]] - (ends - each), each) + np.arange(n)].astype("<u4").tobytes())
        return [pa.array(counts, pa.int64()), pa.array(out, pa.binary())]

    return blocks.reassemble(rows, values, splitter, buckets, place, ["doc_id"], "n_tokens bigint, ids binary",
                             block_bytes=block_bytes)


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``tokens`` (doc_id, n_tokens, ids) with decoded (bytes)."""
    table = tokens.sparkSession.sparkContext.broadcast(ranks)
    rows = tokens.select("doc_id", "n_tokens", "ids")

    def run(batches):
        parts = {rank: token for token, rank in table.value.items()}.__getitem__
        for batch in batches:
            texts = [b"".join(map(parts, np.frombuffer(x, "<u4").tolist())) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(run, f"{DIGESTS}, decoded binary")


def token_digests(docs: DataFrame, ranks: dict[bytes, int], **options) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, ranks, **options), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
