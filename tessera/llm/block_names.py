"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes; the distinct blocks are
sorted into integer names; adjacent names are then named pair by pair, level by
level, until each document has one name. Equal names at equal levels mean equal
texts and nothing else: no step trusts a hash. Blocks are sorted by (hash,
length) and, if any two different blocks agree in both, by their bytes as well.

Defined results: a null text is empty; rows that repeat both doc_id and text are
one document, returned once, and all counted in ``group_size``; a null doc_id is
kept only in a group without any other id. Empty input gives no rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

BLOCK_BYTES = 4096
KEY = ["doc_id", "text_sha256"]


def cut(docs: DataFrame, normalise: Callable[[Column], Column], block_bytes: int,
        block_hash: Callable[[Column], Column]) -> DataFrame:
    """One row per block: key, number of blocks, position, hash, length, bytes."""
    body = docs.select("doc_id", normalise(F.coalesce("text", F.lit(""))).cast("binary").alias("_body"))
    count = F.greatest(F.ceil(F.octet_length("_body") / F.lit(block_bytes)), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1),
                         lambda i: F.substring(F.col("_body"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = body.select("doc_id", F.sha2("_body", 256).alias("text_sha256"), count.alias("_n"), F.posexplode(blocks))
    return rows.select(*KEY, "_n", F.col("pos").alias("_pos"), block_hash(F.col("col")).alias("_h"),
                       F.octet_length("col").alias("_len"), F.col("col").alias("_block"))


def named(keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct key rows in sort order, each with its integer name; written, so a name never changes."""
    ordered = keys.select(*columns).distinct().sort(*columns)
    return written(ordered.withColumn("_name", F.monotonically_increasing_id()), label)


def identities(docs: DataFrame, normalise: Callable[[Column], Column] = lambda text: text,
               block_bytes: int = BLOCK_BYTES,
               block_hash: Callable[[Column], Column] = lambda b: F.xxhash64(b)) -> DataFrame:
    """(doc_id, text_sha256, _rows, _level, _name): equal (_level, _name) if and only if the texts are equal."""
    blocks = cut(docs, normalise, block_bytes, block_hash)
    # The only step that moves text: the distinct blocks, combined on the map side first.
    kinds = written(blocks.groupBy("_h", "_len", "_block").agg(F.lit(1).alias("_one"))
                    .groupBy("_h", "_len").agg(F.count("*").alias("_contents")), "block-kinds")
    clash = kinds.agg(F.max("_contents")).first()[0]
    by = ["_h", "_len"] if (clash or 1) == 1 else ["_h", "_len", "_block"]
    rows = written(blocks.groupBy(*KEY, "_n", "_pos", *by).agg(F.count("*").alias("_rows")), "blocks")
    names = named(kinds if by == ["_h", "_len"] else blocks, by, "block-names")
    rows = rows.join(names, by).select(*KEY, "_rows", "_n", "_pos", "_name")
    most = rows.agg(F.max("_n")).first()[0] or 1

    level, out = 0, []
    while True:
        out.append(rows.where("_n = 1").select(*KEY, "_rows", F.lit(level).alias("_level"), "_name"))
        if most == 1:
            break
        first = F.col("_pos") % 2 == 0
        pairs = written(
            rows.where("_n > 1")
            .groupBy(*KEY, F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.floor(F.col("_pos") / 2).cast("int").alias("_pos"))
            .agg(F.max("_rows").alias("_rows"), F.max(F.when(first, F.col("_name"))).alias("_a"),
                 F.coalesce(F.max(F.when(~first, F.col("_name"))), F.lit(-1)).alias("_b")), f"pairs-{level}")
        names = named(pairs, ["_a", "_b"], f"pair-names-{level}")
        rows = pairs.join(names, ["_a", "_b"]).select(*KEY, "_rows", "_n", "_pos", "_name")
        most, level = (most + 1) // 2, level + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def block_dedup(docs: DataFrame, normalise: Callable[[Column], Column] = lambda text: text,
                block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """Per document: doc_id, keep_id (largest id of its equal texts), group_size, kept, text_sha256."""
    ids = written(identities(docs, normalise, block_bytes, **options), "identities")
    groups = ids.groupBy("_level", "_name").agg(F.max("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
    return ids.join(groups, ["_level", "_name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept."""
    kept = block_dedup(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    own = docs.withColumn("_sha_own", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return own.join(kept, own["doc_id"].eqNullSafe(kept["_id"]) & (own["_sha_own"] == kept["_sha"]), "left_semi").drop("_sha_own")
