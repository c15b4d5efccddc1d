"""Helpers shared by the corpus operators."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder and read back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


def utf8(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_fold(column: str, n: int):
    """crc32 of the id written as text, modulo ``n`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def equal_nulls(left: DataFrame, right: DataFrame, columns: list[str]):
    """Join condition on ``columns`` in which nulls are equal."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def map_texts(docs: DataFrame, carry: list[str], fields: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
              text: str = "text") -> DataFrame:
    """Columns ``carry`` of ``docs`` with new ones (``fields``, DDL) worked out from the texts of each Arrow batch.

    ``make`` runs once a task; what it returns gets the UTF-8 texts of a batch and gives the new columns' arrays.
    """
    columns = carry if text in carry else [*carry, text]
    at, names = columns.index(text), [*carry, *T.StructType.fromDDL(fields).names]
    rows = docs.select(*columns)

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + work(utf8(batch.column(at))), names)

    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + T.StructType.fromDDL(fields).fields))
