"""Plan helpers."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path


def materialize(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns evaluated once per row.

    The optimizer inlines a projected expression into every later reference
    (CollapseProject); for text built by concatenation or regex chains over
    page bodies that multiplies the work per row and the generated code. A
    one-row ``inline`` (a Generate node) keeps them evaluated once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))))


def join_keeping_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the other columns of ``right`` on ``keys``, null keys meeting null keys."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def spread(df: DataFrame, probe: DataFrame | None = None, min_partitions: int | None = None, rows_each: int = 50_000,
           merged: bool = False) -> DataFrame:
    """Round-robin ``df`` over at least the cluster's default parallelism, and over so many partitions that one has about
    ``rows_each`` rows of its driving input (``probe``, a plain scan, counted from its footers; else ``df`` itself).

    Only when that input has fewer partitions: narrow rows pack by the million into one file split, and
    CPU-heavy row work after it would run in few long tasks. Otherwise it passes through untouched, no shuffle.
    ``merged``: ``df`` is a join of narrow rows whose shuffled partitions are merged by size, a few for millions of rows, however many
    its input had; it is dealt out whenever its rows are more than one task's.
    """
    given = probe if probe is not None else df
    rows = given.count()
    target = max(min_partitions or df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each))
    if (merged and rows > rows_each) or given.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back; ``discard`` deletes it. ``options``: of the write.

    Cuts lineage, and the planner knows the size of what it reads.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored``; others are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
