"""Structured Streaming forms of the feedback, upsert and lookup flows.

Every job reads a file stream, keeps its checkpoint and output in the shared
folder named by ``spark.checkpoint.dir`` and writes idempotently per
micro-batch, so a lost executor or a restarted driver replays batches without
duplicating output. A job takes the files present (``availableNow``), waits for
them and returns its output so far; called again with the same folders it goes on
with the files that came since. ``files_per_batch`` splits what is present into
micro-batches.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import catalog as C
from tessera.operators import feedback as FB
from tessera.operators import match as M


def deliveries(df: DataFrame, path: str, order_col: str, n: int) -> Iterator[None]:
    """Let ``df`` arrive under ``path`` in ``n`` deliveries by ``order_col``, in as many files as Spark writes.

    Every row goes into exactly one delivery (equal parts of the range of an integer or time column); a row without
    an order value comes with the first. A stream run after each delivery takes what arrived
    as one micro-batch, so the order of files within a delivery does not matter.
    """
    key = F.col(order_col)
    if df.schema[order_col].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        key = F.unix_micros(key.cast("timestamp"))
    bounds = df.select(key.alias("k")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    part = F.least(F.coalesce(F.floor((key - F.lit(lo)) / F.lit((hi - lo) // n + 1)), F.lit(0)), F.lit(n - 1)).cast("int")
    df.withColumn("_part", part).write.partitionBy("_part").parquet(f"{path}-parts")
    parts = df.sparkSession.read.schema(T.StructType(df.schema.fields + [T.StructField("_part", T.IntegerType())])).parquet(f"{path}-parts")
    for i in range(n):
        parts.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(path)
        yield


def run_available(writer):
    """Run a stream over the files present (``availableNow``) and wait for it; a failure is raised."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _files(spark: SparkSession, src: str, schema, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(src)


def daily_feedback_counts(spark: SparkSession, src: str, schema, out: str, ckpt: str,
                          watermark: str = "1 day", mode: str = "complete", files_per_batch: int | None = 1) -> DataFrame:
    """Tumbling daily counts per verdict with a watermark.

    ``complete``: the final state equals the batch counts. ``append``: a day is
    written once the watermark passes its end, rows later than the watermark
    are dropped, and days still open at the end are withheld.
    """
    stream = (_files(spark, src, schema, files_per_batch)
              .withColumn("created_ts", F.col("created_at").cast("timestamp"))
              .withWatermark("created_ts", watermark))
    counts = stream.groupBy(F.window("created_ts", "1 day"), "verdict").agg(F.count("*").alias("n"))

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.to_date(F.col("window.start")).alias("day"), "verdict", "n")
        if mode == "complete":
            rows.write.mode("overwrite").parquet(out)          # each batch is the full result
        else:
            rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")   # idempotent on replay
    run_available(counts.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(sink))
    try:
        res = spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "day date, verdict string, n long")  # nothing emitted yet
    return res.drop("epoch") if "epoch" in res.columns else res


def dedup_valid_feedback(spark: SparkSession, src: str, schema, out: str, ckpt: str,
                         watermark: str = "1 day", files_per_batch: int | None = 1) -> DataFrame:
    """Drop repeated events within the watermark, validate, append accepted records."""
    stream = (_files(spark, src, schema, files_per_batch)
              .withColumn("created_ts", F.col("created_at").cast("timestamp"))
              .withWatermark("created_ts", watermark)
              .dropDuplicatesWithinWatermark(["event_id"]))
    valid = FB.validate(stream).where("status = 'accepted'").drop("created_ts")
    run_available(valid.writeStream.format("parquet").outputMode("append")
                       .option("checkpointLocation", ckpt).option("path", out))
    return spark.read.parquet(out)


def upsert_stream(spark: SparkSession, src: str, schema, base: str, ckpt: str, initial: DataFrame | None = None,
                  key: str = "product_id", buckets: int = 16) -> DataFrame:
    """Apply each micro-batch of updates to the table with the keyed upsert.

    The table is kept in hash buckets of the key; a batch rewrites only the buckets it has
    keys of, as ``bucket=b/epoch=n`` read from that bucket's newest version before ``n``
    (``epoch=-1`` is ``initial``, given on the first call). A replayed batch rewrites its own
    versions from the same earlier ones, and no path is overwritten while it is being read.
    """
    schema_out = _schema(schema)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    versioned = T.StructType(schema_out.fields + [T.StructField("bucket", T.IntegerType()), T.StructField("epoch", T.LongType())])

    def newest(before: int | None = None) -> DataFrame:
        table = spark.read.schema(versioned).option("basePath", base).parquet(base)
        if before is not None:
            table = table.where(F.col("epoch") < before)
        # (bucket, epoch) pairs of rows: buckets x epochs at most
        last = F.broadcast(table.groupBy("bucket").agg(F.max("epoch").alias("epoch")))
        return table.join(last, ["bucket", "epoch"], "left_semi")

    def write(rows: DataFrame, epoch: int) -> None:
        (rows.withColumns({"bucket": bucket, "epoch": F.lit(epoch).cast("long")}).repartition("bucket")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(base))

    def apply(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*schema_out.names)
        touched = F.broadcast(rows.select(bucket.alias("bucket")).distinct())  # at most ``buckets`` rows
        before = newest(epoch).join(touched, "bucket", "left_semi").select(*schema_out.names)
        write(C.upsert(before, rows, key), epoch)
    if initial is not None:
        write(initial.select(*schema_out.names), -1)
    run_available(spark.readStream.schema(schema).parquet(src).writeStream
                  .option("checkpointLocation", ckpt).foreachBatch(apply))
    return newest().select(*schema_out.names)


def _schema(schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def lookup_stream(spark: SparkSession, src: str, schema, catalog: DataFrame | M.PackedCatalog, out: str, ckpt: str,
                  cfg: M.MatchConfig | None = None, finish: Callable[[DataFrame], DataFrame] | None = None,
                  files_per_batch: int | None = 1) -> DataFrame:
    """Stream of lookups scored against the static catalog inside foreachBatch
    (ranking windows are not allowed on streams, they are per batch here).

    The catalog is packed once for every micro-batch; a caller that runs the job more than
    once gives its own ``PackedCatalog`` and releases it.
    """
    own = not isinstance(catalog, M.PackedCatalog)
    packed = M.PackedCatalog(catalog, cfg) if own else catalog

    def score(batch: DataFrame, epoch: int) -> None:
        search = M.Search(batch, packed, cfg)
        hits = search.hits()
        res = finish(hits) if finish else hits
        res.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        search.close()
    try:
        run_available(_files(spark, src, schema, files_per_batch).writeStream
                      .option("checkpointLocation", ckpt).foreachBatch(score))
    finally:
        if own:
            packed.unpersist()
    return spark.read.parquet(out).drop("epoch")
