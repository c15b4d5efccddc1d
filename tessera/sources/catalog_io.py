"""Catalog files and tables: schema, JSON read/write, preview, scan."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixed

# The 10-field product record as it travels between crawl and load.
PRODUCT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in fixed.PRODUCT_FIELDS])

# The stored catalog table: the record plus load time and vector.
CATALOG_SCHEMA = T.StructType(PRODUCT_SCHEMA.fields + [
    T.StructField("updated_at", T.TimestampType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])


def write_products_json(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append product records as JSON lines, one folder per vendor (no de-dup on append)."""
    rows.select(*fixed.PRODUCT_FIELDS).write.mode(mode).partitionBy("vendor").json(path)


def read_products_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read product records by schema; unparseable records land in ``_corrupt_record``.

    ``multi_line=True`` reads a single JSON array file, the interchange form.
    """
    schema = T.StructType(PRODUCT_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE") \
                  .option("columnNameOfCorruptRecord", "_corrupt_record")
    if multi_line:
        reader = reader.option("multiLine", True)
    return reader.json(path)


def conform(df: DataFrame, schema: T.StructType = CATALOG_SCHEMA, extra=()) -> DataFrame:
    """Project and cast to the table schema (missing columns become nulls), plus ``extra`` columns."""
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return df.select(*cols, *extra)


def preview(df: DataFrame, n: int = 3, order_by: str = "product_id") -> DataFrame:
    """First n rows in a fixed order (a top-n, so only n rows reach the driver)."""
    return df.orderBy(order_by).limit(n)


def scan_catalog(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Full catalog scan with column pruning."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
