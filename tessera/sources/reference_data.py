"""Small configuration tables: rate card, city multipliers, VAT keywords,
task templates and supplier configs.

Each reader takes an optional path of any store that Spark reads. Without a path,
or where nothing is stored at it, the fixed defaults hold; a file that is there but
cannot be read or parsed is an error. The tables are configuration (a handful of
rows), so operators may broadcast them.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import capitalize

RATE_CARD_SCHEMA = "item string, unit string, cost double"
CITY_SCHEMA = "city string, multiplier double"
VAT_SCHEMA = "priority int, keyword string, rate double"
TEMPLATE_SCHEMA = "task_name string, default_hours double, default_material string, default_qty double"
SUPPLIER_SCHEMA = "supplier string, url string, sitemap_urls array<string>, min_products int"


def _text(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The whole file as one row, or None if no path is given or nothing is there."""
    if not path:
        return None
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _json_entries(raw: DataFrame, value: str, *names: str) -> DataFrame:
    """One row per entry of a JSON object file, with its position; malformed JSON is an error."""
    parsed = F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"})
    return raw.select(F.posexplode(parsed).alias(*names))


def rate_card(spark: SparkSession, path: str | None = None) -> DataFrame:
    """item -> (unit, cost) from a JSON object file; a missing cost is 0."""
    raw = _text(spark, path)
    if raw is None:
        return spark.createDataFrame(list(fixed.RATE_CARD), RATE_CARD_SCHEMA)
    items = _json_entries(raw, "struct<unit:string,cost:double>", "pos", "item", "v")
    return items.select("item", F.col("v.unit").alias("unit"), F.coalesce("v.cost", F.lit(0.0)).alias("cost"))


def city_modifiers(spark: SparkSession, path: str | None = None) -> DataFrame:
    """city -> multiplier from a JSON object file (keys capitalised)."""
    raw = _text(spark, path)
    if raw is None:
        return spark.createDataFrame(list(fixed.CITY_MODIFIERS), CITY_SCHEMA)
    return _json_entries(raw, "double", "pos", "city", "multiplier").select(capitalize(F.col("city")).alias("city"), "multiplier")


def vat_rates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(priority, keyword lowercased, rate); file order is the priority."""
    raw = _text(spark, path)
    if raw is None:
        return spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(fixed.VAT_RATES)], VAT_SCHEMA)
    return _json_entries(raw, "double", "priority", "keyword", "rate").select(
        F.col("priority").cast("int"), F.lower("keyword").alias("keyword"), "rate")


def task_templates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Task templates from a CSV file with a header row."""
    if not path:
        return spark.createDataFrame(list(fixed.TASK_TEMPLATES), TEMPLATE_SCHEMA)
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)  # columns by name, in any order
    return rows.select("task_name", F.col("default_hours").cast("double"), "default_material", F.col("default_qty").cast("double"))


def suppliers(spark: SparkSession, paths: list[str] | None = None) -> DataFrame:
    """Supplier dimension from YAML configs (one document per supplier), else the fixed list."""
    if not paths:
        return spark.createDataFrame([tuple(s) for s in fixed.SUPPLIERS], SUPPLIER_SCHEMA)
    import yaml
    rows = []
    for r in spark.read.text(list(paths), wholetext=True).collect():  # one small config per path given
        cfg = yaml.safe_load(r["value"])
        rows.append((cfg["supplier"], cfg.get("url"), list(cfg.get("sitemap_urls") or []),
                     int((cfg.get("output") or {}).get("min_products", fixed.DEFAULT_MIN_PRODUCTS))))
    return spark.createDataFrame(rows, SUPPLIER_SCHEMA)
