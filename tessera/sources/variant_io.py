"""Product records from JSON lines of any shape: Spark's VARIANT, unknown fields kept, drift of types reported, rejects with a reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Declared fields of a record: name, type.
FIELDS = [("product_id", "string"), ("material_name", "string"), ("price_cents", "bigint"), ("quality", "int"), ("tags", "array<string>")]
KEY = "product_id"
KINDS = [("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "text"), ("BOOLEAN", "boolean"), ("VOID", "null"), ("DATE", "date"), ("TIMESTAMP", "date"),
         ("BINARY", "binary")]


def kind(v: Column) -> Column:
    """object, array, text, number, boolean or null: what a variant holds; null for none."""
    shape = F.schema_of_variant(v)
    out = F.when(shape.isNotNull(), F.lit("number"))
    for prefix, name in reversed(KINDS):
        out = F.when(shape.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def field(name: str) -> Column:
    return F.try_variant_get(F.col("_v"), f"$.{name}", "variant")


def reason() -> Column:
    """Why a line is no record, null if it is one: empty, malformed, not_an_object, missing_key."""
    return (F.when(F.coalesce("value", F.lit("")).rlike(r"^\s*$"), F.lit("empty"))
            .when(F.col("_v").isNull(), F.lit("malformed"))
            .when(kind(F.col("_v")) != "object", F.lit("not_an_object"))
            .when(F.coalesce(F.try_variant_get(F.col("_v"), f"$.{KEY}", "string"), F.lit("")) == "", F.lit("missing_key")))


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (value) with ``_v``, the variant (null if it cannot be parsed), and ``reason``.

    The parser takes what a line begins with and lets anything follow. So a line is parsed as the one element of an
    array and as the value of an object: what follows breaks one of the two.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    whole = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit('{"x":'), "value", F.lit("}"))).isNotNull()
    return lines.withColumn("_v", F.when(whole, F.try_variant_get(alone, "$[0]", "variant"))).withColumn("reason", reason())


def records(lines: DataFrame, fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """The records: declared fields by their types, ``extra`` (unknown fields as a JSON object, null if there are none), ``extra_fields`` (their
    names in order) and ``bad_fields`` (declared fields that hold something else than their type; the value is null then).

    Numbers written as text count as numbers if they are whole.
    """
    fields = fields or FIELDS
    good = parsed(lines).where(F.col("reason").isNull())
    unknown = F.map_filter(F.try_variant_get(F.col("_v"), "$", "map<string,variant>"), lambda k, _: ~k.isin([n for n, _ in fields]))
    good = good.withColumn("_unknown", unknown)
    values = [F.try_variant_get(F.col("_v"), f"$.{n}", t).alias(n) for n, t in fields]
    bad = F.filter(F.array(*[F.when(F.coalesce(kind(field(n)), F.lit("null")) != "null", F.when(F.try_variant_get(F.col("_v"), f"$.{n}", t).isNull(), F.lit(n)))
                             for n, t in fields]), lambda x: x.isNotNull())
    names = F.array_sort(F.map_keys("_unknown"))
    return good.select(*values, F.when(F.size("_unknown") > 0, F.to_json("_unknown")).alias("extra"), names.alias("extra_fields"), bad.alias("bad_fields"))


def rejects(lines: DataFrame) -> DataFrame:
    """(value, reason) of the lines that are no records."""
    return parsed(lines).where(F.col("reason").isNotNull()).select("value", "reason")


def drift(lines: DataFrame, fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, declared, found, n): what the declared fields hold over all objects; ``found`` is ``missing`` where a field is not there."""
    fields = fields or FIELDS
    rows = parsed(lines).where(kind(F.col("_v")) == "object")
    held = F.array(*[F.struct(F.lit(n).alias("path"), F.lit(t).alias("declared"), F.coalesce(kind(field(n)), F.lit("missing")).alias("found")) for n, t in fields])
    return rows.select(F.inline(held)).groupBy("path", "declared", "found").agg(F.count("*").alias("n"))
