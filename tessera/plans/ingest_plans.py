"""Registered queries over product records as raw JSON lines, and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import variant_io as V
from tessera.sources.tables import read_table


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each part; by part key with fields of other types, missing or unknown, cut short, no object, or empty."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    price = (F.when(k % 11 == 1, F.lit('"on request"')).when(k % 11 == 2, F.concat(F.lit('"'), cents, F.lit('"'))).otherwise(cents))
    name = F.when(k % 11 == 5, F.lit("")).otherwise(F.concat(F.lit('"product_id":"p'), k.cast("string"), F.lit('",')))
    extra = F.when(k % 11 == 3, F.lit(',"colour":"red","dims":{"w":3}')).otherwise(F.lit(""))
    quality = F.when(k % 11 == 7, F.lit("null")).otherwise(F.col("p_size").cast("string"))
    tags = F.when(k % 11 == 8, F.lit('{"a":1}')).otherwise(F.lit('["new","sale"]'))
    line = F.concat(F.lit("{"), name, F.lit('"material_name":"'), F.col("p_name"), F.lit('","price_cents":'), price, F.lit(',"quality":'), quality,
                    F.lit(',"tags":'), tags, extra, F.lit("}"))
    line = F.when(k % 23 == 0, F.lit(" ")).when(k % 11 == 4, F.substring(line, 1, 30)).when(k % 11 == 6, F.lit("[1,2]")).otherwise(line)
    return part.select(line.alias("value"))


_LINES = """v_p AS (SELECT p_partkey AS k, p_name, p_size, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS cents FROM part),
v_l AS (SELECT k, '{' || CASE WHEN k % 11 = 5 THEN '' ELSE '"product_id":"p' || k || '",' END || '"material_name":"' || p_name || '","price_cents":'
  || CASE k % 11 WHEN 1 THEN '"on request"' WHEN 2 THEN '"' || cents || '"' ELSE cents END
  || ',"quality":' || CASE WHEN k % 11 = 7 THEN 'null' ELSE CAST(p_size AS VARCHAR) END
  || ',"tags":' || CASE WHEN k % 11 = 8 THEN '{"a":1}' ELSE '["new","sale"]' END
  || CASE WHEN k % 11 = 3 THEN ',"colour":"red","dims":{"w":3}' ELSE '' END || '}' AS line FROM v_p),
v_lines AS (SELECT CASE WHEN k % 23 = 0 THEN ' ' WHEN k % 11 = 4 THEN substr(line, 1, 30) WHEN k % 11 = 6 THEN '[1,2]' ELSE line END AS value FROM v_l),
v_r AS (SELECT value, CASE WHEN trim(value) = '' THEN 'empty' WHEN NOT json_valid(value) THEN 'malformed'
    WHEN json_type(value) <> 'OBJECT' THEN 'not_an_object' WHEN coalesce(json_extract_string(value, '$.product_id'), '') = '' THEN 'missing_key' END AS reason
  FROM v_lines),
v_o AS (SELECT CASE WHEN json_valid(value) THEN value END AS value, reason FROM v_r)"""


def ingest_variant(spark, sf_dir):
    """Records of the raw lines: fields by type, names of unknown and of ill-typed fields."""
    r = V.records(json_lines(spark, sf_dir))
    return r.select("product_id", "material_name", "price_cents", "quality", F.coalesce(F.array_size("tags"), F.lit(0)).cast("int").alias("n_tags"),
                    "extra", F.array_join("extra_fields", ",").alias("extra_fields"), F.array_join("bad_fields", ",").alias("bad_fields"))


def ingest_rejects(spark, sf_dir):
    """Raw lines that are no records, with the reason."""
    return V.rejects(json_lines(spark, sf_dir))


def ingest_drift(spark, sf_dir):
    """What each declared field holds over all records."""
    return V.drift(json_lines(spark, sf_dir))


_KIND = "CASE {0} WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"

QUERIES = {"ingest_variant": ingest_variant, "ingest_rejects": ingest_rejects, "ingest_drift": ingest_drift}

SQL = {
    "ingest_variant": f"""WITH {_LINES}
SELECT json_extract_string(value, '$.product_id') AS product_id, json_extract_string(value, '$.material_name') AS material_name,
       TRY_CAST(json_extract_string(value, '$.price_cents') AS BIGINT) AS price_cents, TRY_CAST(json_extract_string(value, '$.quality') AS INTEGER) AS quality,
       CAST(CASE WHEN json_type(value, '$.tags') = 'ARRAY' THEN json_array_length(value, '$.tags') ELSE 0 END AS INTEGER) AS n_tags,
       CASE WHEN json_exists(value, '$.colour') THEN '{{"colour":' || CAST(json_extract(value, '$.colour') AS VARCHAR) || ',"dims":' || CAST(json_extract(value, '$.dims') AS VARCHAR) || '}}' END AS extra,
       CASE WHEN json_exists(value, '$.colour') THEN 'colour,dims' ELSE '' END AS extra_fields,
       array_to_string(list_filter([CASE WHEN TRY_CAST(json_extract_string(value, '$.price_cents') AS BIGINT) IS NULL THEN 'price_cents' END,
                                    CASE WHEN json_type(value, '$.tags') <> 'ARRAY' THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS bad_fields
FROM v_o WHERE reason IS NULL""",
    "ingest_rejects": f"WITH {_LINES} SELECT value, reason FROM v_r WHERE reason IS NOT NULL",
    "ingest_drift": f"""WITH {_LINES}, f AS (SELECT unnest(['product_id', 'material_name', 'price_cents', 'quality', 'tags']) AS path,
  unnest(['string', 'string', 'bigint', 'int', 'array<string>']) AS declared),
x AS (SELECT path, declared, json_type(value, '$.' || path) AS t FROM v_o, f WHERE value IS NOT NULL AND json_type(value) = 'OBJECT')
SELECT path, declared, coalesce({_KIND.format('t')}, 'missing') AS found, count(*) AS n FROM
  (SELECT path, declared, t FROM x WHERE t IS NOT NULL) GROUP BY ALL
UNION ALL SELECT path, declared, 'missing', count(*) FROM x WHERE t IS NULL GROUP BY ALL""",
}
