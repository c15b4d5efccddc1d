"""Catalog build: stored robots files, sitemaps and product pages -> keyed product rows.

Pages are read once: an Arrow-batched UDF gives the facts of a page, the rest are column
expressions, so a crawl of any size is one scan plus narrow projections; the only shuffles
are the de-dup by product id, the sitemap joins and the per-sitemap budget window.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.html import page_facts
from tessera.functions.text import title_words
from tessera.session import scratch_path

WS = r"[\s\x{00A0}]"
PRICE_RE = fixed.PRICE_PATTERN.replace(r"\s", WS)

def base_url(u: Column) -> Column:
    """scheme (default https) + '://' + host."""
    return F.concat(F.coalesce(F.nullif(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("")), F.lit("https")),
                    F.lit("://"), F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))


def region_from_host(u: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))
    expr = F.lit("Unknown")
    for suffix, region in reversed(fixed.HOST_REGIONS):
        expr = F.when(F.endswith(host, F.lit(suffix)), F.lit(region)).otherwise(expr)
    return expr


def robots_sitemaps(robots: DataFrame, body_col: str = "body") -> DataFrame:
    """Lines starting 'sitemap:' (any case) -> the value after the first colon, trimmed."""
    lines = robots.select("*", F.posexplode(F.split(F.col(body_col), r"\r?\n")).alias("line_no", "line"))
    return (lines.where(F.startswith(F.lower("line"), F.lit("sitemap:")))
                 .withColumn("sitemap_url", F.trim(F.expr("substring(line, instr(line, ':') + 1)")))
                 .drop(body_col, "line"))




SITEMAP_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"


def _sitemap(body: Column) -> Column:
    """A sitemap or sitemap index read as XML, whatever its prefixes, element order or CDATA."""
    return F.from_xml(body, SITEMAP_SCHEMA, {"ignoreNamespace": "true"})


def _locs(entries: Column) -> Column:
    locs = F.transform(entries, lambda e: F.trim(e["loc"]))
    return F.filter(locs, lambda x: F.coalesce(x, F.lit("")) != "")


def sitemap_children(body: Column) -> Column:
    """<sitemap><loc> entries of a sitemap index."""
    return _locs(_sitemap(body)["sitemap"])


def sitemap_locs(body: Column) -> Column:
    """<url><loc> entries of a sitemap (malformed input: null; ``sitemap_rejects`` lists it)."""
    return _locs(_sitemap(body)["url"])


def sitemap_rejects(bodies: DataFrame) -> DataFrame:
    """(url, reason) of the stored sitemaps that are empty or no well-formed XML."""
    empty = F.trim(F.coalesce("body", F.lit(""))) == ""
    reason = F.when(empty, F.lit("empty_body")).when(_sitemap(F.col("body"))["_corrupt_record"].isNotNull(), F.lit("malformed_xml"))
    return bodies.select("url", reason.alias("reason")).where(F.col("reason").isNotNull())


def expand_sitemaps(sitemaps: DataFrame, bodies: DataFrame) -> DataFrame:
    """Follow sitemap indexes down to url sitemaps of any depth: (supplier, sitemap_order, sitemap_url, seq, url).

    sitemaps: (supplier, sitemap_order, sitemap_url); bodies: (url, body) of fetched sitemaps.
    Every level is a join, written once; a sitemap met again under the same supplier and order
    is not followed again, so cycles end.
    """
    spark = sitemaps.sparkSession
    base = scratch_path(spark, f"sitemaps-{uuid.uuid4().hex}")
    b = bodies.select(F.col("url").alias("sitemap_url"), sitemap_locs(F.col("body")).alias("locs"),
                      sitemap_children(F.col("body")).alias("children"))
    key = ["supplier", "sitemap_order", "sitemap_url"]
    frontier, levels, level = sitemaps.select(*key).distinct(), None, 0
    while True:
        path = f"{base}/level={level}"
        frontier.join(b, "sitemap_url").write.parquet(path)
        found = spark.read.parquet(path)
        levels = found if levels is None else levels.unionByName(found)
        frontier = (found.select("supplier", "sitemap_order", F.explode("children").alias("sitemap_url")).distinct()
                         .join(levels.select(*key), key, "left_anti"))
        if frontier.isEmpty():
            break
        level += 1
    return levels.select(*key, F.posexplode("locs").alias("seq", "url"))


def is_product_page(url: Column, facts: Column) -> Column:
    """By its address, by a main heading with a price element, or by a text node with the cart text."""
    url_hit = F.coalesce(F.regexp_like(url, F.lit("(?i)" + fixed.PRODUCT_URL_PATTERN)), F.lit(False))
    return url_hit | (facts["has_h1"] & facts["has_price"]) | facts["has_cart"]


def product_title(html: Column) -> Column:
    return page_facts(html)["title"]


def price_text(html: Column) -> Column:
    """Text of the first price selector that has an element (possibly ''), else null."""
    return page_facts(html)["price_text"]


def plain_text(html: Column) -> Column:
    """Page text: script and style bodies, comments and tags left out, no separator."""
    return page_facts(html)["page_text"]


def clean_unit(u: Column) -> Column:
    """Unit text: drop 'soit' and 'Ajouter', 2 -> ², 3 -> ³, '/' prefix; empty stays empty."""
    x = F.replace(F.replace(u, F.lit("soit"), F.lit("")), F.lit("Ajouter"), F.lit(""))
    x = F.replace(F.replace(x, F.lit("2"), F.lit("²")), F.lit("3"), F.lit("³"))
    return F.when(F.coalesce(u, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("/"), x))


def first_price(text: Column) -> Column:
    """First price match as 'number €unit' (number with trailing ',' then '.' trimmed), else null."""
    return price_from_match(F.regexp_extract(text, PRICE_RE, 0))


def price_from_match(m: Column) -> Column:
    """Format one whole price match (group 0) as 'number €unit'; '' or null gives null."""
    num = F.btrim(F.btrim(F.regexp_extract(m, PRICE_RE, 1), F.lit(",")), F.lit("."))
    unit = F.regexp_extract(m, PRICE_RE, 2)
    return F.when(F.coalesce(m, F.lit("")) != "", F.concat(num, F.lit(" €"), clean_unit(unit)))


def price_parts(price: Column) -> tuple[Column, Column]:
    parts = F.split(price, " ")
    return F.get(parts, 0), F.get(parts, 1)


def extract_products(pages: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, rejects) from fetched pages.

    pages: (page_id, url, html, supplier, sitemap, seq), status already 200.
    suppliers: (supplier, url, ...). Product pages only; required fields
    name, price and url must be non-empty, the rest go to rejects.
    """
    sup = F.broadcast(suppliers.select("supplier", F.col("url").alias("supplier_url")))
    url = F.col("url")
    p = pages.withColumn("_f", page_facts(F.col("html"))).where(is_product_page(url, F.col("_f"))).join(sup, "supplier", "left")
    p = p.withColumn("_price", price_from_match(F.col("_f.price_match")))
    amount, unit = price_parts(F.col("_price"))
    rows = (p
              .select("page_id", "supplier", "sitemap", "sitemap_no", "seq",
                      F.concat_ws("|", F.col("supplier"), F.md5(url)).alias("product_id"),
                      F.col("_f.title").alias("material_name"),
                      F.lit(None).cast("string").alias("description"),
                      amount.alias("unit_price"), unit.alias("unit"),
                      region_from_host(F.col("supplier_url")).alias("region"),
                      title_words(F.col("supplier")).alias("vendor"),
                      F.lit(None).cast("string").alias("vat_rate"),
                      F.lit(None).cast("string").alias("quality_score"),
                      url.alias("source")))
    missing = (F.when(F.coalesce(F.col("material_name"), F.lit("")) == "", F.lit("missing_name"))
                .when(F.coalesce(F.col("unit_price"), F.lit("")) == "", F.lit("missing_price"))
                .when(F.coalesce(F.col("source"), F.lit("")) == "", F.lit("missing_url")))
    tagged = rows.withColumn("reject_reason", missing)
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull())
    return good, bad


def dedup_last(df: DataFrame, key: str = "product_id", order: list[str] | None = None) -> DataFrame:
    """One row per key, the last in ``order`` wins; rows without a key are left out.

    A ``max_by`` aggregation rather than a ranking window: it combines map-side,
    so a key repeated in a third of the rows is reduced in every task before
    the shuffle instead of being sorted in one.
    """
    order = order or ["seq"]
    cols = df.columns
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_r")).select(*[F.col("_r")[c].alias(c) for c in cols])


def row_budget(products: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per sitemap keep the first ``min_products`` rows; then take whole sitemaps in order
    while the running total before each sitemap is below the supplier budget.

    products: (supplier, sitemap, sitemap_order, seq, product_id, ...)
    budgets: (supplier, min_products)
    """
    # the largest budget is a literal bound, which lets Spark cut each sitemap's rows
    # map-side (WindowGroupLimit) before the shuffle
    top = budgets.agg(F.max("min_products")).first()[0] or 0
    p = products.join(budgets.select("supplier", "min_products"), "supplier")
    w = Window.partitionBy("supplier", "sitemap").orderBy("seq")
    kept = (p.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(top))
             .where(F.col("_rn") <= F.col("min_products")))
    counts = kept.groupBy("supplier", "sitemap", "sitemap_order", "min_products").agg(F.count("*").alias("_n"))
    ws = Window.partitionBy("supplier").orderBy("sitemap_order").rowsBetween(Window.unboundedPreceding, -1)
    take = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(ws), F.lit(0)))
                  .where(F.col("_before") < F.col("min_products")).select("supplier", "sitemap"))
    return kept.join(take, ["supplier", "sitemap"], "left_semi").drop("_rn", "min_products")


def upsert(target: DataFrame, batch: DataFrame, key: str = "product_id") -> DataFrame:
    """Keyed upsert: every non-key column replaced by the newest row.

    Both inputs carry ``batch_id`` and ``seq`` (file order); within a batch the
    last row wins, as rows applied one after another would.
    """
    both = target.unionByName(batch, allowMissingColumns=True)
    return dedup_last(both, key, ["batch_id", "seq"])


def upsert_rejects(batch: DataFrame, key: str = "product_id") -> DataFrame:
    """The rows of a batch that an upsert leaves out, with ``reject_reason``: those without a key."""
    return batch.where(F.col(key).isNull()).withColumn("reject_reason", F.lit("missing_key"))


def _load_reason() -> Column:
    return (F.when(F.coalesce("product_id", F.lit("")) == "", F.lit("missing_id"))
             .when(F.coalesce("material_name", F.lit("")) == "", F.lit("missing_name")))


def load_rejects(rows: DataFrame) -> DataFrame:
    """The rows that a bulk load leaves out, with ``reject_reason``."""
    return rows.withColumn("reject_reason", _load_reason()).where(F.col("reject_reason").isNotNull())


def load_products(rows: DataFrame, target: DataFrame | None, batch_id: int, encode=None) -> DataFrame:
    """Bulk load: embed each record (name + ':' + description), stamp the load time and
    upsert into the catalog by product id, in one job.

    rows: product records (``catalog_io.PRODUCT_SCHEMA``) with a ``seq`` column in
    file order; target: the current catalog (or None). ``encode(df, text_col)``
    adds ``embedding``; the default is the hashing encoder. Rows without an id or a
    name are not loaded; ``load_rejects`` lists them.
    """
    from tessera.operators import embed as E
    from tessera.sources import catalog_io as IO
    encode = encode or (lambda df, col: E.hashing_encoder(df, col))
    text = E.embedding_text(F.col("material_name"), F.col("description"))
    if "seq" not in rows.columns:
        raise ValueError("rows need a 'seq' column (file order) so the last duplicate wins")
    usable = rows.where(_load_reason().isNull())
    staged = encode(usable.withColumn("_text", text), "_text").drop("_text")
    staged = IO.conform(staged.withColumn("updated_at", F.current_timestamp()),
                        extra=[F.lit(batch_id).alias("batch_id"), F.col("seq")])
    if target is None:
        return dedup_last(staged, "product_id", ["batch_id", "seq"])
    return upsert(target, staged)
