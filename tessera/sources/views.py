"""Domain views over the input tables.

The input tables carry none of the renovation vocabulary, so these views
derive catalog products, lookup queries, job transcripts, product pages and
feedback from them with plain, deterministic expressions. Every view reads
whole tables; its size grows with theirs. ``tessera.plans.oracle`` holds the
same definitions as DuckDB SQL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.plan import materialize, spread
from tessera.functions.text import parse_price_fr
from tessera.sources.tables import read_table

SHOP_URL = "https://shop.example.com/p/"
UNITS = ["€", "€/m²", "€/sqm"]
UNKNOWN_REGION = "ATLANTIS"
PAGES_EACH = 1000  # pages of a task, about: Python takes in those of a task at once


def row_count(spark: SparkSession, sf_dir: str, name: str) -> Column:
    """Row count of a table as a scalar subquery (resolved by the optimizer, no action)."""
    return read_table(spark, sf_dir, name).select(F.count("*")).scalar()


def _pick(options: list[str], key: Column) -> Column:
    """options[key mod len], 0-based key."""
    return F.element_at(F.array(*[F.lit(o) for o in options]),
                        (key % len(options)).cast("int") + 1)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog products: part x embeddings x supplier x nation x region.

    Each part takes the vector ``vec_id = p_partkey mod |embeddings|`` and the
    supplier ``s_suppkey = p_partkey mod |supplier|``.
    """
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    n_vec = row_count(spark, sf_dir, "embeddings")
    n_supp = row_count(spark, sf_dir, "supplier")
    p = (part.withColumn("vec_key", F.col("p_partkey") % n_vec)
             .withColumn("supp_key", F.col("p_partkey") % n_supp))
    source = F.concat(F.lit(SHOP_URL), F.col("p_partkey").cast("string"))
    unit_price = F.replace(F.format_string("%.2f", F.col("p_retailprice")), F.lit("."), F.lit(","))
    out = (p.join(emb, p.vec_key == emb.vec_id)
            .join(supp, p.supp_key == supp.s_suppkey)
            .join(nation, supp.s_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                F.concat(F.col("s_name"), F.lit("|"), F.md5(source)).alias("product_id"),
                F.col("p_name").alias("material_name"),
                F.col("p_type").alias("description"),
                unit_price.alias("unit_price"),
                _pick(UNITS, F.col("p_size")).alias("unit"),
                F.col("r_name").alias("region"),
                F.col("s_name").alias("vendor"),
                F.lit(None).cast("string").alias("vat_rate"),
                F.col("label").cast("string").alias("quality_score"),
                F.expr("cast(date_add(date'2024-01-01', cast(p_partkey % 60 as int)) as timestamp_ntz)")
                 .alias("updated_at"),
                source.alias("source"),
                F.col("embedding"),
                F.col("p_type").alias("category"),
                F.col("p_partkey").alias("partkey"),
            ))
    return spread(out.withColumn("price_value", parse_price_fr(F.col("unit_price"))), probe=part)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup queries, one per embedding row.

    Vector: v[i] + 0.5 * v[(i + 1) mod n]. Region filter by ``i mod 7``
    (0: none, 1: a region with no product, 2: empty string, else a real
    region), vendor filter when ``i mod 11 = 3``, limit 3 / 10 / 5 by
    ``i mod 9``, empty text and vector when ``i mod 13 = 5``.
    """
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    n_vec = row_count(spark, sf_dir, "embeddings")
    n_supp = row_count(spark, sf_dir, "supplier")
    nxt = emb.select(F.col("vec_id").alias("nxt_id"), F.col("embedding").alias("nxt_emb"))
    i = F.col("vec_id")
    empty = (i % 13) == 5
    base = (emb.join(nxt, ((i + 1) % n_vec) == nxt.nxt_id)
               .withColumn("region_key", i % 5)
               .withColumn("vendor_key", F.when((i % 11) == 3, i % n_supp)))
    return (base.join(region, base.region_key == region.r_regionkey, "left")
                .join(supp, base.vendor_key == supp.s_suppkey, "left")
                .select(
                    i.alias("query_id"),
                    F.when(empty, F.lit("")).otherwise(F.concat(F.lit("material "), i.cast("string")))
                     .alias("query"),
                    F.when((i % 7) == 0, F.lit(None).cast("string"))
                     .when((i % 7) == 1, F.lit(UNKNOWN_REGION))
                     .when((i % 7) == 2, F.lit(""))
                     .otherwise(F.col("r_name")).alias("region"),
                    F.col("s_name").alias("vendor"),
                    F.when((i % 9) == 4, F.lit(3)).when((i % 9) == 5, F.lit(10))
                     .otherwise(F.lit(5)).alias("q_limit"),
                    F.when(empty, F.array().cast("array<double>"))
                     .otherwise(V.blend(F.col("embedding"), F.col("nxt_emb"), 0.5)).alias("embedding"),
                ))


# Transcript phrase pools (ours): picked by key mod pool size.
T_INTROS = ["Need to ", "Client wants to ", "Quote to "]
T_TASKS = [
    "retile the bathroom floor with white ceramic tile",
    "repaint the living room walls with matte paint",
    "redo the shower plumbing and replace the toilet",
    "remove the old tiles, install a new vanity and sink",
    "finish a kitchen renovation with oak parquet flooring and wood plinth",
    "fix the terrace: cement, joint and waterproof glue",
]
T_VENDORS = ["", " from Castorama", " from Leroy Merlin", " at ManoMano", " from Bricodepot"]
T_CITIES = [" in Paris", " in Lyon", " in Marseille", " near Cairo", ""]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job transcripts, one per order (proposal_id = o_orderkey).

    Text = intro + task + area + vendor + [price comparison] + city + [budget] + '.'
    with pools picked by o_orderkey (intro mod 3, task mod 6, area mod 37 with 0
    meaning none, vendor mod 5, budget when mod 4 = 0, comparison when
    o_custkey mod 9 = 0) and the city by c_nationkey mod 5.
    """
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    area_n = k % 37
    text = F.concat(
        _pick(T_INTROS, k), _pick(T_TASKS, k),
        F.when(area_n > 0, F.concat(F.lit(", about "), area_n.cast("string"), F.lit(" m2")))
         .otherwise(F.lit(", size unknown")),
        _pick(T_VENDORS, k),
        F.when(F.col("o_custkey") % 9 == 0, F.lit(" with a price comparison")).otherwise(F.lit("")),
        _pick(T_CITIES, F.col("c_nationkey")),
        F.when(k % 4 == 0, F.lit(" on a tight budget")).otherwise(F.lit("")),
        F.lit("."))
    base = spread(orders.join(cust, orders.o_custkey == cust.c_custkey)
                        .select("o_orderkey", "o_custkey", "c_nationkey"), probe=orders, merged=True)
    return materialize(base, transcript=text).select(k.alias("proposal_id"), "transcript")


SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
SITEMAP_SIZE = 50          # urls per sitemap file
INDEX_SIZE = 1000          # sitemaps per index file


def _supplier_url(supplier: Column) -> Column:
    from tessera import fixed
    expr = F.lit(None).cast("string")
    for name, url, _, _ in fixed.SUPPLIERS:
        expr = F.when(supplier == F.lit(name), F.lit(url)).otherwise(expr)
    return expr


def price_display(price: Column) -> Column:
    """French display of a price: '901,01', with a '.' thousands group from 1000 on."""
    whole = F.floor(price).cast("long")
    cents = F.lpad((F.round(price * 100).cast("long") % 100).cast("string"), 2, "0")
    return F.when(whole >= 1000,
                  F.concat((whole / 1000).cast("long").cast("string"), F.lit("."),
                           F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","), cents)) \
            .otherwise(F.concat(whole.cast("string"), F.lit(","), cents))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored product pages: the page table with a price block spliced before </article>.

    page_id mod 4: 0 span.price, 1 .product-price with 'soit', 2 price in plain
    text only, 3 no price. An add-to-cart button when page_id mod 3 = 0.
    Supplier by page_id mod 3, status 404 when page_id mod 17 = 0, sitemap
    number page_id div 50.
    """
    from tessera import fixed
    pg = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    p = spread(pg.join(part, pg.page_id == part.p_partkey, "left"), probe=pg, rows_each=PAGES_EACH)
    i = F.col("page_id")
    txt = price_display(F.col("p_retailprice"))
    block = (F.when(i % 4 == 0, F.concat(F.lit('<span class="price">'), txt, F.lit(" €/m2</span>")))
              .when(i % 4 == 1, F.concat(F.lit('<div class="product-price">soit '), txt, F.lit(" € / m2</div>")))
              .when(i % 4 == 2, F.concat(F.lit("<p>Prix "), txt, F.lit(" € / m2</p>")))
              .otherwise(F.lit("")))
    block = F.coalesce(block, F.lit(""))
    cart = F.when(i % 3 == 0, F.lit("<button>Ajouter au panier</button>")).otherwise(F.lit(""))
    supplier = _pick([s[0] for s in fixed.SUPPLIERS], i)
    sitemap_no = F.expr("page_id div 50")
    p = materialize(p.withColumnRenamed("html", "raw_html"),
                    html=F.replace(F.col("raw_html"), F.lit("</article>"), F.concat(block, cart, F.lit("</article>"))))
    return p.select(
        "page_id", "url", "html",
        supplier.alias("supplier"),
        F.when(i % 17 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        sitemap_no.alias("sitemap_no"),
        F.concat(_supplier_url(supplier), F.lit("sitemaps/"), supplier, F.lit("-"),
                 sitemap_no.cast("string"), F.lit(".xml")).alias("sitemap"),
        i.alias("seq"))


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sitemap files (url, body, supplier): url sitemaps of at most 50 pages
    and index files of at most 1000 sitemaps, namespaced XML."""
    pg = pages(spark, sf_dir)
    urlsets = (pg.groupBy("supplier", "sitemap", "sitemap_no")
                 .agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("items"))
                 .select(F.col("sitemap").alias("url"), "supplier", "sitemap_no",
                         F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{SITEMAP_NS}">'),
                                  F.array_join(F.transform("items", lambda x: F.concat(
                                      F.lit("<url><loc>"), _xml_escape(x["url"]), F.lit("</loc></url>"))), ""),
                                  F.lit("</urlset>")).alias("body")))
    idx_no = F.expr(f"sitemap_no div {INDEX_SIZE}")
    sup_url = _supplier_url(F.col("supplier"))
    index = (urlsets.withColumn("index_no", idx_no)
                    .groupBy("supplier", "index_no")
                    .agg(F.array_sort(F.collect_list(F.struct("sitemap_no", "url"))).alias("items"))
                    .select(F.concat(sup_url, F.lit("sitemaps/"), F.col("supplier"), F.lit("-index-"),
                                     F.col("index_no").cast("string"), F.lit(".xml")).alias("url"),
                            "supplier",
                            F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{SITEMAP_NS}">'),
                                     F.array_join(F.transform("items", lambda x: F.concat(
                                         F.lit("<sitemap><loc>"), x["url"], F.lit("</loc></sitemap>"))), ""),
                                     F.lit("</sitemapindex>")).alias("body"),
                            F.col("index_no")))
    return urlsets.select("url", "supplier", "body").unionByName(index.select("url", "supplier", "body"))


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt per supplier: a user-agent line plus one 'Sitemap:' line per index file."""
    pg = pages(spark, sf_dir)
    idx = pg.select("supplier", F.expr(f"sitemap_no div {INDEX_SIZE}").alias("index_no")).distinct()
    sup_url = _supplier_url(F.col("supplier"))
    lines = idx.select("supplier", "index_no",
                       F.concat(F.lit("Sitemap: "), sup_url, F.lit("sitemaps/"), F.col("supplier"),
                                F.lit("-index-"), F.col("index_no").cast("string"), F.lit(".xml")).alias("line"))
    return (lines.groupBy("supplier")
                 .agg(F.array_sort(F.collect_list(F.struct("index_no", "line"))).alias("items"))
                 .select("supplier", F.concat(sup_url, F.lit("robots.txt")).alias("url"),
                         F.concat(F.lit("User-agent: *\nDisallow: /checkout\n"),
                                  F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("body")))


VERDICT_BY_EVENT = [("purchase", "accepted"), ("signup", "accepted"), ("error", "rejected"),
                    ("view", "rejected"), ("click", "modified")]


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records, one per event, on the quote of order ``event_id mod |orders|``.

    verdict by event type, user type by user_id parity ('supplier', which is
    invalid, when user_id mod 10 = 7), no verdict when event_id mod 23 = 0,
    comment = props, created_at = ts.
    """
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    n_orders = row_count(spark, sf_dir, "orders")
    verdict = F.lit(None).cast("string")
    for et, v in reversed(VERDICT_BY_EVENT):
        verdict = F.when(F.col("event_type") == et, F.lit(v)).otherwise(verdict)
    pid = F.col("event_id") % n_orders
    qid = F.md5(F.concat(F.lit("quote:"), pid.cast("string")))
    return ev.select(
        "event_id",
        pid.alias("proposal_id"),
        qid.alias("quote_id"),
        F.concat(qid, F.lit(":0")).alias("task_id"),
        F.when(F.col("user_id") % 10 == 7, F.lit("supplier"))
         .when(F.col("user_id") % 2 == 0, F.lit("contractor")).otherwise(F.lit("client")).alias("user_type"),
        F.when(F.col("event_id") % 23 == 0, F.lit(None).cast("string")).otherwise(verdict).alias("verdict"),
        F.col("props").alias("comment"),
        F.col("ts").alias("created_at"))
