"""Registered catalog-build queries (robots, sitemaps, pages -> product rows) and oracles."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.html import page_facts
from tessera.operators import catalog as C
from tessera.operators import embed as E
from tessera.plans import oracle_catalog as OC
from tessera.plans import oracle_views as OV
from tessera.plans.oracle_rules import q
from tessera.session import scratch_path
from tessera.sources import catalog_io as IO
from tessera.sources import reference_data as RD
from tessera.sources import views


def _ok_pages(spark, sf_dir):
    return views.pages(spark, sf_dir).where(F.col("status") == 200)


def page_source(spark, sf_dir):
    return _ok_pages(spark, sf_dir).select("page_id", "url", "supplier")


def supplier_dim(spark, sf_dir):
    sup = RD.suppliers(spark)
    counts = _ok_pages(spark, sf_dir).groupBy("supplier").agg(F.count("*").alias("n_pages"))
    return (counts.join(F.broadcast(sup), "supplier")
                  .select("supplier", C.base_url(F.col("url")).alias("base_url"),
                          C.region_from_host(F.col("url")).alias("region"), "min_products", "n_pages"))


def robots_sitemaps(spark, sf_dir):
    r = C.robots_sitemaps(views.robots_files(spark, sf_dir))
    return r.select("supplier", "sitemap_url")


def sitemap_locs(spark, sf_dir):
    robots = C.robots_sitemaps(views.robots_files(spark, sf_dir))
    roots = robots.select("supplier", F.col("line_no").alias("sitemap_order"), "sitemap_url")
    files = views.sitemap_files(spark, sf_dir)
    locs = C.expand_sitemaps(roots, files)
    # a URL of a supplier counts where it stands first
    first = F.min(F.struct("sitemap_order", "sitemap_url", "seq")).alias("f")
    return (locs.groupBy("supplier", "url").agg(first)
                .select("supplier", F.col("f.sitemap_url").alias("sitemap"), "url", F.col("f.seq").cast("int").alias("seq")))


def product_page_filter(spark, sf_dir):
    p = _ok_pages(spark, sf_dir)
    return p.select("page_id", C.is_product_page(F.col("url"), page_facts(F.col("html"))).alias("is_product"))


def product_title(spark, sf_dir):
    p = _ok_pages(spark, sf_dir)
    return p.select("page_id", C.product_title(F.col("html")).alias("title"))


def price_text(spark, sf_dir):
    p = _ok_pages(spark, sf_dir)
    return p.select("page_id", C.price_text(F.col("html")).alias("price_text"))


def _extracted(spark, sf_dir):
    return C.extract_products(_ok_pages(spark, sf_dir), RD.suppliers(spark))


def price_extract(spark, sf_dir):
    good, bad = _extracted(spark, sf_dir)
    return good.unionByName(bad.drop("reject_reason")).select("page_id", "unit_price", "unit")


PRODUCT_COLUMNS = ["product_id", "material_name", "description", "unit_price", "unit", "region", "vendor",
                   "vat_rate", "quality_score", "source"]


def product_rows(spark, sf_dir):
    good, _ = _extracted(spark, sf_dir)
    return C.dedup_last(good).select(*PRODUCT_COLUMNS)


def rejects_report(spark, sf_dir):
    _, bad = _extracted(spark, sf_dir)
    return bad.select("page_id", "supplier", "reject_reason")


def row_budget(spark, sf_dir):
    good, _ = _extracted(spark, sf_dir)
    good = good.withColumn("sitemap_order", F.col("sitemap_no")) if "sitemap_no" in good.columns else good
    budgets = RD.suppliers(spark).select("supplier", "min_products")
    kept = C.row_budget(good, budgets)
    return C.dedup_last(kept, "product_id", ["sitemap_order", "seq"]).select("supplier", "sitemap", "product_id")


def catalog_roundtrip(spark, sf_dir):
    """Write product rows as JSON (append, partitioned by vendor) and read them back by schema."""
    good, _ = _extracted(spark, sf_dir)
    rows = C.dedup_last(good).select(*PRODUCT_COLUMNS)
    path = scratch_path(spark, f"catalog-json-{uuid.uuid4().hex}")
    IO.write_products_json(rows, path)
    return IO.read_products_json(spark, path).select(*PRODUCT_COLUMNS)


def catalog_preview(spark, sf_dir):
    good, _ = _extracted(spark, sf_dir)
    return IO.preview(C.dedup_last(good).select(*PRODUCT_COLUMNS), 3)


def _batches(spark, sf_dir):
    """Two staged batches over the whole catalog: batch 0 every product, batch 1 a price
    update for every third product, written twice in file order (the later copy wins)."""
    cat = views.products(spark, sf_dir).select("product_id", "unit_price", "partkey", "price_value")
    b0 = cat.select("product_id", "unit_price", F.lit(0).alias("batch_id"), (F.col("partkey") * 2).alias("seq"))
    upd = cat.where(F.col("partkey") % 3 == 0)
    first = upd.select("product_id", views.price_display(F.col("price_value") * 1.1).alias("unit_price"),
                       F.lit(1).alias("batch_id"), (F.col("partkey") * 2).alias("seq"))
    second = upd.select("product_id", views.price_display(F.col("price_value") * 1.2).alias("unit_price"),
                        F.lit(1).alias("batch_id"), (F.col("partkey") * 2 + 1).alias("seq"))
    return b0, first.unionByName(second)


def catalog_upsert(spark, sf_dir):
    b0, b1 = _batches(spark, sf_dir)
    return C.upsert(b0, b1).select("product_id", "unit_price", "batch_id")


def upsert_rejects(spark, sf_dir):
    """Rows of the update batch without a key, which the upsert leaves out."""
    b1 = _batches(spark, sf_dir)[1]
    keyless = b1.withColumn("product_id", F.when(F.col("seq") % 17 != 0, F.col("product_id")))
    return C.upsert_rejects(keyless).select("seq", "unit_price", "batch_id", "reject_reason")


def _records(spark, sf_dir):
    """Product records in file order, every third twice with another price; some without id or name."""
    p = views.products(spark, sf_dir).select(
        F.when(F.col("partkey") % 19 != 0, F.col("product_id")).alias("product_id"), F.when(F.col("partkey") % 29 != 0, F.col("material_name")).alias("material_name"),
        "description", "unit_price", "partkey")
    later = p.where(F.col("partkey") % 3 == 0).withColumn("unit_price", F.concat(F.lit("1"), "unit_price"))
    return (p.withColumn("seq", F.col("partkey") * 2).unionByName(later.withColumn("seq", F.col("partkey") * 2 + 1))).drop("partkey")


def product_load(spark, sf_dir):
    """Bulk load in two batches: records embedded and put into the catalog by id, the last one of an id stays."""
    rows = _records(spark, sf_dir)
    first = C.load_products(rows.where("seq % 2 = 0"), None, 0)
    loaded = C.load_products(rows.where("seq % 2 = 1"), first, 1)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return loaded.select("product_id", "material_name", "description", "unit_price", "batch_id", "seq", F.size("embedding").alias("dim"),
                         F.round(length, 5).alias("norm"))


def load_rejects(spark, sf_dir):
    """Records that the bulk load leaves out, with the reason."""
    return C.load_rejects(_records(spark, sf_dir)).select("seq", "product_id", "material_name", "reject_reason")


def embed_catalog(spark, sf_dir):
    cat = views.products(spark, sf_dir)
    t = cat.select("product_id", E.embedding_text(F.col("material_name"), F.col("description")).alias("text"))
    e = E.hashing_encoder(t, "text")
    return e.select("product_id", F.size("embedding").alias("dim"),
                    F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


QUERIES = {
    "page_source": page_source,
    "supplier_dim": supplier_dim,
    "robots_sitemaps": robots_sitemaps,
    "sitemap_locs": sitemap_locs,
    "product_page_filter": product_page_filter,
    "product_title": product_title,
    "price_text": price_text,
    "price_extract": price_extract,
    "product_rows": product_rows,
    "rejects_report": rejects_report,
    "row_budget": row_budget,
    "catalog_roundtrip": catalog_roundtrip,
    "catalog_preview": catalog_preview,
    "catalog_upsert": catalog_upsert,
    "upsert_rejects": upsert_rejects,
    "product_load": product_load,
    "load_rejects": load_rejects,
    "embed_catalog": embed_catalog,
}


def _w(*ctes):
    return "WITH " + ", ".join(c.strip() for c in ctes)


_PAGES = _w(OC.pages_cte())
_PROD = _w(OC.pages_cte(), OC.products_cte())
_sups = ", ".join(f"({q(n)}, {q(u)}, {m})" for n, u, _, m in fixed.SUPPLIERS)
_IDX = f"({OC.supplier_url('supplier')} || 'sitemaps/' || supplier || '-index-' || CAST(sitemap_no // {views.INDEX_SIZE} AS VARCHAR) || '.xml')"
_PROD_DEDUP = """v_prod_good AS (SELECT * FROM v_prod_tagged WHERE reject_reason IS NULL),
v_prod_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) AS rn
                               FROM v_prod_good) WHERE rn = 1)"""
_PCOLS = ("product_id, material_name, CAST(NULL AS VARCHAR) AS description, unit_price, unit, region, vendor, "
          "CAST(NULL AS VARCHAR) AS vat_rate, CAST(NULL AS VARCHAR) AS quality_score, source")

SQL = {
    "page_source": _PAGES + " SELECT page_id, url, supplier FROM v_pages WHERE status = 200",
    "supplier_dim": _PAGES + f""", s AS (SELECT * FROM (VALUES {_sups}) v(supplier, url, min_products))
        SELECT p.supplier, regexp_extract(s.url, '^([a-z]+://[^/]+)', 1) AS base_url,
               {OC.region_from_host('s.url')} AS region, s.min_products, count(*) AS n_pages
        FROM v_pages p JOIN s USING (supplier) WHERE p.status = 200 GROUP BY ALL""",
    "robots_sitemaps": _PAGES + f" SELECT DISTINCT supplier, {_IDX} AS sitemap_url FROM v_pages",
    "sitemap_locs": _PAGES + """ SELECT supplier, sitemap, url,
        CAST(row_number() OVER (PARTITION BY sitemap ORDER BY seq) - 1 AS INTEGER) AS seq FROM v_pages""",
    "product_page_filter": _PAGES + f" SELECT page_id, {OC.is_product('url', 'html')} AS is_product "
                                    f"FROM v_pages WHERE status = 200",
    "product_title": _PAGES + f" SELECT page_id, {OC.title('html')} AS title FROM v_pages WHERE status = 200",
    "price_text": _PAGES + f" SELECT page_id, {OC.price_text('html')} AS price_text FROM v_pages WHERE status = 200",
    "price_extract": _PROD + " SELECT page_id, unit_price, unit FROM v_prod_tagged",
    "product_rows": _PROD + ", " + _PROD_DEDUP + f" SELECT {_PCOLS} FROM v_prod_last",
    "rejects_report": _PROD + " SELECT page_id, supplier, reject_reason FROM v_prod_tagged WHERE reject_reason IS NOT NULL",
    "row_budget": _PROD + ", " + _PROD_DEDUP + """,
        b AS (SELECT g.*, s.min_products,
                     row_number() OVER (PARTITION BY g.supplier, g.sitemap ORDER BY g.seq) AS rn
              FROM v_prod_good g JOIN v_sup s USING (supplier)),
        k AS (SELECT * FROM b WHERE rn <= min_products),
        c AS (SELECT supplier, sitemap, sitemap_no, min_products, count(*) AS n FROM k GROUP BY ALL),
        t AS (SELECT supplier, sitemap, coalesce(sum(n) OVER (PARTITION BY supplier ORDER BY sitemap_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min_products FROM c),
        kk AS (SELECT k.* FROM k JOIN t USING (supplier, sitemap) WHERE t.before < t.min_products)
        SELECT supplier, sitemap, product_id FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sitemap_no DESC, seq DESC) AS r2 FROM kk)
        WHERE r2 = 1""",
    "catalog_roundtrip": _PROD + ", " + _PROD_DEDUP + f" SELECT {_PCOLS} FROM v_prod_last",
    "catalog_preview": _PROD + ", " + _PROD_DEDUP + f" SELECT {_PCOLS} FROM v_prod_last ORDER BY product_id LIMIT 3",
    # the encoder itself has no SQL form: every product has a vector of the fixed length and norm 1
    "embed_catalog": _w(OV.products()) + " SELECT product_id, 256 AS dim, CAST(1 AS DOUBLE) AS norm FROM v_products",
    "catalog_upsert": _w(OV.products()) + f""", u AS (
          SELECT product_id, unit_price, 0 AS batch_id, partkey * 2 AS seq FROM v_products
          UNION ALL
          SELECT product_id, {OC.price_display('price_value * 1.1')}, 1, partkey * 2 FROM v_products WHERE partkey % 3 = 0
          UNION ALL
          SELECT product_id, {OC.price_display('price_value * 1.2')}, 1, partkey * 2 + 1 FROM v_products
          WHERE partkey % 3 = 0)
        SELECT product_id, unit_price, batch_id FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY batch_id DESC, seq DESC) AS rn FROM u)
        WHERE rn = 1""",
}

_RECORDS = """rec AS (SELECT CASE WHEN partkey % 19 <> 0 THEN product_id END AS product_id, CASE WHEN partkey % 29 <> 0 THEN material_name END AS material_name,
          description, unit_price, partkey FROM v_products),
        r AS (SELECT product_id, material_name, description, unit_price, partkey * 2 AS seq FROM rec
              UNION ALL SELECT product_id, material_name, description, '1' || unit_price, partkey * 2 + 1 FROM rec WHERE partkey % 3 = 0),
        rr AS (SELECT *, CASE WHEN coalesce(product_id, '') = '' THEN 'missing_id' WHEN coalesce(material_name, '') = '' THEN 'missing_name' END AS reject_reason FROM r)"""
SQL["upsert_rejects"] = _w(OV.products()) + f""", u AS (
          SELECT {OC.price_display('price_value * 1.1')} AS unit_price, partkey * 2 AS seq FROM v_products WHERE partkey % 3 = 0
          UNION ALL SELECT {OC.price_display('price_value * 1.2')}, partkey * 2 + 1 FROM v_products WHERE partkey % 3 = 0)
        SELECT seq, unit_price, 1 AS batch_id, 'missing_key' AS reject_reason FROM u WHERE seq % 17 = 0"""
SQL["product_load"] = _w(OV.products(), _RECORDS) + """
        SELECT product_id, material_name, description, unit_price, CAST(seq % 2 AS INTEGER) AS batch_id, seq, 256 AS dim, 1.0::DOUBLE AS norm FROM (
          SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq % 2 DESC, seq DESC) AS n FROM rr WHERE reject_reason IS NULL) WHERE n = 1"""
SQL["load_rejects"] = _w(OV.products(), _RECORDS) + " SELECT seq, product_id, material_name, reject_reason FROM rr WHERE reject_reason IS NOT NULL"
