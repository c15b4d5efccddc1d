"""Registered lookup queries (similarity search) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators import ann
from tessera.operators import match as M
from tessera.plans import oracle_views as OV
from tessera.sources import views
from tessera.sources.tables import read_table

TOPK_COLUMNS = ["query_id", "rank", "product_id", "material_name", "unit_price", "unit", "region",
                "vendor", "similarity_score", "confidence_tier", "degraded"]


def match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 (capped, per-query limit) per lookup with region/vendor filters and degrade."""
    cat = views.products(spark, sf_dir)
    hits = M.top_k(views.queries(spark, sf_dir), cat)
    return M.attach_products(hits, cat).select(*TOPK_COLUMNS)


def _topk_sql() -> str:
    return f"""WITH {OV.products()}, {OV.queries()}, {OV.ranked_matches()}
SELECT m.query_id, m.rank, m.product_id, p.material_name, p.unit_price, p.unit, p.region, p.vendor,
       round(m.sim, 4) AS similarity_score, {OV.tier('m.sim')} AS confidence_tier, m.degraded
FROM m_ranked m JOIN v_products p USING (product_id)"""


DISPLAY_STRING_COLUMNS = ["product_id", "material_name", "description", "unit_price", "unit", "region",
                          "vendor", "vat_rate", "updated_at", "source"]


def match_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response rows with null-safe string rendering of every catalog field."""
    cat = views.products(spark, sf_dir)
    hits = M.attach_products(M.top_k(views.queries(spark, sf_dir), cat), cat)
    return hits.select("query_id", "rank",
                       *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DISPLAY_STRING_COLUMNS],
                       "similarity_score", "confidence_tier")


def _display_sql() -> str:
    cols = ", ".join(f"coalesce(CAST(p.{c} AS VARCHAR), '') AS {c}" for c in DISPLAY_STRING_COLUMNS)
    return f"""WITH {OV.products()}, {OV.queries()}, {OV.ranked_matches()}
SELECT m.query_id, m.rank, {cols}, round(m.sim, 4) AS similarity_score, {OV.tier('m.sim')} AS confidence_tier
FROM m_ranked m JOIN v_products p USING (product_id)"""


def match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best single product per lookup (k = 1), with the same filters and degrade."""
    cat = views.products(spark, sf_dir)
    cfg = M.MatchConfig(cap=1, fallback_k=1)
    hits = M.top_k(views.queries(spark, sf_dir), cat, cfg)
    return M.attach_products(hits, cat).select("query_id", "product_id", "material_name",
                                               "similarity_score", "confidence_tier", "degraded")


def _best_sql() -> str:
    return f"""WITH {OV.products()}, {OV.queries()}, {OV.ranked_matches(cap=1, fallback_k=1)}
SELECT m.query_id, m.product_id, p.material_name, round(m.sim, 4) AS similarity_score,
       {OV.tier('m.sim')} AS confidence_tier, m.degraded
FROM m_ranked m JOIN v_products p USING (product_id)"""


def match_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lookup: whether the filtered search came back empty and the fallback answered."""
    cat = views.products(spark, sf_dir)
    hits = M.top_k(views.queries(spark, sf_dir), cat)
    return (hits.groupBy("query_id")
                .agg(F.max("degraded").alias("degraded"), F.count("*").alias("n_results"),
                     F.round(F.max("sim"), 4).alias("best_score")))


def _degraded_sql() -> str:
    return f"""WITH {OV.products()}, {OV.queries()}, {OV.ranked_matches()}
SELECT query_id, bool_or(degraded) AS degraded, count(*) AS n_results, round(max(sim), 4) AS best_score
FROM m_ranked GROUP BY query_id"""


def match_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups with an empty text give no rows; they are reported with a reason."""
    return M.empty_queries(views.queries(spark, sf_dir))


def _empty_sql() -> str:
    return f"""WITH {OV.queries()}
SELECT query_id, 'empty_query' AS reason FROM v_queries WHERE coalesce(query, '') = '' OR len(embedding) = 0"""


def _filter_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.queries(spark, sf_dir)
    return (q.withColumn("unit", F.when(F.col("query_id") % 4 == 1, F.lit("€/m²")))
             .withColumn("quality_score", F.when(F.col("query_id") % 6 == 2,
                                                 (F.col("query_id") % 10).cast("string"))))


FILTERS_4 = ("region", "vendor", "unit", "quality_score")


def match_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 with the extra optional equality filters on unit and quality score."""
    cat = views.products(spark, sf_dir)
    cfg = M.MatchConfig(filters=FILTERS_4)
    hits = M.top_k(_filter_queries(spark, sf_dir), cat, cfg)
    return M.attach_products(hits, cat).select("query_id", "rank", "product_id", "unit", "quality_score",
                                               "similarity_score", "degraded")


def _filters_sql() -> str:
    fq = """v_fq AS (SELECT *, CASE WHEN query_id % 4 = 1 THEN '€/m²' END AS unit,
       CASE WHEN query_id % 6 = 2 THEN CAST(query_id % 10 AS VARCHAR) END AS quality_score FROM v_queries)"""
    ranked = OV.ranked_matches(queries_cte="v_fq").replace(
        "(q.vendor IS NULL OR q.vendor = '' OR p.vendor = q.vendor)",
        "(q.vendor IS NULL OR q.vendor = '' OR p.vendor = q.vendor) AND "
        "(q.unit IS NULL OR q.unit = '' OR p.unit = q.unit) AND "
        "(q.quality_score IS NULL OR q.quality_score = '' OR p.quality_score = q.quality_score)")
    return f"""WITH {OV.products()}, {OV.queries()}, {fq}, {ranked}
SELECT m.query_id, m.rank, m.product_id, p.unit, p.quality_score, round(m.sim, 4) AS similarity_score, m.degraded
FROM m_ranked m JOIN v_products p USING (product_id)"""


THRESHOLD = 0.6
CHEAPEST_K = 3


def cheapest_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lookup: the 3 cheapest products in its region with similarity above 0.6."""
    cat = views.products(spark, sf_dir)
    cfg = M.MatchConfig(cap=CHEAPEST_K, degrade=False, min_score=THRESHOLD, order_extra=True,
                        filters=("region",))
    hits = M.top_k(views.queries(spark, sf_dir), cat, cfg, extra_col="price_value")
    return hits.select("query_id", "rank", "product_id", F.col("extra").alias("price_value"),
                       F.round("sim", 4).alias("similarity_score"))


def _cheapest_sql() -> str:
    sim = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))"
    return f"""WITH {OV.products()}, {OV.queries()},
c AS (
  SELECT q.query_id, q.q_limit, p.product_id, p.price_value, {sim} AS sim
  FROM v_queries q JOIN v_products p
    ON (q.region IS NULL OR q.region = '' OR p.region = q.region)
  WHERE len(q.embedding) > 0 AND p.price_value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price_value, product_id) AS rn
      FROM c WHERE sim > {THRESHOLD})
SELECT query_id, CAST(rn AS INTEGER) AS rank, product_id, price_value, round(sim, 4) AS similarity_score
FROM r WHERE rn <= least(q_limit, {CHEAPEST_K})"""


def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result counts by confidence tier and product region over all lookups."""
    cat = views.products(spark, sf_dir)
    hits = M.attach_products(M.top_k(views.queries(spark, sf_dir), cat), cat, ["region"])
    return (hits.groupBy("region", "confidence_tier")
                .agg(F.count("*").alias("n_results"),
                     # mean of the 4-decimal scores in integer 1e-4 units: exact half-way ties
                     (F.round(F.avg(F.round(F.col("sim") * 10000).cast("long"))) / 10000.0).alias("avg_score")))


def _tiers_sql() -> str:
    return f"""WITH {OV.products()}, {OV.queries()}, {OV.ranked_matches()}
SELECT p.region, {OV.tier('m.sim')} AS confidence_tier, count(*) AS n_results,
       round(avg(CAST(round(m.sim * 10000) AS BIGINT))) / 10000.0 AS avg_score
FROM m_ranked m JOIN v_products p USING (product_id) GROUP BY 1, 2"""


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with some vectors missing, empty, zero, not finite or one element too long."""
    v, k = F.col("embedding"), F.col("partkey") % 13
    zero = F.transform(v, lambda x: x * 0)
    return views.products(spark, sf_dir).withColumn(
        "embedding", F.when(k == 0, F.lit(None)).when(k == 1, F.slice(v, 1, 0)).when(k == 2, zero)
                      .when(k == 3, F.transform(v, lambda x, i: F.when(i == 0, F.lit("NaN").cast("float")).otherwise(x)))
                      .when(k == 4, F.concat(v, F.slice(v, 1, 1))).otherwise(v))


def match_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose vector cannot be scored, with the reason."""
    return M.vector_rejects(_spoiled(spark, sf_dir))


def match_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 against a catalog with unusable vectors: every usable product is found, the others are not."""
    cat = _spoiled(spark, sf_dir)
    return M.attach_products(M.top_k(views.queries(spark, sf_dir), cat), cat).select(*TOPK_COLUMNS)


_SPOIL = "partkey % 13"


def _rejects_sql() -> str:
    return f"""WITH {OV.products()}
SELECT product_id, CASE {_SPOIL} WHEN 0 THEN 'missing_vector' WHEN 1 THEN 'missing_vector' WHEN 2 THEN 'zero_vector'
       WHEN 3 THEN 'not_finite' ELSE 'odd_length' END AS reason
FROM v_products WHERE {_SPOIL} < 5"""


def _mixed_sql() -> str:
    usable = f"v_usable AS (SELECT * FROM v_products WHERE {_SPOIL} >= 5)"
    ranked = OV.ranked_matches(products_cte="v_usable")
    return f"""WITH {OV.products()}, {usable}, {OV.queries()}, {ranked}
SELECT m.query_id, m.rank, m.product_id, p.material_name, p.unit_price, p.unit, p.region, p.vendor,
       round(m.sim, 4) AS similarity_score, {OV.tier('m.sim')} AS confidence_tier, m.degraded
FROM m_ranked m JOIN v_usable p USING (product_id)"""


QUERIES = {
    "match_rejects": match_rejects,
    "match_mixed": match_mixed,
    "match_topk": match_topk,
    "match_display": match_display,
    "match_best": match_best,
    "match_degraded": match_degraded,
    "match_empty_query": match_empty_query,
    "match_filters": match_filters,
    "cheapest_above_threshold": cheapest_above_threshold,
    "confidence_tiers": confidence_tiers,
}

SQL = {
    "match_rejects": _rejects_sql(),
    "match_mixed": _mixed_sql(),
    "match_topk": _topk_sql(),
    "match_display": _display_sql(),
    "match_best": _best_sql(),
    "match_degraded": _degraded_sql(),
    "match_empty_query": _empty_sql(),
    "match_filters": _filters_sql(),
    "cheapest_above_threshold": _cheapest_sql(),
    "confidence_tiers": _tiers_sql(),
}


def _ann_inputs(spark, sf_dir):
    cat = views.products(spark, sf_dir)
    q = views.queries(spark, sf_dir).select("query_id", "embedding")
    return cat, q


def ann_topk(spark, sf_dir):
    """Approximate top-5 per lookup: an index is built and saved, with probes by measured recall, opened and searched."""
    cat, q = _ann_inputs(spark, sf_dir)
    index = ann.AnnIndex.open(spark, ann.AnnIndex.build(cat, q).path)
    return index.search(q).select("query_id", "rank", "product_id", F.round("sim", 4).alias("similarity_score"))


EXACT = M.MatchConfig(use_filters=False, degrade=False, filters=())


def ann_recall(spark, sf_dir):
    """Recall@5 of the approximate search against the exact unfiltered top-5, per lookup."""
    cat, q = _ann_inputs(spark, sf_dir)
    return ann.recall_at_k(ann.ann_top_k(q, cat, k=5), M.top_k(q, cat, EXACT))


def ann_report(spark, sf_dir):
    """The approximate search held against the tables: lookups answered, rows, rows whose score is not the exact cosine, recall of 0.9."""
    cat, q = _ann_inputs(spark, sf_dir)
    found = ann.ann_top_k(q, cat, k=5)
    exact = M.top_k(q, cat, EXACT)
    mean = ann.recall_at_k(found, exact).agg(F.avg("recall").alias("recall"))
    pairs = (found.join(q.withColumnRenamed("embedding", "a"), "query_id")
             .join(cat.select("product_id", F.col("embedding").alias("b")), "product_id"))
    off = F.abs(cosine(F.col("a"), F.col("b")) - F.col("sim")) > 1e-9
    told = pairs.agg(F.countDistinct("query_id").alias("lookups"), F.count("*").alias("results"), F.count_if(off).alias("wrong_scores"))
    return told.join(F.broadcast(mean)).select("lookups", "results", "wrong_scores", (F.col("recall") >= 0.9).alias("recall_reached"))


def _ann_report_sql() -> str:
    return f"""WITH {OV.products()}, {OV.queries()}
SELECT count(*) AS lookups, sum(least(5, (SELECT count(*) FROM v_products)))::BIGINT AS results, 0::BIGINT AS wrong_scores,
       true AS recall_reached
FROM v_queries WHERE len(embedding) > 0"""


def _clustered(spark, sf_dir):
    """Catalog and lookups whose vectors lie in 40 clusters: a vector of the table's first 40, and a part of one's own."""
    def pulled(rows, key):
        centre = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("vec_id < 40").withColumnsRenamed({"embedding": "_c", "vec_id": "_v"})
        own = F.zip_with("_c", "embedding", lambda c, x: c.cast("double") + 0.25 * x.cast("double"))
        return rows.join(centre, F.col(key) % 40 == F.col("_v")).withColumn("embedding", own).drop("_c", "_v")
    return pulled(views.products(spark, sf_dir), "partkey"), pulled(views.queries(spark, sf_dir).where(F.size("embedding") > 0), "query_id")


_CLUSTERED = """v_centre AS (SELECT vec_id AS c, embedding AS ce FROM embeddings WHERE vec_id < 40),
v_cp AS (SELECT p.* REPLACE (list_transform(list_zip(ce, p.embedding), lambda t: CAST(t[1] AS DOUBLE) + 0.25 * CAST(t[2] AS DOUBLE)) AS embedding)
         FROM v_products p JOIN v_centre ON c = p.partkey % 40),
v_cq AS (SELECT q.* REPLACE (list_transform(list_zip(ce, q.embedding), lambda t: CAST(t[1] AS DOUBLE) + 0.25 * CAST(t[2] AS DOUBLE)) AS embedding)
         FROM v_queries q JOIN v_centre ON c = q.query_id % 40 WHERE len(q.embedding) > 0)"""

PRUNED = M.MatchConfig(block_rows=256, prune=True, cells=40)


def match_pruned(spark, sf_dir):
    """Exact top-5 per lookup on clustered vectors; packs that cannot better a lookup's result are skipped by their bounds."""
    cat, q = _clustered(spark, sf_dir)
    return M.attach_products(M.top_k(q, cat, PRUNED), cat).select(*TOPK_COLUMNS)


def _pruned_sql() -> str:
    ranked = OV.ranked_matches(queries_cte="v_cq", products_cte="v_cp")
    return f"""WITH {OV.products()}, {OV.queries()}, {_CLUSTERED}, {ranked}
SELECT m.query_id, m.rank, m.product_id, p.material_name, p.unit_price, p.unit, p.region, p.vendor,
       round(m.sim, 4) AS similarity_score, {OV.tier('m.sim')} AS confidence_tier, m.degraded
FROM m_ranked m JOIN v_cp p USING (product_id)"""


def match_scan(spark, sf_dir):
    """What the searches scored, from their own counts: routes on the plain catalog, routes and bounds on the clustered one.

    grid: lookups x products, which a search without routes scores once for its filters and once more for its fallback.
    """
    out = []
    for name, (cat, q), cfg in (("routed", (views.products(spark, sf_dir), views.queries(spark, sf_dir)), M.MatchConfig()),
                                ("pruned", _clustered(spark, sf_dir), PRUNED)):
        out.append(M.Search(q, cat, cfg).report().select(
            F.lit(name).alias("search"), "lookups", "grid", (F.col("cells") > 0).alias("scored"),
            (F.col("cells") * 4 < F.col("grid")).alias("below_quarter"), (F.col("asked") * 2 < F.col("pairs")).alias("half_of_packs_skipped")))
    return out[0].unionByName(out[1])


def _scan_sql() -> str:
    return f"""WITH {OV.products()}, {OV.queries()}, n AS (SELECT count(*) AS n FROM v_queries WHERE len(embedding) > 0),
g AS (SELECT n AS lookups, n * (SELECT count(*) FROM v_products) AS grid FROM n)
SELECT 'routed' AS search, lookups, grid, true AS scored, true AS below_quarter, false AS half_of_packs_skipped FROM g
UNION ALL SELECT 'pruned', lookups, grid, true, true, true FROM g"""


QUERIES.update({"ann_topk": ann_topk, "ann_recall": ann_recall, "ann_report": ann_report, "match_pruned": match_pruned, "match_scan": match_scan})
SQL.update({"ann_report": _ann_report_sql(), "match_pruned": _pruned_sql(), "match_scan": _scan_sql()})
