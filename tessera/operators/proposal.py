"""Priced proposals from parsed transcripts.

Plan shape::

    parsed --task array expressions--> hours, labour, VAT of each proposal (no explode)
    parsed --explode materials--> lookup key (vendor + material, region)
           --distinct, written once--> lookups --encode--> best product (matcher, k = 1)
           --join back on the lookup key--> lines --groupBy(proposal_id)--> de-dup, totals

Lookups are made distinct before scoring: the same phrase in many
transcripts is scored once.
"""
from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.plan import materialize
from tessera.operators import match as M
from tessera.operators import pricing as P
from tessera.session import scratch_path

LOOKUP_SEP = "\u001f"


def lookup_key(text, region):
    return F.concat_ws(LOOKUP_SEP, text, F.coalesce(region, F.lit("")))


def best_products(lines: DataFrame, catalog: DataFrame, encode) -> DataFrame:
    """Best catalog product per distinct (lookup_text, region).

    ``encode(df, text_col)`` adds an ``embedding`` column. Returns
    (lookup, product_id, sim, degraded).
    """
    lookups = (lines.select(lookup_key(F.col("lookup_text"), F.col("region")).alias("lookup"),
                            "lookup_text", "region").dropDuplicates(["lookup"]))
    # written once: the ids given here stay the same however often the table is read
    path = scratch_path(lines.sparkSession, f"lookups-{uuid.uuid4().hex}")
    encode(lookups, "lookup_text").withColumn("query_id", F.monotonically_increasing_id()).write.parquet(path)
    lookups = lines.sparkSession.read.parquet(path)
    cfg = M.MatchConfig(cap=1, fallback_k=1, filters=("region",))
    hits = M.top_k(lookups.select("query_id", "embedding", "region"), catalog, cfg)
    best = (hits.join(lookups.select("query_id", "lookup"), "query_id")
                .select("lookup", "product_id", "sim", "degraded"))
    best._rows_bound = hits._rows_bound   # one row per distinct lookup, counted
    return best


def _small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when its counted row bound allows it, else leave the join to the planner."""
    bound = getattr(df, "_rows_bound", None)
    return F.broadcast(df) if bound is not None and bound <= M.MAX_BROADCAST_HITS else df


def quote_id(proposal_id):
    return F.md5(F.concat(F.lit("quote:"), proposal_id.cast("string")))


def task_totals_expr(tasks, city, vat_rules=None) -> dict:
    """Per-proposal task totals straight from the task array (no explode, no shuffle)."""
    mult = P.city_multiplier(F.coalesce(city, F.lit(fixed.PROPOSAL_DEFAULT_CITY)))
    hours = F.transform(tasks, lambda t: P.estimate_hours(t["task_name"], t["area_m2"]))
    labour = F.transform(hours, lambda h: P.labour_cost(h, mult))
    vat = F.transform(tasks, lambda t: P.vat_rate(t["task_name"], vat_rules))
    zero = F.lit(0.0).cast("double")
    return {
        "n_tasks": F.size(tasks).cast("long"),
        "total_hours": F.aggregate(hours, zero, lambda a, x: a + x),
        "labor_cost": F.aggregate(labour, zero, lambda a, x: a + x),
        "vat_rate": F.coalesce(F.greatest(F.array_max(vat), zero), zero),
    }


LINE_FIELDS = ["mat_pos", "material", "product_id", "sim", "degraded", "material_name", "price_value",
               "product_region", "product_vendor"]


def assemble(parsed: DataFrame, catalog: DataFrame, encode, margin: float = fixed.PROPOSAL_MARGIN,
             vat_rules=None) -> tuple[DataFrame, DataFrame]:
    """(proposals, quote_lines).

    Shuffles: the lookup join (broadcast at runtime when the distinct lookups
    are small) and one groupBy on proposal_id; task totals are array
    expressions on each row. Margin term as coded: matched material count x
    (1 + margin) x (1 + task VAT), before de-dup and without the price.
    Total = ceil(prices + margin term + labour).
    """
    tt = task_totals_expr(F.col("_tasks"), F.col("_city"), vat_rules)
    # the totals refer to the task list many times: it is worked out once
    parsed = materialize(parsed, _tasks=F.col("tasks"), _city=F.col("city"))
    base = parsed.select("proposal_id", "renovation_type", "region", "vendor", "materials",
                         *[v.alias(k) for k, v in tt.items()])
    # one row per (proposal, material); proposals without materials keep one null row
    lines = base.select("*", F.posexplode_outer("materials").alias("mat_pos", "material")).drop("materials")
    lines = lines.withColumn("lookup_text", F.concat_ws(" ", F.col("vendor"), F.col("material")))
    # parsed once: the lines feed the distinct lookups (scored first) and the main join
    lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
    best = best_products(lines.where(F.col("material").isNotNull()), catalog, encode)
    display = catalog.select("product_id", "material_name", "price_value",
                             F.col("region").alias("product_region"), F.col("vendor").alias("product_vendor"))
    bound = best._rows_bound
    best = _small(best).join(display, "product_id")
    best._rows_bound = bound
    keyed = lines.withColumn("lookup", F.when(F.col("material").isNotNull(),
                                              lookup_key(F.col("lookup_text"), F.col("region"))))
    matched = keyed.join(_small(best), "lookup", "left")
    line = F.when(F.col("product_id").isNotNull(), F.struct(*[F.col(c) for c in LINE_FIELDS]))
    grouped = matched.groupBy("proposal_id").agg(
        F.first("renovation_type").alias("renovation_type"),
        *[F.first(k).alias(k) for k in tt],
        F.array_sort(F.collect_list(line)).alias("lines"))   # sorted by mat_pos
    # first line per product in material order
    uniq = F.filter("lines", lambda x, i: ~F.exists(F.slice("lines", 1, i),
                                                    lambda y: y["product_id"] == x["product_id"]))
    g = grouped.withColumn("uniq", uniq)
    prices_raw = F.aggregate(F.transform("uniq", lambda x: F.coalesce(x["price_value"], F.lit(0.0))),
                             F.lit(0.0).cast("double"), lambda a, x: a + x)
    n_mat = F.size("lines").cast("long")
    n_uniq = F.size("uniq")
    # mean of the 4-decimal scores, rounded to 2: summed in integer units of 1e-4 so that a
    # half-way mean is exactly representable and rounds the same way on every engine
    units = F.aggregate(F.transform("uniq", lambda x: F.round(x["sim"] * 10000).cast("long")),
                        F.lit(0).cast("long"), lambda a, x: a + x)
    conf = F.when(n_uniq > 0, F.round(units.cast("double") / n_uniq / 100.0) / 100.0).otherwise(F.lit(0.0))
    vat = F.col("vat_rate")
    margin_term = n_mat.cast("double") * F.lit(1.0 + margin) * (F.lit(1.0) + vat)
    days = F.ceil(F.col("total_hours") / 24.0)
    proposals = g.select(
        "proposal_id",
        quote_id(F.col("proposal_id")).alias("quote_id"),
        F.coalesce(F.col("renovation_type"), F.lit(fixed.PROPOSAL_DEFAULT_LABEL)).alias("label"),
        "n_tasks", "total_hours",
        F.round("labor_cost", 2).alias("labor_cost"),
        "vat_rate",
        n_mat.alias("n_materials"),
        F.round(margin_term, 4).alias("margin_protected_price"),
        F.round(prices_raw, 2).alias("prices_sum"),
        conf.alias("confidence_score"),
        F.array_join(F.transform("uniq", lambda x: x["material_name"]), "|").alias("materials"),
        F.transform("uniq", lambda x: x["material_name"]).alias("material_list"),
        days.alias("duration_days"),
        F.concat(days.cast("string"), F.lit(" day")).alias("estimated_duration"),
        # the exact total is a multiple of 0.01: round away summation noise before the ceiling
        F.ceil(F.round(prices_raw + margin_term + F.col("labor_cost"), 6)).cast("long").alias("total_estimate"),
        F.exists("uniq", lambda x: x["price_value"].isNull()).alias("price_missing"),
    )
    qid = quote_id(F.col("proposal_id"))
    quote_lines = (g.select("proposal_id", F.explode("uniq").alias("l"))
                    .select(qid.alias("quote_id"), F.concat(qid, F.lit(":0")).alias("task_id"), "proposal_id",
                            F.col("l.product_id").alias("product_id"), F.col("l.material").alias("material"),
                            F.round("l.sim", 4).alias("similarity_score"), F.col("l.price_value").alias("price_value"),
                            F.col("l.product_region").alias("region"), F.col("l.product_vendor").alias("vendor"),
                            F.col("l.degraded").alias("degraded")))
    return proposals, quote_lines


def nested(proposals: DataFrame) -> DataFrame:
    """The response record: tasks array of one struct and the integer total. Names come from ``material_list``, whatever they contain;
    rows without that column have their ``materials`` split at bars."""
    names = F.col("material_list") if "material_list" in proposals.columns else F.split(F.col("materials"), r"\|")
    task = F.struct(F.col("label"), names.alias("materials"),
                    F.col("estimated_duration"), F.col("margin_protected_price"), F.col("confidence_score"))
    return proposals.select("proposal_id", "quote_id", F.array(task).alias("tasks"), "total_estimate")


def documented_vat(renovation_type) -> F.Column:
    """VAT by job type as documented: new build 20 %, renovation of existing rooms 10 %."""
    return (F.when(renovation_type.isNull() | (renovation_type == "new_build"), F.lit(0.20))
             .otherwise(F.lit(0.10)))


def documented_price(prices, vat, margin: float = 0.25):
    """Price with the contractor margin and VAT applied, as documented."""
    return F.round(prices * F.lit(1.0 + margin) * (F.lit(1.0) + vat), 2)
