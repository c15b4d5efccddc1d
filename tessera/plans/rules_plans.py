"""Registered transcript and pricing-rule queries and their DuckDB oracles.

All of them run over every transcript (one per order).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pricing as P
from tessera.operators import transcript as TR
from tessera.plans import oracle_rules as R
from tessera.plans import oracle_views as OV
from tessera.sources import reference_data as RD
from tessera.sources import views


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.parse(views.transcripts(spark, sf_dir))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.explode_tasks(_parsed(spark, sf_dir), ["proposal_id"])


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes)


BASE = [OV.transcripts(), R.parsed_cte()]
TASKS = BASE + [R.task_rows_cte()]


def parse_area(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    return t.select("proposal_id", TR.area_m2(F.col("transcript")).alias("area_m2"))


def parse_city(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    return t.select("proposal_id", TR.labour_city(F.col("transcript")).alias("city"))


def zone_budget(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    return t.select("proposal_id", TR.zone(F.col("transcript")).alias("zone"),
                    TR.budget_flag(F.col("transcript")).alias("budget_flag"))


def task_rules(spark, sf_dir):
    return _tasks(spark, sf_dir).select("proposal_id", "task_pos", "task_name", "area_m2")


def transcript_parsed(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("proposal_id", "renovation_type", "vendor", "place", "region", "zone", "city",
                    "budget_flag", "area_m2", F.size("tasks").alias("n_tasks"),
                    F.size("materials").alias("n_materials"),
                    F.array_join("materials", "|").alias("materials"))


def query_signals(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    s = TR.query_signals(F.col("transcript"))
    return t.select("proposal_id", s["product_type"].alias("product_type"), s["region"].alias("region"),
                    s["quality"].alias("quality"), s["unit"].alias("unit"))


def renovation_type(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    return t.select("proposal_id", TR.renovation_type(F.col("transcript")).alias("renovation_type"))


def vendor_mention(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    return t.select("proposal_id", TR.vendor_mention(F.col("transcript")).alias("vendor"))


def region_mention(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    pl = TR.place_mention(F.col("transcript"))
    return (t.select("proposal_id", pl["place"].alias("place"), pl["region"].alias("region"))
             .where(F.col("place").isNotNull()))


def material_phrases(spark, sf_dir):
    t = views.transcripts(spark, sf_dir)
    return t.select("proposal_id", F.explode(TR.material_phrases(F.col("transcript"))).alias("material"))


def labor_hours(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    return t.select("proposal_id", "task_pos", "task_name",
                    P.estimate_hours(F.col("task_name"), F.col("area_m2")).alias("hours"))


def labor_cost(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    city = F.coalesce(F.col("city"), F.lit("Generic"))
    mult = P.city_multiplier(city)
    hours = P.estimate_hours(F.col("task_name"), F.col("area_m2"))
    return t.select("proposal_id", "task_pos", city.alias("city"), P.hourly_rate(mult).alias("hourly_rate"),
                    P.labour_cost(hours, mult).alias("labor_cost"))


def vat_lookup(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    rules = P.vat_rules_from_table(RD.vat_rates(spark))
    return t.select("proposal_id", "task_pos", "task_name", P.vat_rate(F.col("task_name"), rules).alias("vat_rate"))


def _template_costs(spark, sf_dir):
    t = _tasks(spark, sf_dir).withColumn("multiplier", P.city_multiplier(F.coalesce(F.col("city"), F.lit("Generic"))))
    return P.with_template_costs(t, RD.task_templates(spark), RD.rate_card(spark))


def unit_cost(spark, sf_dir):
    return _template_costs(spark, sf_dir).select("proposal_id", "task_pos", "default_material", "unit_cost")


def material_cost(spark, sf_dir):
    return _template_costs(spark, sf_dir).select("proposal_id", "task_pos", "default_material", "default_qty",
                                                 "material_cost")


def task_template_join(spark, sf_dir):
    return _template_costs(spark, sf_dir).select("proposal_id", "task_pos", "task_name", "default_hours",
                                                 "default_material", "default_qty", "material_unit")


def _template_sql(select: str) -> str:
    return _with(*TASKS, f"tpl AS (SELECT * FROM (VALUES {R.templates_values()}) "
                         f"v(task_name, default_hours, default_material, default_qty))",
                 f"card AS (SELECT * FROM (VALUES {R.rate_card_values()}) v(item, unit, cost))") + f"""
, j AS (
  SELECT t.*, tpl.default_hours, tpl.default_material, tpl.default_qty, card.unit AS material_unit, card.cost,
         {R.multiplier("coalesce(t.city, 'Generic')")} AS multiplier
  FROM v_tasks t LEFT JOIN tpl USING (task_name) LEFT JOIN card ON card.item = tpl.default_material),
k AS (SELECT *, round(cost * multiplier, 2) AS unit_cost FROM j)
{select}"""


QUERIES = {
    "parse_area": parse_area,
    "parse_city": parse_city,
    "zone_budget": zone_budget,
    "task_rules": task_rules,
    "transcript_parsed": transcript_parsed,
    "query_signals": query_signals,
    "renovation_type": renovation_type,
    "vendor_mention": vendor_mention,
    "region_mention": region_mention,
    "material_phrases": material_phrases,
    "labor_hours": labor_hours,
    "labor_cost": labor_cost,
    "vat_lookup": vat_lookup,
    "unit_cost": unit_cost,
    "material_cost": material_cost,
    "task_template_join": task_template_join,
}

_T = "t.transcript"
SQL = {
    "parse_area": _with(OV.transcripts()) + f" SELECT proposal_id, {R.area(_T)} AS area_m2 FROM v_transcripts t",
    "parse_city": _with(OV.transcripts()) + f" SELECT proposal_id, {R.city(_T)} AS city FROM v_transcripts t",
    "zone_budget": _with(OV.transcripts()) + f" SELECT proposal_id, {R.zone(_T)} AS zone, {R.budget(_T)} AS budget_flag "
                                             f"FROM v_transcripts t",
    "task_rules": _with(*TASKS) + " SELECT proposal_id, task_pos, task_name, area_m2 FROM v_tasks",
    "transcript_parsed": _with(*BASE) + """ SELECT proposal_id, renovation_type, vendor, place, region, zone, city,
        budget_flag, area_m2, CAST(len(tasks) AS INTEGER) AS n_tasks, CAST(len(materials) AS INTEGER) AS n_materials,
        array_to_string(materials, '|') AS materials FROM v_parsed""",
    "query_signals": _with(OV.transcripts(), R.place_cte("v_transcripts", "proposal_id", "transcript", "v_pl")) +
        f""" SELECT t.proposal_id, {R.renovation_type(_T)} AS product_type, pl.region AS region,
        {R.quality(_T)} AS quality, {R.unit(_T)} AS unit
        FROM v_transcripts t LEFT JOIN v_pl pl USING (proposal_id)""",
    "renovation_type": _with(OV.transcripts()) + f" SELECT proposal_id, {R.renovation_type(_T)} AS renovation_type "
                                                 f"FROM v_transcripts t",
    "vendor_mention": _with(OV.transcripts()) + f" SELECT proposal_id, {R.vendor(_T)} AS vendor FROM v_transcripts t",
    "region_mention": _with(OV.transcripts(), R.place_cte("v_transcripts", "proposal_id", "transcript", "v_pl")) +
        " SELECT proposal_id, place, region FROM v_pl",
    "material_phrases": _with(OV.transcripts()) + f""" SELECT proposal_id, unnest({R.materials(_T)}) AS material
        FROM v_transcripts t""",
    "labor_hours": _with(*TASKS) + f" SELECT proposal_id, task_pos, task_name, {R.hours('task_name', 'area_m2')} AS hours "
                                   f"FROM v_tasks",
    "labor_cost": _with(*TASKS) + f""" SELECT proposal_id, task_pos, coalesce(city, 'Generic') AS city,
        {R.hourly_rate("coalesce(city, 'Generic')")} AS hourly_rate,
        round({R.hours('task_name', 'area_m2')} * {R.hourly_rate("coalesce(city, 'Generic')")}, 2) AS labor_cost
        FROM v_tasks""",
    "vat_lookup": _with(*TASKS) + f" SELECT proposal_id, task_pos, task_name, {R.vat('task_name')} AS vat_rate FROM v_tasks",
    "unit_cost": _template_sql("SELECT proposal_id, task_pos, default_material, unit_cost FROM k"),
    "material_cost": _template_sql("SELECT proposal_id, task_pos, default_material, default_qty, "
                                   "round(default_qty * unit_cost, 2) AS material_cost FROM k"),
    "task_template_join": _template_sql("SELECT proposal_id, task_pos, task_name, default_hours, default_material, "
                                        "default_qty, material_unit FROM k"),
}
