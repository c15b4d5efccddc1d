"""Labour, VAT and material cost rules.

The lookup tables (city multipliers, VAT keywords, rate card, task templates)
are tiny fixed-size dimensions, so they are joined by broadcast; the rules
themselves are ``when`` chains and array filters, evaluated JVM-side.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import capitalize, contains_any


MAX_LOOKUP_ROWS = 10_000  # size bound for lookup tables folded into expressions


def bounded_rows(df: DataFrame, limit: int = MAX_LOOKUP_ROWS) -> list:
    """Rows of a small lookup table, refused when it is larger than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"lookup table larger than {limit} rows; join it instead")
    return rows


def city_multiplier(city: Column, modifiers: list[tuple[str, float]] | None = None) -> Column:
    """Multiplier for a city: its entry (keys capitalised), else the Generic entry,
    else 1.0; a null or empty city is 1.0."""
    modifiers = modifiers if modifiers is not None else fixed.CITY_MODIFIERS
    table = {capitalize_py(k): float(v) for k, v in modifiers}
    generic = table.get("Generic", 1.0)
    key = capitalize(city)
    expr = F.lit(generic)
    for name, mult in reversed(list(table.items())):
        expr = F.when(key == F.lit(name), F.lit(mult)).otherwise(expr)
    return F.when(F.coalesce(city, F.lit("")) == "", F.lit(1.0)).otherwise(expr)


def capitalize_py(s: str) -> str:
    return s[:1].upper() + s[1:].lower()


def hourly_rate(multiplier: Column) -> Column:
    return F.round(F.lit(fixed.BASE_HOURLY_RATE) * multiplier, 2)


def estimate_hours(task_name: Column, area: Column, complexity: Column | None = None) -> Column:
    """Hours for a task: first matching rule, complexity factor, then up to the quarter hour."""
    name = F.lower(task_name)
    base = F.lit(fixed.FALLBACK_HOURS)
    for groups, per_m2, least, default in reversed(fixed.HOURS_RULES):
        hours = F.lit(default)
        if per_m2:
            hours = F.when(area > 0, F.greatest(F.lit(least), F.lit(per_m2[0]) * area / per_m2[1])).otherwise(hours)
        hit = F.lit(True)
        for words in groups:
            hit = hit & contains_any(name, words)
        base = F.when(hit, hours).otherwise(base)
    if complexity is not None:
        factor = F.lit(1.0)
        for level, f in reversed(fixed.COMPLEXITY_FACTORS):
            factor = F.when(complexity == F.lit(level), F.lit(f)).otherwise(factor)
        base = base * factor
    return F.round(F.ceil(base * 4).cast("double") / F.lit(4.0), 2)


def labour_cost(hours: Column, multiplier: Column) -> Column:
    return F.round(hours * hourly_rate(multiplier), 2)


def vat_rate(task_name: Column, rules: list[tuple[str, float]] | None = None) -> Column:
    """First keyword (in priority order, 'default' excluded) contained in the task name, else default."""
    rules = rules or fixed.VAT_RATES
    default = dict(rules).get("default", 0.20)
    entries = F.array(*[F.struct(F.lit(k.lower()).alias("kw"), F.lit(float(r)).alias("rate"))
                        for k, r in rules if k.lower() != "default"])
    t = F.lower(F.coalesce(task_name, F.lit("")))
    hit = F.filter(entries, lambda e: F.contains(t, e["kw"]))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["rate"], F.lit(default))


def vat_rules_from_table(vat: DataFrame) -> list[tuple[str, float]]:
    """(keyword, rate) in priority order from a (priority, keyword, rate) table."""
    return [(r["keyword"].lower(), float(r["rate"]))
            for r in bounded_rows(vat.orderBy("priority").select("keyword", "rate"))]


def unit_cost(cost: Column, multiplier: Column) -> Column:
    return F.round(cost * multiplier, 2)


def material_cost(qty: Column, unit_cost_col: Column) -> Column:
    return F.round(qty * unit_cost_col, 2)


def with_template_costs(tasks: DataFrame, templates: DataFrame, rate_card: DataFrame) -> DataFrame:
    """Tasks -> template (default hours, material, quantity) -> rate card -> default material cost.

    Templates without a rate-card item keep null costs (the rejects are in
    ``unknown_items``).
    """
    tpl = F.broadcast(templates.select("task_name", "default_hours", "default_material", "default_qty"))
    card = F.broadcast(rate_card.select(F.col("item").alias("default_material"),
                                        F.col("unit").alias("material_unit"), F.col("cost")))
    out = tasks.join(tpl, "task_name", "left").join(card, "default_material", "left")
    uc = unit_cost(F.col("cost"), F.col("multiplier"))
    return (out.withColumn("unit_cost", uc)
               .withColumn("material_cost", material_cost(F.col("default_qty"), uc)))


def unknown_items(items: DataFrame, rate_card: DataFrame, item_col: str = "item") -> DataFrame:
    """Items with no rate-card entry (the source raises; here they are rejects)."""
    return items.join(F.broadcast(rate_card.select(F.col("item").alias(item_col))), item_col, "left_anti")
