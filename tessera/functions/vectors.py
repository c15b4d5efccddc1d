"""Vector expressions (JVM-side array functions)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; unequal lengths give null."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b),
                  F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero norm gives null instead of failing under ANSI mode."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def confidence_tier(sim: Column) -> Column:
    """high above 0.8, medium above 0.6, else low; NaN and null are low."""
    return (F.when(sim.isNull() | F.isnan(sim), F.lit("low"))
            .when(sim > fixed.TIER_HIGH, F.lit("high"))
            .when(sim > fixed.TIER_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def blend(a: Column, b: Column, weight: float) -> Column:
    """a + weight * b, element-wise, in double precision."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + F.lit(weight) * y.cast("double"))
