"""Text expressions used by the transcript, catalog and proposal operators.

All of them are built-in Column expressions, so they stay inside whole-stage
code generation; none needs a Python worker.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_price_fr(p: Column) -> Column:
    """French price text to double: drop dots, comma to dot; unparseable is null.

    ``1.299,00`` -> 1299.0 and, as in the behaviour reproduced, ``12.99`` -> 1299.0.
    """
    cleaned = F.replace(F.replace(p, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return cleaned.try_cast("double")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words is a substring of ``text``."""
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def first_match(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Key of the first rule with a word contained in ``text``, else null."""
    expr = None
    for key, words in rules:
        cond = contains_any(text, words)
        expr = F.when(cond, F.lit(key)) if expr is None else expr.when(cond, F.lit(key))
    return expr


def last_match(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Key of the last rule with a word contained in ``text``, else null."""
    return first_match(text, list(reversed(rules)))


def title_words(v: Column, sep: str = "_") -> Column:
    """Title-case each ``sep``-separated piece (``leroy_merlin`` -> ``Leroy_Merlin``)."""
    return F.array_join(F.transform(F.split(v, sep), lambda w: F.initcap(w)), sep)


def capitalize(v: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(v, 2, 1 << 30)))
