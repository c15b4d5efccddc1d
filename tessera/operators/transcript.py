"""Transcript interpretation: free text -> renovation type, vendor, place,
material phrases, zone, area, city, budget flag and the task list.

All rules are substring tests on the lowercased text (no word boundaries
unless stated), written as built-in expressions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import capitalize, contains_any, first_match, last_match

# Place gazetteer (ours): place as written, catalog region it belongs to.
GAZETTEER = [
    ("Paris", "EUROPE"), ("Lyon", "EUROPE"), ("Marseille", "EUROPE"), ("Île-de-France", "EUROPE"),
    ("Cairo", "AFRICA"), ("Toronto", "AMERICA"), ("Tokyo", "ASIA"), ("Dubai", "MIDDLE EAST"),
]

# Clause separators for material phrases (ours): punctuation and short link words.
CLAUSE_SPLIT = r"[,.;:!?]| and | from | for | with | in | at | on | near | et | de | pour "

# Query signal lexicons (ours), first match wins.
QUALITY_WORDS = [("high", ["better quality", "premium", "high-end"]), ("low", ["budget", "cheap"])]
UNIT_WORDS = [("€/m²", ["m2", "m²", "sqm"]), ("€/litre", ["litre", "liter"])]

CITY_PATTERN = "(" + "|".join(fixed.LABOUR_CITIES) + ")"


def renovation_type(text: Column) -> Column:
    """The LAST type (in lexicon order) with a synonym in the text."""
    return last_match(F.lower(text), fixed.RENOVATION_TYPES)


def vendor_mention(text: Column) -> Column:
    """The FIRST vendor in list order that the text mentions."""
    return first_match(F.lower(text), [(v, [v]) for v in fixed.VENDORS])


def place_mention(text: Column) -> Column:
    """Earliest gazetteer place in the text (case-sensitive), ties to list order: struct(place, region).

    A place's key is its position (none: beyond all others) and its number; the least key is evaluated once.
    """
    keys = [(F.instr(text, F.lit(p)) - 1).bitwiseAND(_FAR).cast("long") * 1000 + i for i, (p, _) in enumerate(GAZETTEER)]
    best = F.least(*keys, F.lit((_FAR - 1) * 1000 + len(GAZETTEER)).cast("long"))
    places = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(r).alias("region")) for p, r in GAZETTEER])
    return F.get(places, (best % 1000).cast("int"))  # no place: beyond the array


_FAR = 0x7FFFFFFF

# Always a clause boundary, too.
_SEP = "\u0001"
# The same boundaries, their blanks tried once.
_BOUNDARY = "[,.;:!?" + _SEP + "]| (?:and|from|for|with|in|at|on|near|et|de|pour) "
_SPACE = " \t\n\x0b\f\r"
_LINE_ENDS = ("\u0085", "\u2028", "\u2029")  # besides the white space: one at the end of the text is no part of a clause


def material_phrases(text: Column) -> Column:
    """Distinct, sorted clauses of the lowercased text that contain a material word.

    The text is split once at the separators; a clause is trimmed and kept if one of the words is in it (plain
    substring tests, where one regex over clauses and words would try every word at every place).
    """
    t = F.lower(text)
    ended = F.endswith(t, F.lit(_LINE_ENDS[0])) | F.endswith(t, F.lit(_LINE_ENDS[1])) | F.endswith(t, F.lit(_LINE_ENDS[2]))
    t = F.when(ended, F.left(t, F.length(t) - 1)).otherwise(t)
    clauses = F.filter(F.split(t, _BOUNDARY), lambda c: contains_any(c, fixed.MATERIAL_KEYWORDS))
    return F.sort_array(F.array_distinct(F.transform(clauses, lambda c: F.btrim(c, F.lit(_SPACE)))))


def zone(text: Column) -> Column:
    return F.when(F.contains(F.lower(text), F.lit("bathroom")), F.lit("bathroom")).otherwise(F.lit("general"))


def area_m2(text: Column) -> Column:
    """First integer before m2/m²; ``12.5 m2`` gives 5, as the pattern reads it."""
    return F.nullif(F.regexp_extract(F.lower(text), fixed.AREA_PATTERN, 1), F.lit("")).try_cast("double")


def labour_city(text: Column, word_boundary: bool = False) -> Column:
    """First of marseille/paris/lyon by position, capitalised (``comparison`` hits paris)."""
    pattern = r"\b" + CITY_PATTERN + r"\b" if word_boundary else CITY_PATTERN
    return capitalize(F.nullif(F.regexp_extract(F.lower(text), pattern, 1), F.lit("")))


def budget_flag(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("budget"))


def tasks(text: Column) -> Column:
    """Task list in fixed rule order: array<struct<task_name, area_m2>>."""
    t = F.lower(text)
    area = area_m2(text)
    items = [F.when(contains_any(t, needles),
                    F.struct(F.lit(name).alias("task_name"),
                             (area if takes_area else F.lit(None).cast("double")).alias("area_m2")))
             for needles, name, takes_area in fixed.TASK_RULES]
    return F.array_compact(F.array(*items))


def parse(df: DataFrame, text_col: str = "transcript") -> DataFrame:
    """Add every parsed field as a column (one projection, no UDF)."""
    t = F.col(text_col)
    place = place_mention(t)
    return df.select(
        "*",
        material_phrases(t).alias("materials"),
        place["place"].alias("place"),
        place["region"].alias("region"),
        renovation_type(t).alias("renovation_type"),
        vendor_mention(t).alias("vendor"),
        zone(t).alias("zone"),
        labour_city(t).alias("city"),
        budget_flag(t).alias("budget_flag"),
        tasks(t).alias("tasks"),
        area_m2(t).alias("area_m2"),
    )


def query_signals(text: Column) -> Column:
    """Signals a lookup text carries: product type, place region, quality, unit."""
    t = F.lower(text)
    return F.struct(
        last_match(t, fixed.RENOVATION_TYPES).alias("product_type"),
        place_mention(text)["region"].alias("region"),
        first_match(t, QUALITY_WORDS).alias("quality"),
        first_match(t, UNIT_WORDS).alias("unit"),
    )


def explode_tasks(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per task with its position (0-based)."""
    return (parsed.select(*keys, "city", F.posexplode("tasks").alias("task_pos", "task"))
                  .select(*keys, "city", "task_pos", F.col("task.task_name").alias("task_name"),
                          F.col("task.area_m2").alias("area_m2")))
