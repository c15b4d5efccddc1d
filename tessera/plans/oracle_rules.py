"""DuckDB SQL expressions mirroring ``tessera.operators.transcript`` and ``pricing``."""
from __future__ import annotations

from tessera import fixed
from tessera.operators import transcript as TR


def d(x) -> str:
    """A numeric literal typed DOUBLE (bare literals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def first_match(t: str, rules) -> str:
    whens = " ".join(f"WHEN {contains_any(t, words)} THEN {q(key)}" for key, words in rules)
    return f"CASE {whens} END"


def renovation_type(t: str) -> str:
    return first_match(f"lower({t})", list(reversed(fixed.RENOVATION_TYPES)))


def vendor(t: str) -> str:
    return first_match(f"lower({t})", [(v, [v]) for v in fixed.VENDORS])


def area(t: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(lower({t}), '{fixed.AREA_PATTERN}', 1), '') AS DOUBLE)"


def capitalize(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def city(t: str) -> str:
    x = f"NULLIF(regexp_extract(lower({t}), '{TR.CITY_PATTERN}', 1), '')"
    return capitalize(x)


def zone(t: str) -> str:
    return f"CASE WHEN contains(lower({t}), 'bathroom') THEN 'bathroom' ELSE 'general' END"


def budget(t: str) -> str:
    return f"contains(lower({t}), 'budget')"


def materials(t: str) -> str:
    words = " OR ".join(f"contains(x, {q(w)})" for w in fixed.MATERIAL_KEYWORDS)
    return (f"list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower({t}), "
            f"{q(TR.CLAUSE_SPLIT)}), lambda x: trim(x)), lambda x: x <> '' AND ({words}))))")


def tasks(t: str) -> str:
    lt = f"lower({t})"
    items = []
    for needles, name, takes_area in fixed.TASK_RULES:
        a = area(t) if takes_area else "CAST(NULL AS DOUBLE)"
        items.append(f"CASE WHEN {contains_any(lt, needles)} THEN {{'task_name': {q(name)}, 'area_m2': {a}}} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def gazetteer_values() -> str:
    return ", ".join(f"({i}, {q(p)}, {q(r)})" for i, (p, r) in enumerate(TR.GAZETTEER))


def place_cte(src: str, key: str, t: str, name: str = "v_place") -> str:
    """CTE: (key, place, region) for the earliest gazetteer place per row."""
    return f"""
{name}_g AS (SELECT * FROM (VALUES {gazetteer_values()}) g(ord, place, region)),
{name} AS (
  SELECT s.{key} AS {key}, arg_min(g.place, strpos(s.{t}, g.place) * 100 + g.ord) AS place,
         arg_min(g.region, strpos(s.{t}, g.place) * 100 + g.ord) AS region
  FROM {src} s JOIN {name}_g g ON strpos(s.{t}, g.place) > 0
  GROUP BY s.{key})"""


def quality(t: str) -> str:
    return first_match(f"lower({t})", TR.QUALITY_WORDS)


def unit(t: str) -> str:
    return first_match(f"lower({t})", TR.UNIT_WORDS)


def hours(name: str, a: str) -> str:
    t = f"lower({name})"
    has_area = f"({a} IS NOT NULL AND {a} > 0)"
    base = (f"CASE WHEN contains({t}, 'til') OR contains({t}, 'tile') THEN "
            f"CASE WHEN {has_area} THEN {d(fixed.TILING_HOURS_PER_M2)} * {a} ELSE {d(fixed.TILING_DEFAULT_HOURS)} END "
            f"WHEN contains({t}, 'paint') THEN "
            f"CASE WHEN {has_area} THEN greatest({d(fixed.PAINT_MIN_HOURS)}, {a} / {d(fixed.PAINT_M2_PER_HOUR)}) "
            f"ELSE {d(fixed.PAINT_DEFAULT_HOURS)} END "
            f"WHEN contains({t}, 'plumb') THEN CASE WHEN contains({t}, 'redo') OR contains({t}, 'replace') "
            f"THEN {d(fixed.PLUMB_REDO_HOURS)} ELSE {d(fixed.PLUMB_OTHER_HOURS)} END "
            f"WHEN contains({t}, 'demol') OR contains({t}, 'disposal') OR contains({t}, 'remove') "
            f"THEN {d(fixed.SMALL_TASK_HOURS)} "
            f"WHEN contains({t}, 'toilet') THEN {d(fixed.SMALL_TASK_HOURS)} "
            f"WHEN contains({t}, 'vanity') THEN {d(fixed.SMALL_TASK_HOURS)} "
            f"ELSE {d(fixed.FALLBACK_HOURS)} END")
    return f"round(CAST(ceil(CAST(({base}) AS DOUBLE) * 4) AS DOUBLE) / {d(4)}, 2)"


def multiplier(c: str) -> str:
    table = {k[:1].upper() + k[1:].lower(): v for k, v in fixed.CITY_MODIFIERS}
    generic = table.get("Generic", 1.0)
    whens = " ".join(f"WHEN {capitalize(c)} = {q(k)} THEN {d(v)}" for k, v in table.items())
    return f"CASE WHEN coalesce({c}, '') = '' THEN {d(1.0)} {whens} ELSE {d(generic)} END"


def hourly_rate(c: str) -> str:
    return f"round({d(fixed.BASE_HOURLY_RATE)} * ({multiplier(c)}), 2)"


def vat(name: str) -> str:
    default = dict(fixed.VAT_RATES).get("default", 0.20)
    whens = " ".join(f"WHEN contains(lower(coalesce({name}, '')), {q(k)}) THEN {d(r)}"
                     for k, r in fixed.VAT_RATES if k != "default")
    return f"CASE {whens} ELSE {d(default)} END"


def rate_card_values() -> str:
    return ", ".join(f"({q(i)}, {q(u)}, {d(c)})" for i, u, c in fixed.RATE_CARD)


def templates_values() -> str:
    return ", ".join(f"({q(t)}, {d(h)}, {q(m)}, {d(n)})" for t, h, m, n in fixed.TASK_TEMPLATES)


def parsed_cte(src: str = "v_transcripts", name: str = "v_parsed") -> str:
    """CTE with every parsed field per transcript (place and region by a join)."""
    return f"""{place_cte(src, 'proposal_id', 'transcript', name + '_pl')},
{name} AS (
  SELECT t.proposal_id, t.transcript,
         {materials('t.transcript')} AS materials,
         pl.place, pl.region,
         {renovation_type('t.transcript')} AS renovation_type,
         {vendor('t.transcript')} AS vendor,
         {zone('t.transcript')} AS zone,
         {city('t.transcript')} AS city,
         {budget('t.transcript')} AS budget_flag,
         {tasks('t.transcript')} AS tasks,
         {area('t.transcript')} AS area_m2
  FROM {src} t LEFT JOIN {name}_pl pl USING (proposal_id))"""


def task_rows_cte(parsed: str = "v_parsed", name: str = "v_tasks") -> str:
    return f"""
{name}_u AS (
  SELECT proposal_id, city, unnest(tasks) AS task, generate_subscripts(tasks, 1) - 1 AS task_pos
  FROM {parsed}),
{name} AS (
  SELECT proposal_id, city, CAST(task_pos AS INTEGER) AS task_pos, task.task_name AS task_name,
         task.area_m2 AS area_m2
  FROM {name}_u)"""
