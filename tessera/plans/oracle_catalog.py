"""DuckDB SQL mirroring ``tessera.operators.catalog`` over the page views."""
from __future__ import annotations

from tessera import fixed
from tessera.operators import catalog as C
from tessera.plans.oracle_rules import q


# HTML entities of the page views; '&amp;' goes last so the decode is a single pass.
ENTITIES = [("&euro;", "€"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _class_token(name: str) -> str:
    return r"""\bclass\s*=\s*"(?:[^"]*\s)?""" + name + r"""(?:\s[^"]*)?\""""


def selector_regex(sel: str) -> tuple[str, str]:
    """(exists pattern, inner-text pattern with group 1) for the selectors in use.

    Inner text runs to the next tag, which is exact for leaf elements.
    """
    if sel == "title" or sel == "h1":
        return rf"(?is)<{sel}\b", rf"(?is)<{sel}\b[^>]*>(.*?)</{sel}>"
    if sel.startswith("[data-testid="):
        val = sel.split("=")[1].strip("]'\"")
        open_ = rf"""(?is)<[a-z0-9]+\b[^>]*\bdata-testid\s*=\s*["']{val}["'][^>]*>"""
    elif sel.startswith("div[data-"):
        attr = sel[len("div["):-1]
        open_ = rf"(?is)<div\b[^>]*\b{attr}\b[^>]*>"
    elif sel.startswith("meta["):
        attr, val = sel[len("meta["):-1].split("=")
        open_ = rf"""(?is)<meta\b[^>]*\b{attr}\s*=\s*["']{val.strip("'")}["'][^>]*>"""
    elif "." in sel:
        tag, cls = sel.split(".", 1)
        tag = tag or "[a-z0-9]+"
        open_ = rf"(?is)<{tag}\b[^>]*" + _class_token(cls) + r"[^>]*>"
    else:
        open_ = rf"(?is)<{sel}\b[^>]*>"
    return open_, open_ + r"([^<]*)"


def pick(options, key):
    items = ", ".join(q(o) for o in options)
    return f"([{items}])[({key} % {len(options)}) + 1]"


def supplier_url(s: str) -> str:
    whens = " ".join(f"WHEN {s} = {q(n)} THEN {q(u)}" for n, u, _, _ in fixed.SUPPLIERS)
    return f"CASE {whens} END"


def price_display(p: str) -> str:
    whole = f"CAST(floor({p}) AS BIGINT)"
    cents = f"lpad(CAST(CAST(round({p} * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')"
    return (f"CASE WHEN {whole} >= 1000 THEN CAST({whole} // 1000 AS VARCHAR) || '.' || "
            f"lpad(CAST({whole} % 1000 AS VARCHAR), 3, '0') || ',' || {cents} "
            f"ELSE CAST({whole} AS VARCHAR) || ',' || {cents} END")


def pages_cte() -> str:
    suppliers = [s[0] for s in fixed.SUPPLIERS]
    txt = price_display("pt.p_retailprice")
    block = (f"coalesce(CASE WHEN pg.page_id % 4 = 0 THEN '<span class=\"price\">' || {txt} || ' €/m2</span>' "
             f"WHEN pg.page_id % 4 = 1 THEN '<div class=\"product-price\">soit ' || {txt} || ' € / m2</div>' "
             f"WHEN pg.page_id % 4 = 2 THEN '<p>Prix ' || {txt} || ' € / m2</p>' ELSE '' END, '')")
    cart = "CASE WHEN pg.page_id % 3 = 0 THEN '<button>Ajouter au panier</button>' ELSE '' END"
    sup = pick(suppliers, "pg.page_id")
    return f"""
v_pages AS (
  SELECT pg.page_id, pg.url,
         replace(pg.html, '</article>', {block} || {cart} || '</article>') AS html,
         {sup} AS supplier,
         CASE WHEN pg.page_id % 17 = 0 THEN 404 ELSE 200 END AS status,
         pg.page_id // 50 AS sitemap_no,
         {supplier_url(sup)} || 'sitemaps/' || {sup} || '-' || CAST(pg.page_id // 50 AS VARCHAR) || '.xml' AS sitemap,
         pg.page_id AS seq
  FROM pages pg LEFT JOIN part pt ON pt.p_partkey = pg.page_id)"""


def regexp_like(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def decode(c: str) -> str:
    for ent, ch in ENTITIES:
        c = f"replace({c}, {q(ent)}, {q(ch)})"
    return c


def strip_tags(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]*>', '', 'g')"


def plain_text(h: str) -> str:
    t = f"regexp_replace({h}, '(?is)<script\\b.*?</script>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<style\\b.*?</style>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    return decode(strip_tags(t))


def clean_text(raw: str) -> str:
    return f"trim({decode(strip_tags(raw))})"


def element_text(h: str, sel: str) -> str:
    _, inner = selector_regex(sel)
    return clean_text(f"regexp_extract({h}, {q(inner)}, 1)")


def first_selector_text(h: str, selectors) -> str:
    whens = " ".join(f"WHEN {regexp_like(h, selector_regex(s)[0])} THEN regexp_extract({h}, {q(selector_regex(s)[1])}, 1)"
                     for s in selectors)
    return clean_text(f"CASE {whens} END")


def is_product(url: str, h: str) -> str:
    has_price = " OR ".join(regexp_like(h, selector_regex(s)[0]) for s in fixed.PRICE_ELEMENT_SELECTORS)
    return (f"(coalesce({regexp_like(url, '(?i)' + fixed.PRODUCT_URL_PATTERN)}, false) OR "
            f"({regexp_like(h, '(?is)<h1\\b')} AND ({has_price})) OR "
            f"{regexp_like(h, '(?i)' + fixed.ADD_TO_CART_PATTERN)})")


def title(h: str) -> str:
    return (f"coalesce(NULLIF({first_selector_text(h, fixed.TITLE_SELECTORS)}, ''), "
            f"NULLIF({element_text(h, 'title')}, ''))")


def price_text(h: str) -> str:
    return first_selector_text(h, fixed.PRICE_SELECTORS)


def clean_unit(u: str) -> str:
    x = f"replace(replace(replace(replace({u}, 'soit', ''), 'Ajouter', ''), '2', '²'), '3', '³')"
    return f"CASE WHEN coalesce({u}, '') = '' THEN '' ELSE '/' || {x} END"


def first_price(t: str) -> str:
    pat = q(C.PRICE_RE)
    num = f"trim(trim(regexp_extract({t}, {pat}, 1), ','), '.')"
    unit = f"regexp_extract({t}, {pat}, 2)"
    return f"CASE WHEN regexp_extract({t}, {pat}, 0) <> '' THEN {num} || ' €' || {clean_unit(unit)} END"


def region_from_host(u: str) -> str:
    host = f"lower(coalesce(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1), ''))"
    whens = " ".join(f"WHEN suffix({host}, {q(s)}) THEN {q(r)}" for s, r in fixed.HOST_REGIONS)
    return f"CASE {whens} ELSE 'Unknown' END"


def title_words(v: str) -> str:
    return (f"array_to_string(list_transform(string_split({v}, '_'), "
            f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '_')")


def products_cte() -> str:
    sups = ", ".join(f"({q(n)}, {q(u)}, {m})" for n, u, _, m in fixed.SUPPLIERS)
    price = f"coalesce({first_price(price_text('p.html'))}, {first_price(plain_text('p.html'))})"
    return f"""
v_sup AS (SELECT * FROM (VALUES {sups}) s(supplier, supplier_url, min_products)),
v_prod_raw AS (
  SELECT p.page_id, p.supplier, p.sitemap, p.sitemap_no, p.seq,
         p.supplier || '|' || md5(p.url) AS product_id,
         {title('p.html')} AS material_name,
         {price} AS price,
         {region_from_host('s.supplier_url')} AS region,
         {title_words('p.supplier')} AS vendor,
         p.url AS source
  FROM v_pages p LEFT JOIN v_sup s USING (supplier)
  WHERE p.status = 200 AND {is_product('p.url', 'p.html')}),
v_prod_tagged AS (
  SELECT page_id, supplier, sitemap, sitemap_no, seq, product_id, material_name,
         string_split(price, ' ')[1] AS unit_price, string_split(price, ' ')[2] AS unit,
         region, vendor, source,
         CASE WHEN coalesce(material_name, '') = '' THEN 'missing_name'
              WHEN coalesce(string_split(price, ' ')[1], '') = '' THEN 'missing_price'
              WHEN coalesce(source, '') = '' THEN 'missing_url' END AS reject_reason
  FROM v_prod_raw)"""
