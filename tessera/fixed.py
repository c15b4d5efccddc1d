"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced for results to be right: lexicons, rate cards, multipliers,
VAT keywords, task rules, page selectors and text patterns. They are kept
together, plainly, in their natural order. Order matters wherever a rule
says "first match" or "last match".
"""

# ---------------------------------------------------------------- FIXED VALUES
# Renovation types and their synonyms, in priority order (the LAST type with
# a matching synonym wins).
RENOVATION_TYPES = [
    ("bathroom", ["bathroom", "salle de bain", "toilet", "wc"]),
    ("kitchen", ["kitchen", "cuisine"]),
    ("living_room", ["living room", "salon"]),
    ("bedroom", ["bedroom", "chambre"]),
    ("terrace", ["terrace", "balcony", "balcon"]),
    ("new_build", ["new build", "construction neuve", "maison neuve"]),
    ("renovation", ["renovation", "reno", "rénover"]),
]

# Words that make a phrase a material mention.
MATERIAL_KEYWORDS = [
    "tile", "carrelage", "glue", "colle", "paint", "peinture",
    "cement", "ciment", "toilet", "lavabo", "sink", "douche",
    "plomberie", "plaster", "wood", "bois", "parquet",
    "adhesive", "joint", "isolation", "plinth", "flooring", "wall panel",
]

# Vendors, in priority order (the FIRST vendor mentioned in list order wins).
VENDORS = ["castorama", "leroy merlin", "manomano", "bricodepot", "mr bricolage"]

# Base hourly labour rate, EUR.
BASE_HOURLY_RATE = 40.0

# City multipliers; "Generic" is the fallback entry.
CITY_MODIFIERS = [("Generic", 1.0), ("Marseille", 1.0), ("Paris", 1.25), ("Lyon", 1.1)]

# Cities recognised by the labour parser, in pattern order.
LABOUR_CITIES = ["marseille", "paris", "lyon"]

# VAT keywords in priority order; "default" is the fallback, never matched.
VAT_RATES = [
    ("default", 0.20), ("tiling", 0.20), ("painting", 0.20), ("plumbing", 0.20),
    ("materials", 0.20), ("labor", 0.20), ("demolition", 0.20), ("toilet", 0.20),
    ("vanity", 0.20),
]

# Rate card: item -> (unit, cost).
RATE_CARD = [
    ("tiles_ceramic_m2", "m2", 25.0),
    ("toilet_standard", "each", 120.0),
    ("vanity_basic", "each", 100.0),
    ("paint_litre", "litre", 12.0),
    ("plumbing_parts", "job", 150.0),
    ("disposal_fee", "job", 50.0),
]

# Task templates: task name, default hours, default material, default quantity.
TASK_TEMPLATES = [
    ("Floor Tiling (ceramic)", 3.5, "tiles_ceramic_m2", 4.0),
    ("Repaint Walls", 4.0, "paint_litre", 5.0),
    ("Shower Plumbing (redo)", 6.0, "plumbing_parts", 1.0),
    ("Replace Toilet", 2.0, "toilet_standard", 1.0),
    ("Install Vanity", 2.0, "vanity_basic", 1.0),
    ("Demolition & Disposal", 2.0, "disposal_fee", 1.0),
]

# Task rules in fixed order: (needles, task name, carries the area).
TASK_RULES = [
    (["tile"], "Floor Tiling (ceramic)", True),
    (["paint", "repaint"], "Repaint Walls", False),
    (["plumb"], "Shower Plumbing (redo)", False),
    (["toilet"], "Replace Toilet", False),
    (["vanity"], "Install Vanity", False),
    (["remove old tile", "remove the old tiles"], "Demolition & Disposal", False),
]

# Hours rules, first match wins: (needles, hours with area rule, default hours).
#   tiling: 0.9 h per m2 when area > 0, else 4
#   painting: max(1, area / 10) when area > 0, else 3
#   plumbing: 6 when the name says redo/replace, else 4
#   demolition/disposal/remove: 2; toilet: 2; vanity: 2; anything else: 3
TILING_HOURS_PER_M2 = 0.9
TILING_DEFAULT_HOURS = 4.0
PAINT_M2_PER_HOUR = 10.0
PAINT_MIN_HOURS = 1.0
PAINT_DEFAULT_HOURS = 3.0
PLUMB_REDO_HOURS = 6.0
PLUMB_OTHER_HOURS = 4.0
SMALL_TASK_HOURS = 2.0
FALLBACK_HOURS = 3.0
# The same as a table, first match wins: groups of words of which each must have one in the
# name; hours an m2 as (numerator, denominator), if any; least hours; hours without an area.
HOURS_RULES = [
    ([["til"]], (TILING_HOURS_PER_M2, 1.0), 0.0, TILING_DEFAULT_HOURS),
    ([["paint"]], (1.0, PAINT_M2_PER_HOUR), PAINT_MIN_HOURS, PAINT_DEFAULT_HOURS),
    ([["plumb"], ["redo", "replace"]], None, 0.0, PLUMB_REDO_HOURS),
    ([["plumb"]], None, 0.0, PLUMB_OTHER_HOURS),
    ([["demol", "disposal", "remove", "toilet", "vanity"]], None, 0.0, SMALL_TASK_HOURS),
]
COMPLEXITY_FACTORS = [("high", 1.25), ("low", 0.9)]

# Proposal constants.
PROPOSAL_MARGIN = 10
PROPOSAL_DEFAULT_LABEL = "Tile bathroom walls"
PROPOSAL_DEFAULT_CITY = "Generic"

# Matching constants.
DEFAULT_LIMIT = 5
RESULT_CAP = 5
TIER_HIGH = 0.8
TIER_MEDIUM = 0.6

# Region from a host suffix, first match wins, else "Unknown".
HOST_REGIONS = [(".fr", "France"), (".be", "Belgium"), (".it", "Italy")]

# Area in square metres, in lower-cased text.
AREA_PATTERN = r"(\d+)\s?m[²2]"
# Product-page URL pattern (case-insensitive).
PRODUCT_URL_PATTERN = r"\.prd(?:$|[^a-zA-Z0-9])|/p/|/prd|/produit|/product"
# Add-to-cart text (case-insensitive).
ADD_TO_CART_PATTERN = r"Ajouter au panier"
# Price with euro sign and optional unit.
PRICE_PATTERN = r"(\d+[.,]?\d*)\s*€(?:\s*/\s*([A-Za-z0-9²]+))?"
# Title selectors, in order, then the page title.
TITLE_SELECTORS = ["h1", "[data-testid='product-title']", ".product-title",
                   ".product-name", "div[data-product-name]", "title"]
# Price selectors, in order.
PRICE_SELECTORS = ["span.price", ".product-price", ".lm-product-price",
                   "[data-testid='price']", ".price__value", ".price",
                   "div[data-price]", "meta[itemprop='price']"]
# Selectors that count as a price element for the product-page test.
PRICE_ELEMENT_SELECTORS = ["span.price", ".product-price", ".lm-product-price",
                           "[data-testid='price']"]

# Supplier configurations: (supplier, url, sitemap urls, product budget).
SUPPLIERS = [
    ("castorama", "https://www.castorama.fr/",
     ["https://www.castorama.fr/fstrz/sm/sitemap-prd.xml",
      "https://www.castorama.fr/fstrz/sm/sitemap-prd2.xml",
      "https://www.castorama.fr/fstrz/sm/sitemap-mkp.xml"], 100),
    ("leroy_merlin", "https://www.leroymerlin.fr/", [], 1000),
    ("manomano", "https://www.manomano.fr/", [], 1000),
]
DEFAULT_MIN_PRODUCTS = 100

# Product record fields, in order.
PRODUCT_FIELDS = ["product_id", "material_name", "description", "unit_price", "unit",
                  "region", "vendor", "vat_rate", "quality_score", "source"]

# Feedback user types.
FEEDBACK_USER_TYPES = ["contractor", "client"]
# ------------------------------------------------------------ END FIXED VALUES
