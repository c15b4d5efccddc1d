"""Catalog build on hand-made pages, budgets and the keyed upsert."""
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.sources import reference_data as RD

PAGE = ('<html><head><title>T &amp; Co</title></head><body><h1> Carrelage beige 60x60 </h1>'
        '<span class="price">24,90 €/m2</span><button>Ajouter au panier</button></body></html>')
PLAIN = '<html><head><title>Page</title></head><body><p>Prix 7,50 € / m2</p>Ajouter au panier</body></html>'
NOT_PRODUCT = '<html><body><h1>Blog</h1><p>nothing</p></body></html>'


def test_extract_products(spark):
    pages = spark.createDataFrame([
        (1, "https://www.castorama.fr/a", PAGE, "castorama", "s1", 0, 1),
        (2, "https://www.castorama.fr/b", PLAIN, "castorama", "s1", 0, 2),
        (3, "https://www.castorama.fr/c", NOT_PRODUCT, "castorama", "s1", 0, 3),
    ], "page_id long, url string, html string, supplier string, sitemap string, sitemap_no long, seq long")
    good, bad = C.extract_products(pages, RD.suppliers(spark))
    rows = {r["page_id"]: r for r in good.collect()}
    assert set(rows) == {1, 2} and bad.count() == 0
    assert rows[1]["material_name"] == "Carrelage beige 60x60"
    assert (rows[1]["unit_price"], rows[1]["unit"]) == ("24,90", "€/m²")
    assert (rows[2]["unit_price"], rows[2]["unit"]) == ("7,50", "€/m²")
    assert rows[1]["region"] == "France" and rows[1]["vendor"] == "Castorama"
    assert rows[1]["product_id"].startswith("castorama|")


def test_row_budget_whole_sitemaps(spark):
    prods = spark.createDataFrame([("x", f"s{s}", s, i, f"p{s}-{i}") for s in range(3) for i in range(4)],
                                  "supplier string, sitemap string, sitemap_order long, seq long, product_id string")
    budgets = spark.createDataFrame([("x", 3)], "supplier string, min_products int")
    kept = C.row_budget(prods, budgets)
    # per sitemap at most 3; the stop test follows each sitemap: s0 gives 3 >= 3, stop
    assert sorted(r["product_id"] for r in kept.collect()) == ["p0-0", "p0-1", "p0-2"]


def test_upsert_last_wins_and_idempotent(spark):
    target = spark.createDataFrame([("a", "1,00", 0, 0), ("b", "2,00", 0, 1)],
                                   "product_id string, unit_price string, batch_id int, seq long")
    batch = spark.createDataFrame([("a", "5,00", 1, 0), ("a", "6,00", 1, 1), ("c", "3,00", 1, 2)],
                                  "product_id string, unit_price string, batch_id int, seq long")
    once = C.upsert(target, batch)
    got = {r["product_id"]: r["unit_price"] for r in once.collect()}
    assert got == {"a": "6,00", "b": "2,00", "c": "3,00"}
    twice = {r["product_id"]: r["unit_price"] for r in C.upsert(once, batch).collect()}
    assert twice == got


def test_robots_lines(spark):
    df = spark.createDataFrame([("s", "User-agent: *\nSITEMAP: https://x.fr/a.xml\nsitemap:https://x.fr/b.xml")],
                               "supplier string, body string")
    got = [r["sitemap_url"] for r in C.robots_sitemaps(df).orderBy("line_no").collect()]
    assert got == ["https://x.fr/a.xml", "https://x.fr/b.xml"]


def test_sitemap_index_recursion(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    bodies = spark.createDataFrame([
        ("https://x.fr/index.xml", f"<sitemapindex {ns}><sitemap><loc>https://x.fr/a.xml</loc></sitemap></sitemapindex>"),
        ("https://x.fr/a.xml", f"<urlset {ns}><url><loc>https://x.fr/p/1</loc></url><url><loc>https://x.fr/p/2</loc></url></urlset>"),
    ], "url string, body string")
    roots = spark.createDataFrame([("x", 0, "https://x.fr/index.xml")], "supplier string, sitemap_order long, sitemap_url string")
    got = sorted(r["url"] for r in C.expand_sitemaps(roots, bodies).collect())
    assert got == ["https://x.fr/p/1", "https://x.fr/p/2"]


def test_title_entities_full_table_single_pass(spark):
    html = "<html><head><title>x</title></head><body><h1>Carrelage &eacute;maill&#233; &amp;eacute; 2&nbsp;m</h1></body></html>"
    df = spark.createDataFrame([(html,)], "html string")
    got = df.select(C.product_title(F.col("html")).alias("t")).first()["t"]
    assert got == "Carrelage émaillé &eacute; 2 m"


def _facts(spark, *pages):
    from tessera.functions.html import page_facts
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r["f"] for r in df.select("i", page_facts(F.col("html")).alias("f")).orderBy("i").collect()]


def test_page_facts_follow_the_markup(spark):
    nested, single, meta, attribute, title, empty, odd, script = _facts(
        spark,
        "<p>Livraison 50 €</p><div class=\"product-price\"><span>12,99</span> € / m2</div>",
        "<p>50 €</p><span class='old price'>9,50&nbsp;&#8364;</span>",
        "<meta itemprop='price' content='3'>Livraison 5 €",
        "<img alt='Ajouter au panier'><p>x</p>",
        "<title>Shop</title><div class=\"product-title\"><span> Tile</span> <b>A</b></div>",
        "", "<h1>a</h1><![foo <b>x</b></i>", "<script>var x = '8 €'</script><!-- 9 € --><p>7 €</p>")
    assert (nested["price_text"], nested["price_match"]) == ("12,99€ / m2", "12,99€ / m2")
    assert single["price_match"] == "9,50\xa0€" and single["has_price"]
    assert meta["price_text"] == "" and meta["price_match"] == "5 €"
    assert not attribute["has_cart"]
    assert title["title"] == "TileA"
    assert empty["title"] is None and empty["price_text"] is None and not empty["has_h1"]
    assert odd["title"] == "a"
    assert script["price_match"] == "7 €" and script["page_text"] == "7 €"


def test_sitemaps_of_any_shape_and_depth(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *u: f"<sitemapindex {ns}>" + "".join(f"<sitemap><lastmod>x</lastmod><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    bodies = spark.createDataFrame([
        *[(f"i{d}", index(f"i{d + 1}", "i0")) for d in range(5)],  # five levels and a cycle
        ("i5", f"<urlset {ns}><url><lastmod>2024</lastmod><loc> https://x.fr/a?b=1&amp;c=2 </loc></url>"
               "<url><loc><![CDATA[https://x.fr/c]]></loc></url></urlset>"),
        ("bad", "<urlset><url>"), ("none", None),
        ("s:p", '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://x.fr/d</s:loc></s:url></s:urlset>'),
    ], "url string, body string")
    roots = spark.createDataFrame([("x", 0, "i0"), ("x", 1, "s:p"), ("x", 2, "bad"), ("x", 3, "none"), ("x", 4, "lost")],
                                  "supplier string, sitemap_order long, sitemap_url string")
    got = sorted((r["sitemap_url"], r["seq"], r["url"]) for r in C.expand_sitemaps(roots, bodies).collect())
    assert got == [("i5", 0, "https://x.fr/a?b=1&c=2"), ("i5", 1, "https://x.fr/c"), ("s:p", 0, "https://x.fr/d")]
    assert {tuple(r) for r in C.sitemap_rejects(bodies).collect()} == {("bad", "malformed_xml"), ("none", "empty_body")}


def test_rows_without_an_id_are_rejects(spark):
    rows = spark.createDataFrame([(None, "a", None, 0), (None, "b", None, 1), ("p", None, None, 2), ("q", "c", None, 3)],
                                 "product_id string, material_name string, description string, seq long")
    assert [r["product_id"] for r in C.load_products(rows, None, 0).collect()] == ["q"]
    assert sorted(r["reject_reason"] for r in C.load_rejects(rows).collect()) == ["missing_id", "missing_id", "missing_name"]
