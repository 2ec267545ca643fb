"""Search, ranking and facets over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetrina.functions.values import size_order
from vetrina.operators import search as s
from vetrina.operators.requests import respond
from vetrina.operators.search import Filters, ManualFilters, predicate
from vetrina.plans.base import OFFERS, PRODUCT_VIEW, VIEW, offers, product_view, query, table, view



def _flat(df):
    return df.select("id", "score", F.concat_ws(" | ", "reasons").alias("reasons"))


def _rank_sql(parts: list[tuple[str, int, str]], page: str) -> str:
    """Score and reasons in SQL from (condition, points, reason)."""
    score = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in parts)
    reasons = ", ".join(f"CASE WHEN {c} THEN {r} END" for c, _, r in parts)
    return f"""scored AS (
  SELECT id, position, {score} AS score, list_filter([{reasons}], lambda x: x IS NOT NULL) AS all_reasons FROM {page}),
ranked AS (
  SELECT id, position, score, CASE WHEN len(all_reasons) = 0 THEN 'corrisponde ai filtri applicati' ELSE array_to_string(all_reasons[1:3], ' | ') END AS reasons FROM scored)"""


_FLAGSHIP = Filters(product_type="g", color="red, blue", color_logic="OR", max_price=60000.0, brand="brand#")


@query(
    "search_ranked",
    f"""WITH {VIEW}, page AS (
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM view_
  WHERE availability = 1 AND brand ILIKE '%brand#%' AND (color ILIKE '%red%' OR color ILIKE '%blu%') AND (product_type ILIKE '%g%' OR sottocategoria ILIKE '%g%' OR title ILIKE '%g%')
    AND CASE WHEN sale_price > 0 THEN sale_price ELSE price END <= 60000
  ORDER BY id LIMIT 30),
{_rank_sql([("contains(brand, 'brand')", 30, "'marca ' || brand"), ("contains(concat_ws(' ', product_type, sottocategoria, title), 'g')", 20, "'tipologia ' || product_type"), ("contains(color, 'red') OR contains(color, 'blue')", 15, "'colore ' || color")], "page")}
SELECT id, score, reasons, row_number() OVER (ORDER BY score DESC, position) AS place FROM ranked""",
)
def search_ranked(spark, d):
    """A page, ranked, with the place of each result."""
    found = s.search(view(spark, d), _FLAGSHIP)
    placed = s.numbered(found, F.col("score").desc(), F.col("position"))
    return placed.select("id", "score", F.concat_ws(" | ", "reasons").alias("reasons"), F.col("place").cast("long").alias("place"))


_RED, _RING = Filters(color="red", gender="uomo"), Filters(sottocategoria="ring", color="red", color_logic="OR")


@query(
    "search_multi_merge",
    f"""WITH {PRODUCT_VIEW},
page1 AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM pview WHERE availability = 1 AND lower(gender) = 'uomo' AND color ILIKE '%red%' ORDER BY id LIMIT 15),
page2 AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM pview WHERE availability = 1 AND color ILIKE '%red%' AND (sottocategoria ILIKE '%ring%' OR title ILIKE '%ring%') ORDER BY id LIMIT 15),
merged AS (
  SELECT id, position, 0 AS sub, 15 + 8 AS score, 'colore ' || color || ' | genere ' || gender AS reasons FROM page1
  UNION ALL SELECT id, position, 1, 35 + 15, 'categoria ' || sottocategoria || ' | colore ' || color FROM page2)
SELECT id, score, reasons FROM merged QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, sub, position) = 1""",
)
def search_multi_merge(spark, d):
    return _flat(s.search(product_view(spark, d), Filters(sub_queries=(_RED, _RING))))


def _ids(where: str) -> str:
    return f"WITH {PRODUCT_VIEW} SELECT id, title FROM pview WHERE availability = 1 AND {where}"


def _matching(filters: Filters):
    return lambda spark, d: product_view(spark, d).where(predicate(filters)).select("id", "title")


@query("search_color_and", f"WITH {PRODUCT_VIEW}, two AS (SELECT * REPLACE (concat_ws(' e ', color, material) AS color) FROM pview) SELECT id, color FROM two WHERE availability = 1 AND color ILIKE '%red%' AND color ILIKE '%coton%'")
def search_color_and(spark, d):
    rows = product_view(spark, d).withColumn("color", F.concat_ws(" e ", "color", "material"))
    return rows.where(predicate(Filters(color="red e cotone"))).select("id", "color")


query("search_color_or", _ids("(color ILIKE '%red%' OR color ILIKE '%blu%')"))(_matching(Filters(color="red, blue", color_logic="or")))
query("search_material_brand", _ids("brand ILIKE '%brand#2%' AND merchant ILIKE '%shop%' AND (material ILIKE '%cot%' OR material ILIKE '%lan%')").replace("%cot%", "%coton%"))(_matching(Filters(brand="brand#2", merchant="SHOP", material="cotone e lana", material_logic="OR")))
query("search_exclude", _ids("NOT title ILIKE '%old%' AND NOT coalesce(description, '') ILIKE '%old%' AND (NOT color ILIKE '%red%' OR color IS NULL) AND (NOT material ILIKE '%lana%' OR material IS NULL) AND NOT coalesce(product_type, '') ILIKE '%promo%' AND NOT title ILIKE '%promo%'"))(_matching(Filters(unwanted=("old",), excluded_color="red", excluded_material="lana", excluded_product_type="promo")))
query("search_exact_size", _ids("len(list_filter(string_split(coalesce(size, ''), ','), lambda x: lower(trim(x)) = '13.5')) > 0"))(_matching(Filters(size=" 13.5 ")))
query("search_product_types", _ids("(product_type ILIKE '%promo%' OR sottocategoria ILIKE '%promo%' OR title ILIKE '%promo%' OR product_type ILIKE '%bolt%' OR sottocategoria ILIKE '%bolt%' OR title ILIKE '%bolt%') AND lower(age_group) = 'adulto' AND lower(condizione) = 'nuovo'"))(_matching(Filters(product_types_list=("promo", "bolt"), product_type="ignored", age_group="Adulti", condizione="Nuovo")))
query("search_wildcards", _ids("(title ILIKE '%w_dget%' OR description ILIKE '%w_dget%' OR product_type ILIKE '%w_dget%' OR sottocategoria ILIKE '%w_dget%' OR title ILIKE '%b%lt%' OR description ILIKE '%b%lt%' OR product_type ILIKE '%b%lt%' OR sottocategoria ILIKE '%b%lt%')"))(_matching(Filters(search_keywords="w_dget b%lt")))


@query("search_wildcard_escaped", f"WITH {PRODUCT_VIEW} SELECT id FROM pview WHERE availability = 1 AND product_id % 3 = 1")
def search_wildcard_escaped(spark, d):
    """Titles with the signs themselves, with one of them, and with neither."""
    key = F.col("product_id") % 3
    rows = product_view(spark, d).withColumn("title", F.concat("title", F.when(key == 0, " 100%").when(key == 1, " 100%_a").otherwise(" 100 a")))
    return rows.where(predicate(Filters(search_keywords="%_"), escaped=True)).select("id")


@query("search_price_band", f"WITH {OFFERS} SELECT id, CAST(CASE WHEN sale_price > 0 THEN sale_price ELSE price END AS DOUBLE) AS effective FROM offers WHERE available AND CASE WHEN sale_price > 0 THEN sale_price ELSE price END BETWEEN 1000 AND 20000")
def search_price_band(spark, d):
    from vetrina.functions.values import effective_price

    rows = offers(spark, d).withColumn("availability", F.when(F.col("available"), 1).otherwise(0))
    return rows.where(predicate(Filters(min_price=1000.0, max_price=20000.0))).select("id", effective_price(F.col("price"), F.col("sale_price")).cast("double").alias("effective"))


@query("search_on_sale_sorted", f"WITH {OFFERS} SELECT id, CAST(price AS DOUBLE) AS price, CAST(sale_price AS DOUBLE) AS sale_price, row_number() OVER (ORDER BY coalesce(sale_price, price) DESC, id) - 1 AS position FROM offers WHERE available AND sale_price < price ORDER BY coalesce(sale_price, price) DESC, id LIMIT 50 OFFSET 10".replace("- 1 AS position", "- 11 AS position"))
def search_on_sale_sorted(spark, d):
    rows = offers(spark, d).withColumn("availability", F.when(F.col("available"), 1).otherwise(0))
    page = s.query_page(rows, Filters(only_on_sale=True, sort_by="price_desc"), 50, 10)
    return page.select("id", F.col("price").cast("double").alias("price"), F.col("sale_price").cast("double").alias("sale_price"), F.col("position").cast("long").alias("position"))


_WORDS = ["tion", "ouen", "ciones", "with"]


@query("search_keywords", "SELECT doc_id AS id, least(4 * (" + " + ".join(f"CASE WHEN contains(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), '{w}') THEN 1 ELSE 0 END" for w in _WORDS) + "), 20) AS score FROM documents WHERE " + " OR ".join(f"text ILIKE '%{w}%'" for w in _WORDS))
def search_keywords(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("description", "product_type", "sottocategoria")), F.lit(1).alias("availability"), F.col("doc_id").alias("position"))
    f = Filters(search_keywords=", ".join([*_WORDS, "a", "il"]).replace(", a, il", ""))
    return s.rank(docs.where(predicate(f)), f).select("id", "score")


@query(
    "rank_reasons",
    f"""WITH {PRODUCT_VIEW}, page AS (SELECT *, id AS position FROM pview WHERE availability = 1),
{_rank_sql([("contains(concat_ws(' ', product_type, sottocategoria, title), 'gizmo')", 35, "'categoria ' || sottocategoria"), ("NOT contains(concat_ws(' ', product_type, sottocategoria, title), 'gizmo') AND contains(concat_ws(' ', product_type, sottocategoria, title), 'promo')", 20, "'tipologia ' || product_type"), ("(contains(coalesce(color, ''), 'hot') OR contains(coalesce(color, ''), 'cold'))", 15, "'colore ' || color"), ("coalesce(material, '') = 'lana'", 10, "'materiale ' || material"), ("coalesce(gender, '') = 'donna'", 8, "'genere ' || gender"), ("contains(merchant, 'shop 3')", 8, "'negozio ' || merchant")], "page")}
SELECT id, score, reasons FROM ranked""",
)
def rank_reasons(spark, d):
    f = Filters(sottocategoria="gizmo", product_type="promo", color="hot o cold", material="lana", material_logic="AND", gender="donna", merchant="Shop 3")
    rows = product_view(spark, d).where("availability = 1").withColumn("position", F.col("id"))
    return _flat(s.rank(rows, f))


@query("facet_merchants", f"WITH {VIEW} SELECT DISTINCT merchant FROM view_ WHERE availability = 1")
def facet_merchants(spark, d):
    return s.merchants(view(spark, d))


@query(
    "facet_sizes",
    f"""WITH {PRODUCT_VIEW}, found AS (SELECT DISTINCT trim(x) AS size FROM (SELECT unnest(string_split(CASE WHEN product_id % 9 = 0 THEN 'XL' WHEN product_id % 9 = 1 THEN 'taglia unica' ELSE size END, ',')) AS x FROM pview WHERE availability = 1) WHERE trim(x) <> '')
SELECT size, row_number() OVER (ORDER BY CASE WHEN size = 'XL' THEN 6 ELSE 99 END, try_cast(nullif(regexp_extract(size, '^[0-9.]+'), '') AS DOUBLE) NULLS LAST, size) AS place FROM found""",
)
def facet_sizes(spark, d):
    """Distinct sizes, letters first, then numbers, then words, with their place."""
    key = F.col("product_id") % 9
    rows = product_view(spark, d).withColumn("size", F.when(key == 0, "XL").when(key == 1, "taglia unica").otherwise(F.col("size")))
    found = s.sizes(rows)
    return s.numbered(found, *size_order(F.col("size"))).select("size", F.col("place").cast("long").alias("place"))


@query("health_counts", f"WITH {OFFERS} SELECT count(*) FILTER (WHERE available) AS n FROM offers")
def health_counts(spark, d):
    rows = offers(spark, d).withColumn("availability", F.when(F.col("available"), 1).otherwise(0))
    return s.available_count(rows)


@query("cart_totals", f"WITH {PRODUCT_VIEW} SELECT CASE WHEN id % 2 = 0 THEN 'EUR' ELSE 'GBP' END AS currency, CAST(sum(CASE WHEN sale_price > 0 AND sale_price < price THEN sale_price ELSE price END) AS DOUBLE) AS total, count(*) AS items FROM pview GROUP BY 1")
def cart_totals(spark, d):
    from vetrina.operators.state import cart_totals as totals

    return totals(product_view(spark, d).withColumn("currency", F.when(F.col("id") % 2 == 0, "EUR").otherwise("GBP"))).withColumn("total", F.col("total").cast("double"))


@query("search_overlay", _ids("lower(gender) = 'donna' AND merchant ILIKE '%shop 2%' AND len(list_filter(string_split(coalesce(size, ''), ','), lambda x: lower(trim(x)) = '10')) > 0 AND color ILIKE '%red%'") + " UNION ALL " + f"SELECT id, title FROM ({_ids('lower(gender) = chr(117) || chr(111) || chr(109) || chr(111)')})")
def search_overlay(spark, d):
    """Manual choices replace extracted ones; values that mean no choice leave them."""
    chosen = s.overlay(Filters(gender="uomo", merchant="shop 1", color="red"), ManualFilters(merchant="Shop 2", gender="Donna", size="10", max_price=250))
    kept = s.overlay(Filters(gender="uomo"), ManualFilters())
    rows = product_view(spark, d)
    return rows.where(predicate(chosen)).unionByName(rows.where(predicate(kept))).select("id", "title")


@query(
    "search_respond",
    f"""WITH {PRODUCT_VIEW}, page AS (SELECT *, row_number() OVER (ORDER BY coalesce(sale_price, price) DESC, id) - 1 AS position FROM pview
  WHERE availability = 1 AND CASE WHEN sale_price > 0 THEN sale_price ELSE price END <= 240 + 900 AND (material ILIKE '%lan%' AND material IS NOT NULL) ORDER BY coalesce(sale_price, price) DESC, id LIMIT 30)
SELECT id, 10 AS score, 'materiale lana' AS reasons, position + 1 AS place FROM page""",
)
def search_respond(spark, d):
    """A request as it comes in: its body, what a model made of its text, and the ranked page."""
    view_ = product_view(spark, d).withColumns({c: F.col(c) - 900 for c in ("price", "sale_price")})
    found = respond(view_, {"query": " lana cara ", "filters": {"maxPrice": 240}}, lambda q: {"material": "lana", "sort_by": "price_desc", "unknown": 1} if q == "lana cara" else None)
    placed = s.numbered(found, F.col("score").desc(), F.col("position"))
    return placed.select("id", "score", F.concat_ws(" | ", "reasons").alias("reasons"), F.col("place").cast("long").alias("place"))
