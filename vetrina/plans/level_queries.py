"""The four catalogue levels, their views and backfills, and run records over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vetrina.operators import assets, enrich, identity, resolve, snapshot, titles, views
from vetrina.plans.base import OFFERS, PRODUCTS, STORED, incoming_offers, offers, products, query, stored_offers, table
from vetrina.plans.feed_queries import _LIST
from vetrina.plans.snapshot_queries import _RESOLVED, _rows_to_resolve
from vetrina.sources import runs

_TIME = "timestamp '2024-06-01 00:00:00'"


def levels(spark, d):
    """(offers, variants, colour variants, products): parts as products of three variants each, the last without colour."""
    p = products(spark, d)
    parents = p.select(F.col("product_id").alias("id"), F.col("title").alias("canonical_title"), *"description brand product_type sottocategoria gender age_group".split())
    colors = p.where("color is not null").select((F.col("product_id") * 7 + 1).alias("id"), "product_id", F.concat_ws(" ", "title", "color").alias("colorway_title"))
    kinds = p.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    number = F.col("product_id") * 3 + F.col("k")
    color_id = F.when(F.col("color").isNotNull() & (F.col("k") < 2), F.col("product_id") * 7 + 1)
    variants = kinds.select(number.alias("id"), "product_id", F.concat(F.lit("v"), number.cast("string")).alias("variant_key"), color_id.alias("color_variant_id"), "color", "size", "material")
    merchants = table(spark, d, "supplier").select(F.col("s_suppkey").alias("advertiser_id"), F.lower("s_name").alias("advertiser_name"))
    own = offers(spark, d).join(merchants, "advertiser_id").withColumns(
        {
            "variant_id": F.col("product_id") * 3 + F.col("line") % 3,
            "image_link": F.when(F.col("quantity") % 2 == 0, F.concat(F.lit("i"), F.col("quantity").cast("string"))),
            "merchant_deep_link": F.col("source_product_id"),
            "aw_deep_link": F.lit(None).cast("string"),
            "currency": F.lit("EUR"),
            "last_seen_at": F.col("seen_at"),
        }
    )
    return own, variants, colors, parents


LEVELS = f"""{OFFERS}, {PRODUCTS},
parents AS (SELECT product_id AS id, title AS canonical_title, description, brand, product_type, sottocategoria, gender, age_group FROM products),
colors AS (SELECT product_id * 7 + 1 AS id, product_id, title || ' ' || color AS colorway_title FROM products WHERE color IS NOT NULL),
variants AS (
  SELECT product_id * 3 + k AS id, product_id, 'v' || (product_id * 3 + k) AS variant_key, CASE WHEN color IS NOT NULL AND k < 2 THEN product_id * 7 + 1 END AS color_variant_id, color, size, material
  FROM products, (SELECT unnest([0, 1, 2]) AS k)),
own AS (SELECT o.* EXCLUDE (product_id), product_id * 3 + line % 3 AS variant_id, lower(s_name) AS advertiser_name, CASE WHEN quantity % 2 = 0 THEN 'i' || quantity END AS image_link FROM offers o JOIN supplier ON s_suppkey = advertiser_id),
search AS (
  SELECT o.id, p.id AS product_id, c.id AS color_variant_id, colorway_title, v.id AS variant_id, variant_key AS sku, canonical_title AS title, description, brand, product_type, sottocategoria, gender, age_group, v.color, v.size, v.material,
         price, sale_price, CASE WHEN available THEN 1 ELSE 0 END AS availability, advertiser_name AS merchant, image_link, advertiser_id, source_product_id AS merchant_product_id
  FROM own o JOIN variants v ON v.id = o.variant_id LEFT JOIN colors c ON c.id = v.color_variant_id JOIN parents p ON p.id = v.product_id)"""
_SHOWN = "id product_id color_variant_id colorway_title variant_id sku title description brand product_type sottocategoria gender age_group color size material availability merchant image_link advertiser_id merchant_product_id".split()


@query("catalog_view", f"WITH {LEVELS} SELECT {', '.join(_SHOWN)}, CAST(price AS DOUBLE) AS price, CAST(sale_price AS DOUBLE) AS sale_price FROM search")
def catalog_view(spark, d):
    """The search view over all four levels."""
    found = views.catalog_search(*levels(spark, d))
    return found.select(*_SHOWN, F.col("price").cast("double").alias("price"), F.col("sale_price").cast("double").alias("sale_price"))


def _pictures(spark, d):
    """(visuals, assets): a picture for each vector, shared by vectors of one label, linked to the product of its number."""
    e = table(spark, d, "embeddings")
    sha = F.sha2(F.col("label").cast("string"), 256).alias("image_sha256")
    visuals = e.select(F.col("vec_id").alias("offer_id"), sha, F.concat(F.lit("c"), (F.col("vec_id") % 9).cast("string")).alias("effective_color"), (F.col("vec_id") % 2 == 0).alias("color_conflict"))
    seen = e.select(sha, F.concat(F.lit("seen "), F.col("label").cast("string")).alias("visual_primary_color"), F.col("label").alias("visual_confidence")).distinct()
    return visuals, seen


@query(
    "catalog_view_enriched",
    f"""WITH {PRODUCTS}, w AS (SELECT vec_id AS offer_id, label, 'c' || (vec_id % 9) AS effective_color, vec_id % 2 = 0 AS color_conflict FROM embeddings)
SELECT product_id AS id, title, effective_color, color_conflict, CAST(NULL AS VARCHAR) AS color_resolution, 'seen ' || label AS visual_primary_color, label AS visual_confidence, CAST(NULL AS VARCHAR) AS visual_material FROM products LEFT JOIN w ON offer_id = product_id""",
)
def catalog_view_enriched(spark, d):
    rows = products(spark, d).select(F.col("product_id").alias("id"), "title")
    found = views.catalog_search_enriched(rows, *_pictures(spark, d))
    return found.select("id", "title", "effective_color", "color_conflict", "color_resolution", "visual_primary_color", "visual_confidence", "visual_material")


@query(
    "visual_pilot",
    f"""WITH {LEVELS}, e AS (SELECT vec_id, label FROM embeddings)
SELECT e.vec_id AS number, o.id AS offer_id, v.product_id, o.advertiser_id, o.source_product_id, 'flat ' || o.source_product_id AS title, 'tag' || label AS tag
FROM e JOIN own o ON o.order_id = e.vec_id AND label % 3 <> 0 JOIN variants v ON v.id = o.variant_id JOIN parents p ON p.id = v.product_id""",
)
def visual_pilot(spark, d):
    """Offers with a vector and tags of one picture; tags of every third label belong to another picture."""
    own, variants, _, parents = levels(spark, d)
    e = table(spark, d, "embeddings").select("vec_id", "label")
    linked = own.select(F.col("id").alias("offer_id"), "order_id").join(e, F.col("order_id") == F.col("vec_id"))
    picture = F.sha2(F.col("vec_id").cast("string"), 256)
    vectors = linked.select("offer_id", picture.alias("image_sha256"), F.col("vec_id").alias("number"))
    other = F.when(F.col("label") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(picture)
    tags = linked.select("offer_id", other.alias("image_sha256"), F.concat(F.lit("tag"), F.col("label").cast("string")).alias("tag"))
    flat = own.select("advertiser_id", "source_product_id", F.concat(F.lit("flat "), "source_product_id").alias("title")).distinct()
    found = views.pilot(vectors, own, variants, parents, flat, tags)
    return found.select("number", "offer_id", "product_id", "advertiser_id", "source_product_id", "title", "tag")


@query(
    "color_variants",
    f"""WITH {_RESOLVED}, named AS (SELECT *, CASE WHEN feed_pos % 3 = 0 THEN 'model ' || title ELSE title END AS way FROM resolved)
SELECT color_variant_key, max_by(product_key, feed_pos) AS product_key, max_by(color, feed_pos) FILTER (WHERE color IS NOT NULL) AS color_label, max_by(way, feed_pos) AS colorway_title, max_by({{'m': model}}, feed_pos).m AS model_code, max_by('i' || feed_pos, feed_pos) AS image_link
FROM named GROUP BY color_variant_key""",
)
def color_variants(spark, d):
    rows = resolve.resolve(_rows_to_resolve(spark, d)).withColumn("image_link", F.concat(F.lit("i"), F.col("feed_pos").cast("string")))
    sure = F.col("feed_pos") % 3 == 0
    rows = rows.withColumns({"title": F.col("clean_title"), "model_title": F.when(sure, F.concat(F.lit("model "), "clean_title")), "model_match_confidence": F.when(sure, "high").otherwise("low")})
    return resolve.color_variants_of(rows)


@query(
    "color_backfill",
    f"""WITH {LEVELS}, keyed AS (SELECT DISTINCT v.product_id, v.color, canonical_title, md5(v.product_id || '|' || coalesce(lower(v.color), 'non_specificato') || '|' || canonical_title) AS color_variant_key FROM variants v JOIN parents p ON p.id = v.product_id)
SELECT color_variant_key, product_id, color AS color_label, canonical_title AS colorway_title FROM keyed WHERE NOT (brand_even(product_id) AND color IS NOT NULL)""".replace("brand_even(product_id)", "product_id IN (SELECT product_id FROM products WHERE material = 'lana')"),
)
def color_backfill(spark, d):
    """Colours of products, but for those of wool, which the table has already."""
    _, variants, _, parents = levels(spark, d)
    wool = variants.where("material = 'lana' and color is not null").join(parents.select(F.col("id").alias("product_id"), "canonical_title"), "product_id")
    known = wool.select(resolve.plain_color_key(wool).alias("color_variant_key")).distinct()
    return resolve.backfilled_color_variants(variants, parents, known)


@query(
    "color_ids_backfill",
    f"WITH {LEVELS} SELECT v.id, coalesce(color_variant_id, CASE WHEN v.color IS NOT NULL THEN 100000000 + v.product_id END) AS color_variant_id FROM variants v",
)
def color_ids_backfill(spark, d):
    _, variants, _, parents = levels(spark, d)
    rows = products(spark, d).where("color is not null").select("product_id", "color", F.col("title").alias("canonical_title"))
    known = rows.select((F.col("product_id") + 100_000_000).alias("id"), resolve.plain_color_key(rows).alias("color_variant_key"))
    return resolve.with_color_variants(variants, parents, known).select("id", "color_variant_id")


@query(
    "description_backfill",
    f"""WITH {LEVELS}, texts AS (SELECT v.product_id, min('flat ' || source_product_id) AS t FROM own o JOIN variants v ON v.id = o.variant_id WHERE quantity % 2 = 0 GROUP BY 1)
SELECT p.id, coalesce(p.description, t) AS description FROM parents p LEFT JOIN texts ON texts.product_id = p.id""".replace("WHERE quantity % 2 = 0 GROUP BY 1", "WHERE source_product_id IN (SELECT source_product_id FROM own WHERE quantity % 2 = 0) GROUP BY 1"),
)
def description_backfill(spark, d):
    own, variants, _, parents = levels(spark, d)
    even = own.where("quantity % 2 = 0").select("source_product_id").distinct()
    flat = own.select("advertiser_id", "source_product_id").distinct().join(even.withColumn("_even", F.lit(True)), "source_product_id", "left")
    flat = flat.withColumn("description", F.when(F.col("_even"), F.concat(F.lit("flat "), "source_product_id")))
    return resolve.with_descriptions(parents, variants, own, flat).select("id", "description")


@query(
    "title_refresh",
    f"""WITH rows_ AS (SELECT p_partkey AS id, p_name, p_partkey % 4 AS k FROM part),
words AS (SELECT *, array_to_string(list_filter(string_split(p_name, ' '), lambda w: NOT list_contains({_LIST}, w)), ' ') AS left_over FROM rows_)
SELECT id, CASE k WHEN 3 THEN 'kept' WHEN 2 THEN coalesce(nullif(left_over, ''), p_name) ELSE coalesce(nullif(left_over, ''), p_name) END AS title,
       CASE k WHEN 3 THEN 'Old' ELSE coalesce(nullif(left_over, ''), p_name) END AS clean_title, CASE k WHEN 3 THEN ' ' WHEN 2 THEN p_name ELSE p_name || ' - 4' || k END AS source_title
FROM words""".replace("'kept'", "''"),
)
def title_refresh(spark, d):
    """Titles from a source title, from the title where there is none, and rows without either."""
    key = F.col("p_partkey") % 4
    source = F.when(key == 3, " ").when(key < 2, F.concat("p_name", F.lit(" - 4"), key.cast("string")))
    flat = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(key == 3, "").otherwise(F.col("p_name")).alias("title"), F.lit("Old").alias("clean_title"), source.alias("source_title"), F.lit(None).cast("string").alias("brand"))
    return titles.refreshed(flat).select("id", "title", "clean_title", "source_title")


@query("flat_deactivation", f"WITH {OFFERS} SELECT id, CASE WHEN advertiser_id IN (SELECT advertiser_id FROM offers WHERE quantity = 1) AND CASE flag WHEN 'A' THEN 'r1' WHEN 'N' THEN 'r0' END IS DISTINCT FROM 'r1' THEN 0 ELSE 1 END AS availability FROM offers")
def flat_deactivation(spark, d):
    rows = offers(spark, d)
    flat = rows.select("id", "advertiser_id", F.when(F.col("flag") == "A", "r1").when(F.col("flag") == "N", "r0").alias("last_seen_run"), F.lit(1).alias("availability"))
    return snapshot.deactivate_flat(flat, rows.where("quantity = 1"), "r1").select("id", "availability")


@query(
    "late_ean_offers",
    f"""WITH {OFFERS}, own AS (SELECT id, 'k' || product_id AS old_key, CASE WHEN product_id % 4 = 0 THEN 'e' || product_id END AS ean FROM offers),
found AS (SELECT 'k' || product_id AS old_key, 'e' || (quantity * 40 + line) AS ean FROM offers),
free AS (SELECT ean, min(old_key) AS old_key FROM found WHERE old_key NOT IN (SELECT old_key FROM own WHERE ean IS NOT NULL) AND ean NOT IN (SELECT ean FROM own WHERE ean IS NOT NULL) GROUP BY ean),
one AS (SELECT old_key, min(ean) AS late FROM free GROUP BY old_key)
SELECT id, CASE WHEN ean IS NOT NULL THEN 'ean:' || ean WHEN late IS NOT NULL THEN 'ean:' || late ELSE own.old_key END AS variant_key FROM own LEFT JOIN one USING (old_key)""",
)
def late_ean_offers(spark, d):
    key = F.col("product_id").cast("string")
    rows = offers(spark, d)
    ean = F.when(F.col("product_id") % 4 == 0, F.concat(F.lit("e"), key))
    own = rows.select("id", F.coalesce(F.concat(F.lit("ean:"), ean), F.concat(F.lit("k"), key)).alias("variant_key"), ean.alias("ean"))
    found = rows.where("product_id % 4 <> 0").select(F.concat(F.lit("k"), key).alias("variant_key"), F.concat(F.lit("e"), (F.col("quantity") * 40 + F.col("line")).cast("string")).alias("ean"))
    return snapshot.with_late_eans(own, found).select("id", "variant_key")


@query(
    "resolution_with_stored",
    f"""WITH {_RESOLVED}, old AS (
  SELECT *, k AS product_key_, CASE WHEN feed_pos % 2 = 0 THEN 'high' END AS sure, 'model ' || title AS named FROM own WHERE feed_pos % 3 = 0),
old_keyed AS (SELECT *, sha256(CASE WHEN model IS NOT NULL THEN 'mpn:' || brand || '|' || model WHEN sure = 'high' THEN 'gemini-model:' || brand || '|' || named ELSE 'merchant:' || advertiser_id || '|' || brand || '|' || title END) AS pk FROM old),
by_ean AS (SELECT ean, min_by(pk, {{'a': feed_pos % 10, 'b': pk}}) AS e FROM old_keyed WHERE ean IS NOT NULL GROUP BY ean),
by_part AS (SELECT brand, model, min_by(pk, {{'a': feed_pos % 10, 'b': pk}}) AS m FROM old_keyed WHERE model IS NOT NULL GROUP BY ALL),
by_title AS (SELECT brand, named, min_by(pk, {{'a': feed_pos % 10, 'b': pk}}) AS t FROM old_keyed WHERE sure = 'high' GROUP BY ALL)
SELECT feed_pos, coalesce(e, m, CASE WHEN feed_pos % 2 = 1 THEN t END) AS known FROM own LEFT JOIN by_ean USING (ean) LEFT JOIN by_part USING (brand, model) LEFT JOIN by_title ON by_title.brand = own.brand AND named = 'model ' || title""",
)
def resolution_with_stored(spark, d):
    """All rows looked up among the stored products of a third of them, by EAN, part number and title."""
    rows = _rows_to_resolve(spark, d).withColumn("model_title", F.concat(F.lit("model "), "clean_title"))
    old = rows.where("feed_pos % 3 = 0").withColumn("model_match_confidence", F.when(F.col("feed_pos") % 2 == 0, "high"))
    old = old.withColumns({"first_seen_at": F.timestamp_seconds(F.col("feed_pos") % 10), "product_key": resolve.fallback_key(old)})
    new = rows.withColumn("model_match_confidence", F.when(F.col("feed_pos") % 2 == 1, "high"))
    return resolve.stored_keys(new, old).select("feed_pos", F.col("_known").alias("known"))


_KINDS = ["new", "content", "reactivated", "updated", "unchanged"]


@query(
    "run_log_failed",
    f"WITH {STORED} SELECT 'failed' AS status, 'OSError: disk full' AS error, 'merchant 7: 30 of 40 offers missing, deactivation suspended' AS warnings, CAST(0.5 AS DOUBLE) AS cost, count(*) AS received, "
    + ", ".join(f'count(*) FILTER (WHERE kind = \'{k}\') AS "{k}"' for k in _KINDS)
    + ", CAST(0 AS BIGINT) AS deactivated FROM classified",
)
def run_log_failed(spark, d):
    """The record of a run that stopped: what it had counted, its warnings and its error."""
    counts = runs.class_counters(identity.classify(identity.match_stored(incoming_offers(spark, d), stored_offers(spark, d)))).first().asDict()
    warnings = runs.deactivation_warnings(10, 1, [{"advertiser_id": 7, "missing": 30, "seen": 10}])
    row = runs.record("r", runs.run_status(True, 0), datetime(2024, 1, 1), datetime(2024, 1, 2), {**counts, "received": counts["total"]}, warnings, "OSError: disk full", 0.5)
    return spark.createDataFrame([row], runs.RECORD).select("status", "error", "warnings", "cost", "received", *_KINDS, "deactivated")


@query("cache_put", "WITH c AS (SELECT sha256(coalesce(text, '')) AS content_hash, doc_id, lang FROM documents) SELECT content_hash, max(CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END ORDER BY 1) AS brand FROM c GROUP BY content_hash".replace("max(CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END ORDER BY 1)", "CASE WHEN bool_or(lang = 'en') THEN 'new' ELSE 'old' END"))
def cache_put(spark, d):
    """A cache of all contents, of which those in English are answered anew."""
    rows = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "lang")
    answer = lambda brand: F.create_map(F.lit("brand"), F.lit(brand)).alias("fields")
    cache = rows.select("content_hash").distinct().select("content_hash", answer("old"))
    new = rows.where("lang = 'en'").select("content_hash").distinct().select("content_hash", answer("new"))
    return enrich.put_cache(cache, new).select("content_hash", F.col("fields")["brand"].alias("brand"))


@query("embedding_append", "SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + m AS vec_id, label FROM embeddings, (SELECT max(vec_id) AS m FROM embeddings) WHERE vec_id > 0")
def embedding_append(spark, d):
    """Vectors whose pictures are not there yet are appended to those that are."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    most = e.agg(F.max("vec_id").alias("_m"))
    wanted = e.unionByName(e.join(F.broadcast(most), F.lit(True)).select((F.col("vec_id") + F.col("_m")).alias("vec_id"), "label"))  # one row
    return e.unionByName(assets.missing(wanted, e, ["vec_id"]))


@query("brand_normalize", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN CASE s_suppkey % 4 WHEN 1 THEN lower(replace(replace(s_name, '#', ' '), '  ', ' ')) WHEN 2 THEN 'cafe ' || s_suppkey END END AS brand FROM supplier")
def brand_normalize(spark, d):
    """Names, names with accents, and words that mean no brand."""
    from vetrina.functions.text import normalized_brand

    key = F.col("s_suppkey") % 4
    raw = F.when(key == 0, " No Brand ").when(key == 1, F.col("s_name")).when(key == 2, F.concat(F.lit("Café, "), F.col("s_suppkey").cast("string"))).otherwise("N/A")
    return table(spark, d, "supplier").select("s_suppkey", normalized_brand(raw).alias("brand"))
