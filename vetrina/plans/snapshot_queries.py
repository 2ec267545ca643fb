"""Dedup, matching, classification, upserts and resolution over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetrina.functions.text import family_title
from vetrina.operators import assets, identity, resolve, sampling, snapshot, titles
from vetrina.plans.base import OFFERS, PRODUCTS, STORED, VIEW, incoming_offers, offers, products, query, stored_offers, table, view
from vetrina.sources import feed, runs

_IDENTITY = ["advertiser_id", "source_product_id"]


@query("dedup_first", f"WITH {OFFERS} SELECT id, advertiser_id, source_product_id, available FROM offers QUALIFY row_number() OVER (PARTITION BY advertiser_id, source_product_id ORDER BY seen_at, id) = 1")
def dedup_first(spark, d):
    return identity.first_by(offers(spark, d), _IDENTITY, "seen_at", "id").select("id", *_IDENTITY, "available")


@query("dedup_last", f"WITH {OFFERS} SELECT id, source_product_id FROM offers QUALIFY row_number() OVER (PARTITION BY source_product_id ORDER BY seen_at DESC, id DESC) = 1")
def dedup_last(spark, d):
    return identity.last_by(offers(spark, d), ["source_product_id"], "seen_at", "id").select("id", "source_product_id")


@query("hash_representative", "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents) SELECT content_hash, max(doc_id) AS doc_id, min(doc_id) AS first_pos FROM h GROUP BY content_hash")
def hash_representative(spark, d):
    from vetrina.operators.enrich import representatives

    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return representatives(docs, "doc_id")


@query("classify_snapshot", f"WITH {STORED} SELECT advertiser_id, source_product_id, stored_id, kind FROM classified")
def classify_snapshot(spark, d):
    found = identity.classify(identity.match_stored(incoming_offers(spark, d), stored_offers(spark, d)))
    return found.select(*_IDENTITY, F.col("stored.id").alias("stored_id"), "kind")


@query("classify_counts", f"WITH {STORED} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE kind = '{c}') AS {c}" for c in runs.CLASSES) + " FROM classified")
def classify_counts(spark, d):
    return runs.class_counters(identity.classify(identity.match_stored(incoming_offers(spark, d), stored_offers(spark, d))))


_NOW, _THEN = "timestamp '2024-06-01 00:00:00'", "timestamp '2024-05-01 00:00:00'"


@query("touch_unchanged", f"WITH {STORED} SELECT id, CASE WHEN id IN (SELECT stored_id FROM classified WHERE kind = 'unchanged') THEN 'now' ELSE 'then' END AS seen FROM stored")
def touch_unchanged(spark, d):
    stored = stored_offers(spark, d)
    kinds = identity.classify(identity.match_stored(incoming_offers(spark, d), stored))
    same = kinds.where("kind = 'unchanged'").select(F.col("stored.id").alias("id"))
    out = snapshot.touch(stored.withColumn("last_seen_at", F.expr(_THEN)), same, ["id"], F.expr(_NOW))
    return out.select("id", F.when(F.col("last_seen_at") == F.expr(_NOW), "now").otherwise("then").alias("seen"))


@query(
    "operational_update",
    f"""WITH {STORED}, changed AS (SELECT stored_id AS id, min_by(price, source_product_id) AS price, min_by(sale_price, source_product_id) AS sale_price, min_by(ean, source_product_id) AS ean FROM classified WHERE kind IN ('updated', 'reactivated') GROUP BY stored_id)
SELECT s.id, CAST(CASE WHEN c.id IS NULL THEN s.price ELSE c.price END AS DOUBLE) AS price, CAST(CASE WHEN c.id IS NULL THEN s.sale_price ELSE c.sale_price END AS DOUBLE) AS sale_price, coalesce(c.ean, s.ean) AS ean, s.available OR c.id IS NOT NULL AS available
FROM stored s LEFT JOIN changed c USING (id)""".replace("min_by(sale_price, source_product_id)", "min_by({'v': sale_price}, source_product_id).v").replace("min_by(ean, source_product_id)", "min_by({'v': ean}, source_product_id).v"),
)
def operational_update(spark, d):
    stored = stored_offers(spark, d)
    kinds = identity.classify(identity.match_stored(incoming_offers(spark, d), stored)).where("kind in ('updated', 'reactivated')")
    changed = identity.first_by(kinds.select(F.col("stored.id").alias("id"), "source_product_id", "price", "sale_price", "ean"), ["id"], "source_product_id").drop("source_product_id")
    out = snapshot.operational_update(stored.withColumn("last_seen_at", F.expr(_THEN)), changed, ["id"], F.expr(_NOW))
    return out.select("id", F.col("price").cast("double").alias("price"), F.col("sale_price").cast("double").alias("sale_price"), "ean", "available")


@query(
    "upsert_keep_enriched",
    f"""WITH {PRODUCTS}, old AS (SELECT product_id, title, color, material, 'first' AS seen FROM products),
new AS (SELECT product_id * 2 AS product_id, upper(title) AS title, CASE WHEN product_id % 2 = 0 THEN 'new ' || color END AS color, 'velluto' AS material, 'second' AS seen FROM products)
SELECT coalesce(n.product_id, o.product_id) AS product_id, CASE WHEN n.product_id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.color, o.color) AS color, coalesce(o.material, n.material) AS material, coalesce(o.seen, n.seen) AS seen
FROM old o FULL JOIN new n USING (product_id)""",
)
def upsert_keep_enriched(spark, d):
    p = products(spark, d)
    old = p.select("product_id", "title", "color", "material", F.lit("first").alias("seen"))
    new = p.select((F.col("product_id") * 2).alias("product_id"), F.upper("title").alias("title"), F.when(F.col("product_id") % 2 == 0, F.concat(F.lit("new "), "color")).alias("color"), F.lit("velluto").alias("material"), F.lit("second").alias("seen"))
    return snapshot.upsert(old, new, ["product_id"], keep_old=["color"], prefer_old=["material"], once=["seen"])


@query("flat_rekey", "SELECT CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN 'ean:' || s_suppkey ELSE CASE WHEN s_suppkey % 3 = 1 AND (s_suppkey - 1) % 2 = 0 AND s_suppkey > 0 THEN 'ean:' || (s_suppkey - 1) ELSE 'id:' || s_suppkey END END AS sku, s_suppkey FROM supplier")
def flat_rekey(spark, d):
    key = F.col("s_suppkey")
    taken = (key % 3 == 1) & ((key - 1) % 2 == 0) & (key > 0)
    flat = table(spark, d, "supplier").select(F.when(taken, F.concat(F.lit("ean:"), (key - 1).cast("string"))).otherwise(F.concat(F.lit("id:"), key.cast("string"))).alias("sku"), "s_suppkey")
    renames = flat.where(key % 3 == 0).select(F.col("sku").alias("old_sku"), F.concat(F.lit("ean:"), key.cast("string")).alias("new_sku"))
    return snapshot.rekey_flat(flat, renames)


@query(
    "late_ean_attach",
    f"""WITH {OFFERS}, variants AS (SELECT product_id AS variant_id, 'key' || product_id AS variant_key, CASE WHEN product_id % 4 = 0 THEN 'e' || product_id END AS ean FROM (SELECT DISTINCT product_id FROM offers)),
found AS (SELECT product_id AS variant_id, 'e' || (quantity * 40 + line) AS ean FROM offers WHERE line <= 2),
free AS (SELECT ean, min(variant_id) AS variant_id FROM found WHERE ean NOT IN (SELECT ean FROM variants WHERE ean IS NOT NULL) GROUP BY ean),
one AS (SELECT variant_id, min(ean) AS late FROM free GROUP BY variant_id)
SELECT variant_id, CASE WHEN ean IS NULL AND late IS NOT NULL THEN 'ean:' || late ELSE variant_key END AS variant_key, coalesce(ean, late) AS ean FROM variants LEFT JOIN one USING (variant_id)""",
)
def late_ean_attach(spark, d):
    x = offers(spark, d)
    key = F.col("product_id").cast("string")
    variants = x.select("product_id").distinct().select(F.col("product_id").alias("variant_id"), F.concat(F.lit("key"), key).alias("variant_key"), F.when(F.col("product_id") % 4 == 0, F.concat(F.lit("e"), key)).alias("ean"))
    found = x.where("line <= 2").select(F.col("product_id").alias("variant_id"), F.concat(F.lit("e"), (F.col("quantity") * 40 + F.col("line")).cast("string")).alias("ean"))
    return snapshot.attach_late_ean(variants, found)


def _seen(spark, d):
    x = table(spark, d, "events")
    return x.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("advertiser_id"), (F.col("event_type") != "error").alias("available"), F.col("ts").cast("timestamp").alias("last_seen_at"))


_SEEN = "seen AS (SELECT event_id AS id, user_id % 40 AS advertiser_id, event_type <> 'error' AS available, ts AS last_seen_at FROM events)"
_GUARD = f"{_SEEN}, guard AS (SELECT advertiser_id, count(*) FILTER (WHERE available AND last_seen_at < TIMESTAMP '{{0}}') AS missing, count(*) FILTER (WHERE last_seen_at >= TIMESTAMP '{{0}}') AS seen FROM seen GROUP BY advertiser_id)"


@query("missing_guard", "WITH " + _GUARD.format("2024-01-10 00:00:00") + " SELECT advertiser_id, missing, seen, missing >= 20 AND missing > 0.3 * (missing + seen) AS suspended FROM guard")
def missing_guard(spark, d):
    return snapshot.merchant_guard(_seen(spark, d), F.expr("timestamp '2024-01-10 00:00:00'"))


@query("deactivate_missing", "WITH " + _GUARD.format("2024-01-08 12:00:00") + " SELECT id, available AND NOT (last_seen_at < TIMESTAMP '2024-01-08 12:00:00' AND g.seen > 0 AND NOT (missing >= 20 AND missing > 0.3 * (missing + g.seen))) AS available FROM seen JOIN guard g USING (advertiser_id)")
def deactivate_missing(spark, d):
    return snapshot.deactivate_missing(_seen(spark, d), F.expr("timestamp '2024-01-08 12:00:00'"), 1000, 10).select("id", "available")


@query("sold_out_mark", f"WITH {STORED} SELECT id, available AND id NOT IN (SELECT id FROM offers WHERE status = 'F') AS available FROM stored")
def sold_out_mark(spark, d):
    gone = offers(spark, d).where("status = 'F'")
    return snapshot.mark_sold_out(stored_offers(spark, d).withColumn("last_seen_at", F.expr(_THEN)), gone, ["id"], F.expr(_NOW)).select("id", "available")


@query("cheapest_offer_per_product", f"WITH {OFFERS} SELECT product_id, id, CAST(price AS DOUBLE) AS price, CAST(sale_price AS DOUBLE) AS sale_price FROM offers QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sale_price NULLS LAST, price, id) = 1")
def cheapest_offer_per_product(spark, d):
    return identity.cheapest_offer(offers(spark, d)).select("product_id", "id", F.col("price").cast("double").alias("price"), F.col("sale_price").cast("double").alias("sale_price"))


@query(
    "parent_title_refresh",
    f"""WITH {VIEW}, best AS (SELECT product_id, title || ' at ' || merchant AS t, CASE WHEN product_id % 2 = 0 THEN brand ELSE 'SUPPLIER' END AS b FROM view_ QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sale_price NULLS LAST, price, id) = 1)
SELECT p.product_id AS id, coalesce(CASE WHEN contains(lower(t), lower(b)) THEN t ELSE t || ' ' || b END, p.title) AS canonical_title FROM products p LEFT JOIN best USING (product_id)""",
)
def parent_title_refresh(spark, d):
    parents = products(spark, d).select(F.col("product_id").alias("id"), F.col("title").alias("canonical_title"))
    own = view(spark, d).withColumns({"title": F.concat("title", F.lit(" at "), "merchant"), "brand": F.when(F.col("product_id") % 2 == 0, F.col("brand")).otherwise("SUPPLIER")})
    return titles.parent_titles(parents, own, once=True)


_BALANCED = f"""WITH {VIEW}, copies AS (SELECT id, advertiser_id, title, row_number() OVER (PARTITION BY advertiser_id, lower(title) ORDER BY id) > 1 AS c FROM view_),
turns AS (SELECT id, advertiser_id, row_number() OVER (PARTITION BY advertiser_id ORDER BY c, id) AS turn FROM copies)
SELECT id, advertiser_id, turn FROM turns ORDER BY turn, advertiser_id LIMIT 250"""


@query("balanced_sample", _BALANCED)
def balanced_sample(spark, d):
    return sampling.balanced(view(spark, d), 250, "id", F.lower("title")).select("id", "advertiser_id", F.col("turn").cast("long").alias("turn"))


@query("seeded_sample")
def seeded_sample(spark, d):
    rows = products(spark, d).withColumns({"id": F.col("product_id"), "advertiser_id": F.col("product_id") % 10})
    return sampling.seeded(rows.withColumn("clean_title", family_title(F.col("title"))), 60, 42).select("id", "advertiser_id", F.col("turn").cast("long").alias("turn"))


@query("review_queue", "SELECT doc_id AS id, lang AS source_title FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND CASE WHEN l.toxic = 1 THEN 'en' ELSE d.lang END = d.lang) ORDER BY doc_id LIMIT 100")
def review_queue(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("sku"), F.col("lang").alias("source_title"))
    reviews = table(spark, d, "labels").join(docs, F.col("doc_id") == F.col("id")).select("sku", F.when(F.col("toxic") == 1, "en").otherwise(F.col("source_title")).alias("source_title"), (F.col("quality") == 1).alias("accepted"))
    return titles.review_queue(docs, reviews, 100).select("id", "source_title")


@query("image_offers", "SELECT page_id AS id, trim(CASE page_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE url END) AS image_link FROM pages WHERE page_id % 4 > 1 AND trim(url) <> ''")
def image_offers(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 4 == 0, "  ").when(F.col("page_id") % 4 > 1, F.col("url")).alias("image_link"))
    return assets.with_image(rows, 0)


@query(
    "color_resolution",
    """WITH x AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nero' WHEN 2 THEN 'rosso' ELSE ' ' END AS feed, ['blu','nero','verde'][label % 3 + 1] AS seen, vec_id % 101 AS confidence,
  CASE vec_id % 5 WHEN 0 THEN 'usa_visione' WHEN 1 THEN 'mantieni_entrambi' WHEN 2 THEN 'non_conclusivo' END AS decision FROM embeddings)
SELECT vec_id, CASE WHEN coalesce(trim(feed), '') = '' AND confidence >= 80 THEN seen WHEN decision = 'usa_visione' AND confidence >= 80 THEN seen
  WHEN decision = 'mantieni_entrambi' THEN array_to_string(list_sort(list_distinct(CASE WHEN coalesce(trim(feed), '') = '' THEN [seen] ELSE [feed, seen] END)), ', ') ELSE feed END AS color,
  CASE WHEN coalesce(trim(feed), '') = '' AND confidence >= 80 THEN 'visione' WHEN decision = 'usa_visione' AND confidence >= 80 THEN 'revisione' WHEN decision = 'mantieni_entrambi' THEN 'revisione' WHEN decision = 'non_conclusivo' THEN 'non_conclusivo' ELSE 'feed' END AS source FROM x""",
)
def color_resolution(spark, d):
    key = F.col("vec_id")
    feed_ = F.when(key % 4 == 1, "nero").when(key % 4 == 2, "rosso").when(key % 4 == 3, " ")
    seen = F.element_at(F.array(*map(F.lit, ["blu", "nero", "verde"])), (F.col("label") % 3 + 1).cast("int"))
    decision = F.when(key % 5 == 0, "usa_visione").when(key % 5 == 1, "mantieni_entrambi").when(key % 5 == 2, "non_conclusivo")
    out = assets.resolved_color(feed_, seen, key % 101, decision)
    return table(spark, d, "embeddings").select("vec_id", out["color"].alias("color"), out["source"].alias("source"))


@query(
    "asset_upsert_prefer_old",
    """WITH old AS (SELECT sha256(CAST(vec_id AS VARCHAR)) AS image_sha256, 'old' || vec_id AS image_link, CASE WHEN vec_id % 3 = 0 THEN label END AS tag FROM embeddings),
new AS (SELECT sha256(CAST(vec_id * 2 AS VARCHAR)) AS image_sha256, 'new' || vec_id AS image_link, label + 100 AS tag FROM embeddings)
SELECT coalesce(n.image_sha256, o.image_sha256) AS image_sha256, coalesce(n.image_link, o.image_link) AS image_link, coalesce(o.tag, n.tag) AS tag FROM old o FULL JOIN new n ON o.image_sha256 = n.image_sha256""",
)
def asset_upsert_prefer_old(spark, d):
    e = table(spark, d, "embeddings")
    sha = lambda key: F.sha2(key.cast("string"), 256).alias("image_sha256")
    link = lambda p: F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("image_link")
    old = e.select(sha(F.col("vec_id")), link("old"), F.when(F.col("vec_id") % 3 == 0, F.col("label")).alias("tag"))
    return assets.upsert_assets(old, e.select(sha(F.col("vec_id") * 2), link("new"), (F.col("label") + 100).alias("tag")))


_PROBE = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]


@query("embedding_cosine_topk", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20")
def embedding_cosine_topk(spark, d):
    return assets.most_similar(table(spark, d, "embeddings"), _PROBE, 20)


def _rows_to_resolve(spark, d, told=None):
    """``told``: part number, model title and its confidence, else some part numbers alone."""
    null = F.lit(None).cast("string")
    part, title, sure = told or (F.when(F.col("quantity") % 9 == 0, F.concat(F.lit("M"), F.col("quantity").cast("string"))), null, null)
    x = offers(spark, d).join(products(spark, d).select("product_id", "title", "brand", "color", "material", "size"), "product_id")
    return x.select(
        F.col("id").alias("feed_pos"),
        "advertiser_id",
        F.when(F.col("line") == 1, F.concat(F.lit("e"), (F.col("order_id") % 900).cast("string"))).alias("ean"),
        "brand",
        part.alias("extracted_model"),
        title.alias("model_title"),
        sure.alias("model_match_confidence"),
        null.alias("colorway_name"),
        F.col("title").alias("clean_title"),
        "color",
        "material",
        "size",
    )


_RESOLVED = f"""{OFFERS}, {PRODUCTS}, raw AS (
  SELECT o.id AS feed_pos, o.advertiser_id, CASE WHEN line = 1 THEN 'e' || (order_id % 900) END AS ean, brand, CASE WHEN quantity % 9 = 0 THEN 'M' || quantity END AS model, title, color, material, size
  FROM offers o JOIN products p USING (product_id)),
own AS (SELECT *, sha256(CASE WHEN model IS NOT NULL THEN 'mpn:' || brand || '|' || model ELSE 'merchant:' || advertiser_id || '|' || brand || '|' || title END) AS k FROM raw),
keyed AS (SELECT *, CASE WHEN ean IS NULL THEN k ELSE first_value(k) OVER (PARTITION BY ean ORDER BY feed_pos) END AS product_key FROM own),
colored AS (SELECT *, sha256('product:' || product_key || '|color:' || coalesce(color, 'non_specificato') || '|mpn:' || coalesce(model, '') || '|colorway:') AS color_variant_key FROM keyed),
resolved AS (SELECT *, CASE WHEN ean IS NOT NULL THEN 'ean:' || ean ELSE sha256('product:' || product_key || '|color_variant:' || color_variant_key || '|size:' || coalesce(size, '') || '|material:' || coalesce(material, '')) END AS variant_key FROM colored)"""


#: Part numbers of which one is on a third of all rows, sure titles on two thirds: (part number, title, confidence).
_EVIDENCE = "CASE WHEN quantity % 3 = 1 THEN 'M-hot' WHEN quantity % 9 = 0 THEN 'M' || quantity END AS model, 'model ' || (o.product_id % 40) AS model_title, CASE WHEN line % 3 > 0 THEN 'high' ELSE 'low' END AS sure"
# The rule row by row: a recursion over the first rows of equal evidence, brand by brand, keeps what is known by then.
_BY_EVIDENCE = f"""{OFFERS}, {PRODUCTS}, raw AS (
  SELECT o.id AS feed_pos, o.advertiser_id, CASE WHEN line = 1 THEN 'e' || (order_id % 900) END AS ean, brand, {_EVIDENCE}, title, color, material, size
  FROM offers o JOIN products p USING (product_id)),
own AS (SELECT *, CASE WHEN sure = 'high' THEN model_title END AS t, sha256(CASE WHEN model IS NOT NULL THEN 'mpn:' || brand || '|' || model WHEN sure = 'high' THEN 'gemini-model:' || brand || '|' || model_title ELSE 'merchant:' || advertiser_id || '|' || brand || '|' || title END) AS k FROM raw),
leads AS (SELECT * FROM own WHERE ean IS NULL UNION ALL SELECT * FROM (SELECT * FROM own WHERE ean IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ean ORDER BY feed_pos) = 1)),
firsts AS (SELECT brand, model, t, min(feed_pos) AS since, min_by(k, feed_pos) AS k FROM leads WHERE model IS NOT NULL OR t IS NOT NULL GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY since) AS n FROM firsts),
step AS (
  SELECT brand, 0 AS n, CAST([] AS VARCHAR[]) AS parts, CAST([] AS BIGINT[]) AS part_from, CAST([] AS VARCHAR[]) AS titles, CAST([] AS BIGINT[]) AS title_from, CAST([] AS VARCHAR[]) AS owners FROM (SELECT DISTINCT brand FROM turns)
  UNION ALL
  SELECT brand, n, CASE WHEN makes AND model IS NOT NULL THEN list_append(parts, model) ELSE parts END, CASE WHEN makes AND model IS NOT NULL THEN list_append(part_from, since) ELSE part_from END,
         CASE WHEN makes AND t IS NOT NULL THEN list_append(titles, t) ELSE titles END, CASE WHEN makes AND t IS NOT NULL THEN list_append(title_from, since) ELSE title_from END, CASE WHEN makes AND t IS NOT NULL THEN list_append(owners, k) ELSE owners END
  FROM (SELECT e.*, s.* EXCLUDE (brand, n), NOT coalesce(list_contains(parts, model), false) AND NOT coalesce(list_contains(titles, t), false) AS makes FROM step s JOIN turns e ON e.brand = s.brand AND e.n = s.n + 1)),
ended AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC) = 1),
met AS (SELECT l.*, part_from[list_position(parts, model)] AS p_at, title_from[list_position(titles, t)] AS t_at, owners[list_position(titles, t)] AS owner FROM leads l LEFT JOIN ended USING (brand)),
named AS (SELECT ean, feed_pos, CASE WHEN p_at <= feed_pos THEN k WHEN t_at <= feed_pos THEN owner ELSE k END AS product_key, CASE WHEN p_at <= feed_pos THEN p_at = feed_pos WHEN t_at <= feed_pos THEN t_at = feed_pos ELSE true END AS makes FROM met),
keyed AS (
  SELECT o.*, n.product_key, n.makes FROM own o JOIN named n USING (feed_pos) WHERE o.ean IS NULL
  UNION ALL SELECT o.*, n.product_key, n.makes AND n.feed_pos = o.feed_pos FROM own o JOIN named n ON n.ean = o.ean),
colored AS (SELECT *, sha256('product:' || product_key || '|color:' || coalesce(color, 'non_specificato') || '|mpn:' || coalesce(model, '') || '|colorway:') AS color_variant_key FROM keyed)
SELECT feed_pos, product_key, makes AS updates_product, color_variant_key, CASE WHEN ean IS NOT NULL THEN 'ean:' || ean ELSE sha256('product:' || product_key || '|color_variant:' || color_variant_key || '|size:' || coalesce(size, '') || '|material:' || coalesce(material, '')) END AS variant_key FROM colored"""


@query("entity_resolution", f"WITH RECURSIVE {_BY_EVIDENCE}")
def entity_resolution(spark, d):
    """Offers by EAN, part number and sure title, in their order; one part number is on a third of them."""
    q = F.col("quantity")
    part = F.when(q % 3 == 1, "M-hot").when(q % 9 == 0, F.concat(F.lit("M"), q.cast("string")))
    title = F.concat(F.lit("model "), (F.col("product_id") % 40).cast("string"))
    sure = F.when(F.col("line") % 3 > 0, "high").otherwise("low")
    return resolve.resolve(_rows_to_resolve(spark, d, (part, title, sure))).select("feed_pos", "product_key", "updates_product", "color_variant_key", "variant_key")


@query("resolved_variants", f"WITH {_RESOLVED} SELECT variant_key, max_by(product_key, feed_pos) AS product_key, max_by(size, feed_pos) FILTER (WHERE size IS NOT NULL) AS size, max_by(material, feed_pos) FILTER (WHERE material IS NOT NULL) AS material FROM resolved GROUP BY variant_key")
def resolved_variants(spark, d):
    rows = resolve.resolve(_rows_to_resolve(spark, d)).withColumn("data_quality", F.lit("rules"))
    return resolve.variants_of(rows).select("variant_key", "product_key", "size", "material")


@query("export_rows", f"WITH {VIEW} SELECT CAST(id AS VARCHAR) AS sku, title, coalesce(description, '') AS description, CAST(price AS VARCHAR) AS price, coalesce(CAST(sale_price AS VARCHAR), '') AS sale_price, 'in_stock' AS availability, coalesce(color, '') AS color FROM view_ WHERE available")
def export_rows(spark, d):
    rows = view(spark, d).where("available").withColumn("sku", F.col("id").cast("string"))
    return feed.export_rows(rows).select("sku", "title", "description", "price", "sale_price", "availability", "color")
