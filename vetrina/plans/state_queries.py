"""Jobs, runs, limits, caches and histories over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetrina.functions.text import without_code_fence, without_controls
from vetrina.operators import assets, clean, enrich, requests, state, titles
from vetrina.plans.base import OFFERS, PRODUCTS, offers, products, query, table
from vetrina.sources import runs

_NOW = "2024-01-20 00:00:00"

_JOBS = """jobs AS (SELECT 'h' || event_id AS content_hash, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'done' END AS status,
  CAST(user_id % 5 AS INTEGER) AS attempts, ts AS started_at, CASE WHEN event_type = 'error' THEN 'e' END AS error FROM events)"""
_FREE = f"(status = 'pending' OR (status = 'failed' AND attempts < 3) OR (status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL 30 MINUTE))"


def _jobs(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise("done")
    return table(spark, d, "events").select(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("content_hash"), status.alias("status"), (F.col("user_id") % 5).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "error", "e").alias("error"))


def _now():
    return F.expr(f"timestamp '{_NOW}'")


def _wanted(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("h"), (F.col("event_id") * 2).cast("string")).alias("content_hash"))


_CLAIM = f"""{_JOBS}, want AS (SELECT DISTINCT 'h' || (event_id * 2) AS content_hash, TRUE AS w FROM events),
joined AS (SELECT coalesce(j.content_hash, w.content_hash) AS content_hash, status, attempts, started_at, error, coalesce(w AND (status IS NULL OR {_FREE}), FALSE) AS claimed FROM jobs j FULL JOIN want w USING (content_hash)),
claimed AS (SELECT content_hash, CASE WHEN claimed THEN 'running' ELSE status END AS status, CAST(coalesce(attempts, 0) + CASE WHEN claimed THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN claimed THEN NULL ELSE error END AS error, claimed FROM joined)"""


@query("ai_queue_state", f"WITH {_CLAIM} SELECT content_hash, status, attempts, error, claimed FROM claimed")
def ai_queue_state(spark, d):
    return enrich.claim(_jobs(spark, d), _wanted(spark, d), _now()).drop("started_at")


@query("ai_queue_finish", f"WITH {_CLAIM} SELECT content_hash, CASE WHEN claimed THEN CASE WHEN length(content_hash) % 2 = 0 THEN 'failed' ELSE 'done' END ELSE status END AS status, CASE WHEN claimed THEN CASE WHEN length(content_hash) % 2 = 0 THEN 'bad' END ELSE error END AS error FROM claimed")
def ai_queue_finish(spark, d):
    claimed = enrich.claim(_jobs(spark, d), _wanted(spark, d), _now())
    outcome = claimed.where("claimed").select("content_hash", F.when(F.length("content_hash") % 2 == 0, "bad").alias("error"))
    return enrich.finish(claimed.drop("claimed"), outcome).select("content_hash", "status", "error")


@query("ai_queue_pending", f"WITH {_JOBS}, new AS (SELECT DISTINCT 'h' || (event_id * 2) AS content_hash FROM events) SELECT content_hash, status, attempts FROM jobs UNION ALL SELECT content_hash, 'pending', 0 FROM new WHERE content_hash NOT IN (SELECT content_hash FROM jobs)")
def ai_queue_pending(spark, d):
    return enrich.mark_pending(_jobs(spark, d), _wanted(spark, d)).select("content_hash", "status", "attempts")


@query("ai_queue_reset", f"WITH {_JOBS} SELECT content_hash, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM jobs WHERE {_FREE} OR status = 'failed'")
def ai_queue_reset(spark, d):
    jobs = _jobs(spark, d)
    open_ = enrich.retryable(jobs, _now()).unionByName(jobs.where("status = 'failed'")).distinct()
    return enrich.reset_failed(open_).select("content_hash", "status", "attempts")


@query("ai_budget_split", "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents), r AS (SELECT content_hash, min(doc_id) AS first_pos FROM h GROUP BY 1) SELECT content_hash, first_pos, row_number() OVER (ORDER BY first_pos) <= 200 AS within FROM r WHERE first_pos % 4 <> 0")
def ai_budget_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    todo = enrich.representatives(docs, "doc_id")
    cache = todo.where("first_pos % 4 = 0")
    jobs = spark.createDataFrame([], "content_hash string, status string, attempts int, started_at timestamp")
    return enrich.plan(docs, cache, jobs, 200, _now(), "doc_id").select("content_hash", "first_pos", "within")


@query("retry_promotion", f"WITH {_JOBS} SELECT content_hash, CASE WHEN attempts % 2 = 0 THEN CASE WHEN {_FREE} THEN 'content' ELSE 'unchanged' END ELSE 'updated' END AS kind FROM jobs")
def retry_promotion(spark, d):
    jobs = _jobs(spark, d)
    classified = jobs.select("content_hash", F.when(F.col("attempts") % 2 == 0, "unchanged").otherwise("updated").alias("kind"))
    return enrich.promote_unfinished(classified, jobs, _now()).select("content_hash", "kind")


@query("enrich_blocks", f"WITH {PRODUCTS} SELECT sha256(title || product_id) AS content_hash, CASE WHEN product_id % 10 = 0 THEN NULL ELSE 'lana' END AS material, product_id % 10 = 0 AS failed FROM products")
def enrich_blocks(spark, d):
    rows = products(spark, d).select(F.sha2(F.concat("title", F.col("product_id").cast("string")), 256).alias("content_hash"), F.when(F.col("product_id") % 10 == 0, "skip").otherwise("take").alias("source_title"), "description")
    out = enrich.run_model(rows, lambda block: {r["content_hash"]: {"material": "lana"} for r in block if r["source_title"] == "take"})
    return out.select("content_hash", F.try_element_at("fields", F.lit("material")).alias("material"), F.col("error").isNotNull().alias("failed"))


@query(
    "enrichment_merge",
    f"""WITH {PRODUCTS} SELECT product_id, CASE product_id % 4 WHEN 0 THEN 'nero' ELSE color END AS color, CASE WHEN product_id % 4 = 1 THEN 'cotone' ELSE material END AS material, size,
  CASE WHEN product_id % 4 < 2 THEN CASE WHEN product_id % 4 = 0 THEN 'scarpe' END ELSE product_type END AS product_type,
  CASE WHEN product_id % 4 = 0 THEN 'ai' WHEN product_id % 4 = 1 THEN 'partial' ELSE 'rules' END AS data_quality FROM products""",
)
def enrichment_merge(spark, d):
    p = products(spark, d).select("product_id", F.col("product_id").cast("string").alias("content_hash"), "title", F.col("title").alias("source_title"), F.col("title").alias("clean_title"), *("brand product_type sottocategoria gender age_group color size material".split()), *(F.lit(None).cast("string").alias(c) for c in ("model_title", "colorway_name", "model_match_confidence")), F.lit("rules").alias("data_quality"))
    answer = F.when(F.col("product_id") % 4 == 0, F.create_map(*map(F.lit, ["color", "Black", "product_type", "scarpe", "size", "XL", "material", "unknown", "brand", "n/a"]))).otherwise(F.create_map(*map(F.lit, ["material", "Cotton", "product_type", "nonsense"])))
    answers = p.where("product_id % 4 < 2").select("content_hash", answer.alias("fields"))
    return clean.apply_enrichment(p, answers).select("product_id", "color", "material", "size", "product_type", "data_quality")


@query("needs_ai", f"WITH {PRODUCTS} SELECT product_id, gender IS NULL OR color IS NULL OR material IS NULL AS needs_ai FROM products")
def needs_ai(spark, d):
    p = products(spark, d).withColumn("model_match_confidence", F.lit("low"))
    return p.select("product_id", clean.needs_ai(p).alias("needs_ai"))


@query(
    "run_metrics",
    """WITH j AS (SELECT user_id % 12 AS run_id, event_id % 1000 AS tokens_in, CAST(value AS BIGINT) AS tokens_out FROM events)
SELECT run_id, count(*) AS jobs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(tokens_in) / 1e6 * 0.25 + sum(tokens_out) / 1e6 * 1.5, 6) AS cost FROM j GROUP BY run_id""".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"),
)
def run_metrics(spark, d):
    jobs = table(spark, d, "events").select((F.col("user_id") % 12).alias("run_id"), (F.col("event_id") % 1000).alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"))
    return runs.job_totals(jobs, 0.25, 1.5)


@query("run_finish", "SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'running' WHEN user_id % 3 = 1 THEN 'success' ELSE 'partial' END AS status, count(*) AS started_rows, CASE WHEN user_id % 3 > 0 THEN CAST(user_id * 2 AS BIGINT) END AS updated FROM events GROUP BY user_id")
def run_finish(spark, d):
    log = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.lit("running").alias("status"), F.count("*").alias("started_rows"))
    outcome = log.where("run_id % 3 > 0").select("run_id", F.when(F.col("run_id") % 3 == 1, runs.run_status(False, 0)).otherwise(runs.run_status(False, 2)).alias("status"), (F.col("run_id") * 2).alias("updated"))
    return runs.finished(log, outcome)


# The sliding log as a fold over each user's times; the limit of 2 a day makes refusals common in these tables.
@query(
    "rate_limit_log",
    """WITH t AS (SELECT user_id, epoch_us(ts) AS u FROM events), lists AS (SELECT user_id, list(u ORDER BY u) AS l FROM t GROUP BY user_id),
folded AS (SELECT user_id, len(l) AS received, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(l, lambda x: [x])),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1] - y < 86400000000)) < 2 THEN list_append(acc, x[1]) ELSE acc END) AS log FROM lists)
SELECT user_id, received, len(log) AS accepted FROM folded""",
)
def rate_limit_log(spark, d):
    return state.accepted_requests(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 2, 86_400)


@query("link_cache_ttl", "WITH c AS (SELECT user_id AS key, max(ts) AS created_at, max_by(event_id, ts) AS link FROM events GROUP BY user_id), n AS (SELECT user_id AS key, TIMESTAMP '2024-02-06 00:00:00' AS created_at, -user_id AS link FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT key, link FROM (SELECT * FROM c WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n) WHERE created_at > TIMESTAMP '2024-02-05 21:00:00' - INTERVAL 7 DAY")
def link_cache_ttl(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cache = e.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("created_at"), F.max_by("event_id", "ts").alias("link"))
    new = e.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.expr("timestamp '2024-02-06 00:00:00'").alias("created_at"), (-F.col("user_id")).alias("link")).distinct()
    return state.fresh_links(state.put_links(cache, new), F.expr("timestamp '2024-02-05 21:00:00'")).select("key", "link")


@query("history_last5", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def history_last5(spark, d):
    return state.last_entries(table(spark, d, "conversations"), "conv_id", "turn", 5).select("conv_id", "turn", "role")


@query("feedback_append", f"WITH {OFFERS} SELECT id, CAST(NULL AS VARCHAR) AS note FROM offers UNION ALL SELECT event_id, event_type FROM events")
def feedback_append(spark, d):
    first = offers(spark, d).select("id")
    more = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("note"))
    return state.append(first, more).select("id", "note")


@query("model_answers", "SELECT CAST(doc_id AS VARCHAR) AS id, 'Title ' || doc_id || ' ' || source AS title FROM documents WHERE lang = 'en'")
def model_answers(spark, d):
    """An answer for every document; those for texts in other languages name an id that was not asked for."""
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    named = F.when(F.col("lang") == "en", key).otherwise(F.concat(F.lit("x"), key))
    raw = docs.select(F.concat(F.lit('```json\n[{"id": "'), named, F.lit('", "title": "Title\\n\\t'), key, F.lit("\\u0007 "), "source", F.lit('"}]\n```')).alias("answer"))
    return titles.parsed_answers(raw, docs.select(key.alias("id"))).select("id", without_controls(F.col("title")).alias("title"))


@query("title_review_apply", f"WITH {PRODUCTS}, x AS (SELECT product_id, CASE product_id % 3 WHEN 0 THEN 'Fine title' WHEN 1 THEN 'Broken con' END AS t, title FROM products) SELECT product_id AS id, CASE WHEN t = 'Fine title' THEN t ELSE title END AS title FROM x")
def title_review_apply(spark, d):
    flat = products(spark, d).select(F.col("product_id").alias("id"), F.col("product_id").alias("sku"), "title", F.col("title").alias("source_title"), "color", "material", "gender", "age_group")
    answers = flat.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "Fine title").otherwise("Broken con").alias("title"))
    return titles.apply_reviews(flat, answers, _now())[0].select("id", "title")


@query("code_fence", "SELECT event_id, '[' || event_id || ']' AS body FROM events")
def code_fence(spark, d):
    return table(spark, d, "events").select("event_id", without_code_fence(F.concat(F.lit(" ```JSON\n["), F.col("event_id").cast("string"), F.lit("]\n``` "))).alias("body"))


@query("link_build", "SELECT page_id AS id, CASE WHEN contains(url, 'http') THEN 'new:' || url ELSE 'plain' END AS link FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'kept' FROM pages WHERE page_id % 3 = 0")
def link_build(spark, d):
    """Fresh links come from the cache, others are built, and where that fails the plain link stays."""
    key = F.col("page_id").cast("string")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("merchant_deep_link"), F.lit("plain").alias("aw_deep_link"), key.alias("page"))
    old = F.expr("timestamp '2023-12-01 00:00:00'")
    cache = pages.where("id % 3 < 2").select(F.col("page").alias("key"), F.lit("kept").alias("link"), F.when(F.col("id") % 3 == 0, _now()).otherwise(old).alias("created_at"))

    def build(url):
        if "http" not in url:
            raise ValueError(url)
        return f"new:{url}"

    return requests.with_links(pages, cache, build, _now(), F.col("page"))[0].select("id", "link")


@query("image_fetch", "SELECT page_id AS id, CASE WHEN length(url) % 2 = 0 THEN strlen(url) END AS bytes, CASE WHEN length(url) % 2 = 1 THEN 'no picture' END AS error FROM pages")
def image_fetch(spark, d):
    """A fetcher that fails for some links: each failure stays with its row."""

    def fetch(link):
        if len(link) % 2:
            raise OSError("no picture")
        return link.encode()

    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("image_link"))
    return assets.fetched(rows, fetch).select("id", F.octet_length("content").cast("long").alias("bytes"), "error")
