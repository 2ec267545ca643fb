"""What is shuffled and written, where it once grew too fast."""

import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import functions as F

from vetrina.functions.values import packed, unpacked
from vetrina.operators import clean, evidence, identity, resolve, views
from vetrina.sources.shared import freed, stored


@contextmanager
def _no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_texts_come_back(one):
    texts = ["ab" * 32, "abc", "", "AB", "é", "01\n", None]
    assert one(lambda c: unpacked(packed(c)), texts) == texts
    assert [len(x) for x in one(lambda c: packed(c), texts[:1])] == [33]


def test_fingerprints_are_shuffled_as_bytes_and_rows_without_ean_not_for_one(spark):
    kind = "advertiser_id long, source_product_id string, ean string, content_hash string, operational_hash string"
    new = spark.createDataFrame([(1, "a", None, "c", "00"), (1, "b", "e", "c", "0f"), (1, "x", "f", "d", None)], kind)
    old = spark.createDataFrame([(1, "a", None, "c", "00", 7, True), (1, "z", "e", "c", "0f", 8, True)], f"{kind}, id long, available boolean")
    with _no_broadcast(spark):
        found = identity.match_stored(new, old)
        got = {r.source_product_id: (r.stored and (r.stored.id, r.stored.operational_hash), r.operational_hash) for r in found.collect()}
        assert got == {"a": ((7, "00"), "00"), "b": ((8, "0f"), "0f"), "x": (None, None)}
        assert "Union" in _plan(found) and "unhex" in _plan(found)


def test_rows_without_evidence_are_not_staged(spark):
    rows = spark.range(20).select(
        F.col("id").alias("feed_pos"), F.lit(1).cast("long").alias("advertiser_id"), F.when(F.col("id") == 3, "e").alias("ean"), F.lit("b").alias("brand"),
        *(F.lit(None).cast("string").alias(c) for c in ("extracted_model", "model_title", "model_match_confidence")), F.concat(F.lit("t"), F.col("id").cast("string")).alias("clean_title"),
    )
    most = []

    def stage(df):
        most.append(df.count())
        return df

    found = evidence.with_products(rows, stage=stage)
    assert max(most) == 1
    assert {(r.product_key, r.updates_product) for r in found.collect()} == {(r.k, True) for r in rows.select(evidence.fallback_key(rows).alias("k")).collect()}


def test_offers_meet_little_evidence_without_a_shuffle(spark):
    text = lambda *names: [F.concat(F.lit(n), (F.col("id") % 5).cast("string")).alias(n) for n in names]
    rows = spark.range(60).select(F.col("id").alias("feed_pos"), F.lit(1).cast("long").alias("advertiser_id"), F.when(F.col("id") % 2 == 0, "e").alias("ean"), *text("brand", "extracted_model", "model_title", "clean_title"), F.lit("high").alias("model_match_confidence"))
    with _no_broadcast(spark):
        found = evidence.with_products(rows)
        assert found.count() == 60 and "hashpartitioning" not in _plan(found)


def test_shuffle_files_go_with_their_query(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name, None)
    assert stored(spark.range(1000).repartition(3, "id")).count() == 1000
    with freed(spark), freed(spark):
        stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == setting
    until = time.time() + 20
    while left := [f for f in files() - before if f.suffix == ".data" and f.stat().st_size > 500]:
        assert time.time() < until, left
        time.sleep(0.2)


def test_offers_meet_their_levels_in_one_join(spark):
    null = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    one = spark.range(4)
    offers = one.select("id", F.col("id").alias("variant_id"), F.lit(1.0).alias("price"), F.lit(None).cast("double").alias("sale_price"), F.lit(True).alias("available"), *null("advertiser_name", "image_link", "merchant_deep_link", "advertiser_id", "source_product_id", "aw_deep_link", "currency", "last_seen_at"))
    variants = one.select("id", F.col("id").alias("product_id"), F.when(F.col("id") < 2, F.col("id")).alias("color_variant_id"), *null("variant_key", "color", "size", "material"))
    colors = one.select("id", *null("colorway_title"))
    products = one.select("id", *null("canonical_title", "description", "brand", "product_type", "sottocategoria", "gender", "age_group"))
    with _no_broadcast(spark):
        found = views.catalog_search(offers, variants, colors, products)
        assert found.count() == 4 and found.where("color_variant_id is null").count() == 2
        joins = [line for line in _plan(found).split("\n") if "Join" in line]
        assert "variant_id" in joins[0] and "color_variant_id" not in joins[0]


def test_rows_without_key_are_dealt_out(spark):
    text = [F.lit(None).cast("string").alias(c) for c in ("ean", "extracted_model", "model_title", "model_match_confidence")]
    rows = spark.range(4000).select(F.col("id").alias("feed_pos"), F.lit(1).cast("long").alias("advertiser_id"), F.lit("b").alias("brand"), F.lit("t").alias("clean_title"), *text)
    stored = rows.limit(1).select("*", F.lit("k").alias("product_key"), F.current_timestamp().alias("first_seen_at"))
    with _no_broadcast(spark):
        found = resolve.stored_keys(rows, stored)
        assert found.where("_known is null").count() == 4000
        assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000


def test_each_text_is_cleaned_once(spark):
    rows = spark.range(300).selectExpr("id feed_pos", "'1' advertiser_id", "'p' || id AS id", "'Felpa Nike ' || id % 3 AS title", "'Nike' brand", "'9' price", "'l' link", "'d' || id % 2 AS description")
    staged = []

    def stage(df):
        staged.append((set(df.columns), df.count()))
        return stored(df)

    found = clean.clean_feed(rows, stage)
    assert found.count() == 300 and "Python" not in _plan(found)  # no row's own texts go to Python
    assert {n for columns, n in staged if {"search", "bare"} <= columns} == {3} and max(n for _, n in staged) <= 10


def test_texts_are_joined_either_way(spark, monkeypatch):
    texts = [("Polo t", "shirt", None, None), ("Polo t", None, "shirt", None), ("Polo", "t", "shirt", None), ("Polo", None, "t", None), ("Felpa Nike Pro", None, None, "NIKE "), ("Felpa Nike Pro", None, None, "Adidas"), ("Felpa Nike Pro", "Taglia: M", None, None)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "feed_pos long, title string, description string, product_type string, brand string")
    rows = rows.selectExpr("*", "'1' advertiser_id", "'p' || feed_pos AS id", "'9' price", "'l' link")
    read = lambda: {r.feed_pos: (r.sottocategoria, r.title, r.clean_title, r.size) for r in clean.clean_feed(rows).collect()}
    want = {i: ("magliette", title, title.lower(), None) for i, title in enumerate(["Polo t", "Polo t", "Polo"])} | {3: ("polo", "Polo", "polo", None)}
    want |= {4: ("felpe", "Felpa Pro", "felpa pro", None), 5: ("felpe", "Felpa Nike Pro", "felpa nike pro", None), 6: ("felpe", "Felpa Nike Pro", "felpa nike pro", "m")}
    assert read() == want
    monkeypatch.setattr(clean, "BROADCAST_TEXTS", -1)
    with _no_broadcast(spark):
        assert read() == want
