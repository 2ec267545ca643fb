"""Scenarios of the catalogue: feeds in, snapshots out."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vetrina.operators import assets, clean, enrich, identity, resolve, sampling, search, snapshot, state, titles, views
from vetrina.operators.search import Filters, ManualFilters
from vetrina.operators.sync import Catalog
from vetrina.sources import feed, runs

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def _rows(spark, rows, pos=True):
    names = list(dict.fromkeys(k for r in rows for k in r))
    data = [(*(r.get(n) for n in names), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names) + ", feed_pos long")


def _offer(i, **more):
    return {"advertiser_id": "1", "advertiser_name": "Shop", "id": f"p-{i}", "title": f"Camicia modello {i}", "price": "50", "link": f"https://x/{i}", "availability": "in_stock", **more}


def test_whole_row(spark):
    row = _offer(1, title="Giacca Nera uomo cotone - 42", price="1.299,00", sale_price="999,00", product_type="A > B", gtin="0000000000017", description="Calda giacca", currency="eur", brand="N/A")
    got = clean.clean_feed(_rows(spark, [row])).first()
    assert (got.advertiser_id, got.ean, got.title, got.color, got.gender, got.material, got.size) == (1, "0000000000017", "Giacca", "nero", "uomo", "cotone", "42")
    assert (got.price, got.sale_price, got.discount_percentage, got.product_type, got.sottocategoria) == (1299.0, 999.0, 23.09, "abbigliamento", "giacche")
    assert (got.brand, got.currency, got.available, got.data_quality, got.merchant_product_id) == (None, "EUR", True, "rules", "0000000000017")


@pytest.mark.parametrize("change", [{"advertiser_id": " "}, {"advertiser_id": "x"}, {"id": ""}, {"title": ""}, {"title": "- 42"}, {"link": ""}, {"price": "0"}, {"price": "abc"}])
def test_rejected_rows(spark, change):
    assert clean.clean_feed(_rows(spark, [_offer(1, **change)])).count() == 0


def test_headers_are_tolerant(spark):
    row = {"Merchant ID": "7", "PRODUCT_NAME": "Sneakers", "merchant_product_id": "a", "search price": "10", "Fashion:size": "S, M", "aw_deep_link": "u", "in_stock": "1"}
    got = clean.clean_feed(_rows(spark, [row])).first()
    assert (got.advertiser_id, got.source_product_id, got.price, got.size, got.available) == (7, "a", 10.0, "s, m", True)


def test_fingerprints_of_rows(spark):
    rows = clean.clean_feed(_rows(spark, [_offer(1), _offer(1, price="60"), _offer(1, description="new")])).orderBy("feed_pos").collect()
    assert rows[0].content_hash == rows[1].content_hash != rows[2].content_hash
    assert rows[0].operational_hash == rows[2].operational_hash != rows[1].operational_hash


def _stored(spark, rows):
    return clean.clean_feed(_rows(spark, rows)).withColumn("id", F.xxhash64("advertiser_id", "source_product_id"))


def _kinds(spark, old, new):
    found = identity.classify(identity.match_stored(clean.clean_feed(_rows(spark, new)), _stored(spark, old).select("id", "advertiser_id", "source_product_id", "ean", "content_hash", "operational_hash", "available")))
    return {r.source_product_id: r.kind for r in found.collect()}


def test_classes(spark):
    old = [_offer(i) for i in range(4)] + [_offer(4, availability="no")]
    assert set(_kinds(spark, old[:4], old[:4]).values()) == {"unchanged"}
    new = [_offer(0), _offer(1, price="40"), _offer(2, title="Altro"), _offer(4), _offer(9)]
    assert _kinds(spark, old, new) == {"p-0": "unchanged", "p-1": "updated", "p-2": "content", "p-4": "reactivated", "p-9": "new"}


def test_match_by_ean_before_source_id(spark):
    old = [_offer(1, gtin="0000000000017"), _offer(2)]
    new = [_offer(7, gtin="0000000000017"), _offer(2)]
    assert _kinds(spark, old, new) == {"p-7": "content", "p-2": "unchanged"}


def test_first_row_shadows_later_ones(spark):
    rows = clean.clean_feed(_rows(spark, [_offer(1, availability="no"), _offer(1)]))
    kept = identity.first_by(rows, ["advertiser_id", "merchant_product_id"], "feed_pos").collect()
    assert len(kept) == 1 and kept[0].available is False


def _seen(spark, n, back, merchant=1):
    return spark.createDataFrame([(i, merchant, True, T1 if i < back else T0) for i in range(n)], "id long, advertiser_id long, available boolean, last_seen_at timestamp")


@pytest.mark.parametrize(("n", "back", "received", "invalid", "left"), [(30, 5, 5, 0, 30), (30, 29, 29, 0, 29), (10, 1, 1, 0, 1), (30, 29, 0, 0, 30), (30, 29, 29, 20, 30), (30, 0, 5, 0, 30)])
def test_missing_offers(spark, n, back, received, invalid, left):
    out = snapshot.deactivate_missing(_seen(spark, n, back), F.lit(T1), received, invalid)
    assert out.where("available").count() == left


def test_late_ean_goes_to_free_variants(spark):
    variants = spark.createDataFrame([(1, "k1", None), (2, "k2", "e9"), (3, "k3", None)], "variant_id long, variant_key string, ean string")
    found = spark.createDataFrame([(1, "e1"), (3, "e9"), (3, None)], "variant_id long, ean string")
    assert {tuple(r) for r in snapshot.attach_late_ean(variants, found).select("variant_id", "variant_key", "ean").collect()} == {(1, "ean:e1", "e1"), (2, "k2", "e9"), (3, "k3", None)}


def test_upsert_is_null_safe_and_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "k long, keep string, v string")
    new = spark.createDataFrame([(1, None, None), (None, "c", "z"), (2, "d", "w")], "k long, keep string, v string")
    out = snapshot.upsert(old, new, ["k"], keep_old=["keep"])
    want = {(1, "a", None), (None, "c", "z"), (2, "d", "w")}
    assert {tuple(r) for r in out.collect()} == want
    assert {tuple(r) for r in snapshot.upsert(out, new, ["k"], keep_old=["keep"]).collect()} == want


def test_stored_products_are_found_by_ean_part_and_title(spark):
    schema = "id long, product_key string, ean string, brand string, extracted_model string, model_title string, model_match_confidence string, advertiser_id long, clean_title string, first_seen_at timestamp"
    rows = [(1, "x", "e1", "acme", None, None, None, 1, "giacca", T0), (2, None, None, "acme", "M1", None, None, 1, "polo", T0), (3, None, None, "acme", None, "runner", "high", 1, "runner blu", T0), (4, "x", "e1", "acme", "M9", "other", "high", 1, "giacca", T0)]
    stored = spark.createDataFrame(rows, schema)
    stored = stored.withColumn("product_key", F.coalesce("product_key", resolve.fallback_key(stored)))
    known = {r.id: r.product_key for r in stored.collect()}
    new = [(1, "e1", "zeta", "M1", None, None), (2, None, "acme", "M1", "runner", "high"), (3, "e7", "acme", None, "runner", "high"), (4, None, "acme", None, "runner", "low"), (5, None, "other", "M1", None, None), (6, None, "acme", "M9", None, None)]
    feed_ = spark.createDataFrame([(i, e, b, m, t, c, 2, "t") for i, e, b, m, t, c in new], "feed_pos long, ean string, brand string, extracted_model string, model_title string, model_match_confidence string, advertiser_id long, clean_title string")
    got = {r.feed_pos: r._known for r in resolve.stored_keys(feed_, stored).collect()}
    assert got == {1: "x", 2: known[2], 3: known[3], 4: None, 5: None, 6: None}


def test_late_eans_move_variants(spark):
    offers = spark.createDataFrame([(1, "k1", None), (2, "k1", None), (3, "ean:e2", "e2"), (4, "k4", None)], "id long, variant_key string, ean string")
    found = spark.createDataFrame([("k1", "e1"), ("k4", "e2"), (None, "e5"), ("k4", None)], "variant_key string, ean string")
    assert {(r.id, r.variant_key) for r in snapshot.with_late_eans(offers, found).collect()} == {(1, "ean:e1"), (2, "ean:e1"), (3, "ean:e2"), (4, "k4")}


def test_flat_rows_of_a_run(spark):
    flat = spark.createDataFrame([(1, 1, "now", 1), (2, 1, "old", 1), (3, 1, None, 1), (4, 2, "old", 1)], "id long, advertiser_id long, last_seen_run string, availability int")
    out = snapshot.deactivate_flat(flat, flat.where("advertiser_id = 1"), "now")
    assert {(r.id, r.availability) for r in out.collect()} == {(1, 1), (2, 0), (3, 0), (4, 1)}


def test_balanced_sample_takes_turns(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, "c")], "feed_pos long, advertiser_id long, clean_title string")
    assert [r.feed_pos for r in sampling.balanced(rows, 4).collect()] == [0, 3, 2, 4]
    assert sorted(r.feed_pos for r in sampling.balanced(rows, 9, repeats=False).collect()) == [0, 2, 3]


def _view(spark):
    rows = [(1, "Felpa", "felpa calda", "nike", "abbigliamento", "felpe", "uomo", "nero", "s, m", 50.0, None, 1), (2, "Felpa rossa", None, "adidas", "abbigliamento", "felpe", "donna", "rosso", "38.5", 80.0, 40.0, 1), (3, "Scarpa", None, None, "scarpe", "sneakers", "uomo", None, "38", 120.0, 0.0, 1), (4, "Borsa", "grande", "nike", "accessori", "borse", None, "nero", None, 30.0, None, 0)]
    df = spark.createDataFrame(rows, "id long, title string, description string, brand string, product_type string, sottocategoria string, gender string, color string, size string, price double, sale_price double, availability int")
    return df.withColumns({"age_group": F.lit("adulto"), "condizione": F.lit("nuovo"), "merchant": F.lit("Shop"), "material": F.lit(None).cast("string")})


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        (Filters(), {1, 2, 3}),
        (Filters(size="38"), {3}),
        (Filters(size="M"), {1}),
        (Filters(size="l"), set()),
        (Filters(max_price=40.0), {2}),
        (Filters(max_price=0.0), set()),
        (Filters(min_price=0.0), {1, 2, 3}),
        (Filters(only_on_sale=True), {2, 3}),
        (Filters(color="nera"), {1}),
        (Filters(color="nero e rosso"), set()),
        (Filters(color="nero e rosso", color_logic="OR"), {1, 2}),
        (Filters(excluded_color="rosso"), {1, 3}),
        (Filters(unwanted=("calda",)), {2, 3}),
        (Filters(search_keywords="calda, scarpa"), {1, 3}),
        (Filters(age_group="Kids"), set()),
        (Filters(age_group="marziano"), {1, 2, 3}),
        (Filters(brand="%"), {1, 2}),
        (Filters(excluded_product_type="scarpe"), {1, 2}),
    ],
)
def test_filters(spark, filters, ids):
    assert {r.id for r in _view(spark).where(search.predicate(filters)).collect()} == ids


def test_escaped_filters_take_wildcards_as_signs(spark):
    rows = _view(spark)
    assert [rows.where(search.predicate(Filters(brand="%"), escaped=True)).count(), rows.where(search.predicate(Filters(brand="ni_e"))).count(), rows.where(search.predicate(Filters(brand="ni_e"), escaped=True)).count()] == [0, 1, 0]


def test_search_limits_then_ranks(spark):
    f = Filters(brand="nike", sottocategoria="felpe", search_keywords="felpa calda")
    got = search.rank(search.query_page(_view(spark), Filters()), f).collect()
    assert [(r.id, r.score) for r in got] == [(1, 73), (2, 39), (3, 0)]
    assert got[0].reasons == ["marca nike", "categoria felpe", "2 parole chiave pertinenti"] and got[2].reasons == [search.DEFAULT_REASON]
    found = search.search(_view(spark), Filters(sub_queries=(Filters(gender="uomo"), Filters(gender="uomo", product_type="scarpe"), Filters())))
    assert [(r.id, r.score) for r in found.collect()] == [(3, 28), (1, 8)]
    merged = search.overlay(Filters(max_price=10.0), ManualFilters(gender="uomo", max_price=99))
    assert (merged.gender, merged.max_price, merged.merchant) == ("uomo", 99.0, None)


def test_query_texts():
    assert [search.stem(w) for w in ("nera", "blu", "ROSSE")] == ["ner", "blu", "ross"]
    assert search.sanitize(" a\x00b ") == "ab"
    for bad in ("", None, "x" * 501):
        with pytest.raises(ValueError):
            search.sanitize(bad)
    assert search.minimized({"size": "M", "x": 1, "brand": None, "sub_queries": [{"gender": "uomo", "y": 2}]}) == {"size": "M", "sub_queries": [{"gender": "uomo"}]}
    assert len(search.history_text([{"brand": "b" * 2000}])) == 1000
    assert search.link_key(1, "u", {"b": "é", "a": "x"}) == search.link_key(1, "u", {"a": "x", "b": "é"})


def test_views(spark):
    offers = spark.createDataFrame([(1, 10, 5, "s1", "Shop", 9.5, None, True, None, "l", "a", "EUR", T0)], "id long, variant_id long, advertiser_id long, source_product_id string, advertiser_name string, price double, sale_price double, available boolean, image_link string, merchant_deep_link string, aw_deep_link string, currency string, last_seen_at timestamp")
    variants = spark.createDataFrame([(10, 20, None, "k", None, "M", "lana")], "id long, product_id long, color_variant_id long, variant_key string, color string, size string, material string")
    colors = spark.createDataFrame([], "id long, colorway_title string")
    products = spark.createDataFrame([(20, "Felpa", None, "b", "t", "s", None, None)], "id long, canonical_title string, description string, brand string, product_type string, sottocategoria string, gender string, age_group string")
    view = views.catalog_search(offers, variants, colors, products)
    got = view.first()
    assert (got.title, got.sku, got.availability, got.condizione, len(view.columns)) == ("Felpa", "k", 1, "nuovo", 29)
    visuals = spark.createDataFrame([(1, "sha", "nero")], "offer_id long, image_sha256 string, effective_color string")
    seen = spark.createDataFrame([("sha", "v1")], "image_sha256 string, vision_model string")
    full = views.catalog_search_enriched(view, visuals, seen)
    assert len(full.columns) == 41 and (full.first().effective_color, full.first().vision_model) == ("nero", "v1")


def test_queue(spark):
    now = F.lit(T1)
    jobs = spark.createDataFrame([("a", "failed", 3, T0, "e"), ("b", "running", 1, T0, None), ("c", "done", 1, T0, None)], "content_hash string, status string, attempts int, started_at timestamp, error string")
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "content_hash string")
    got = {r.content_hash: (r.status, r.attempts, r.claimed) for r in enrich.claim(jobs, want, now).collect()}
    assert got == {"a": ("failed", 3, False), "b": ("running", 2, True), "c": ("done", 1, False), "d": ("running", 1, True)}
    assert {r.content_hash for r in enrich.retryable(enrich.reset_failed(jobs), now).collect()} == {"a", "b"}


def test_blocks_fail_alone(spark):
    rows = spark.createDataFrame([(f"h{i}", f"t{i}", None) for i in range(6)], "content_hash string, source_title string, description string").coalesce(1)

    def model(block):
        if any(r["source_title"] == "t3" for r in block):
            raise ValueError("no")
        return {r["content_hash"]: {"brand": "x"} for r in block}

    got = {r.content_hash: r.error for r in enrich.run_model(rows, model, block=2).collect()}
    assert [h for h, e in sorted(got.items()) if e] == ["h2", "h3"]


def test_blocks_are_paced_and_billed(spark):
    rows = spark.createDataFrame([(f"h{i}", f"t{i}", None) for i in range(5)], "content_hash string, source_title string, description string").repartition(4)
    refused = []

    def model(block):
        if not refused:
            refused.append(1)
            raise ValueError("429: retry in 0s")
        return {r["content_hash"]: {"brand": "x", "tokens_in": 3, "tokens_out": 1} for r in block}

    got = enrich.run_model(rows, model, block=5, pacer=lambda: enrich.Pacer(0.0, wait=lambda s: None)).collect()
    assert len(got) == 5 and all((r.error, dict(r.fields), r.tokens_in, r.tokens_out) == (None, {"brand": "x"}, 3, 1) for r in got)
    assert enrich.pause_seconds("retry in 1.5 s") == 2.5 and enrich.pause_seconds("no") == 30.0


def test_pacer_waits_and_repeats():
    now, waits, calls = [0.0], [], []

    def wait(s):
        waits.append(s)
        now[0] += s

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("429")
        return "ok"

    pacer = enrich.Pacer(seconds=4.0, clock=lambda: now[0], wait=wait)
    assert pacer.call(run, lambda e: "429" in str(e), lambda e: 1.0) == "ok"
    assert waits == [1.0, 3.0, 1.0, 3.0]
    with pytest.raises(KeyError):
        pacer.call(lambda: {}["x"], lambda e: False, lambda e: 1.0)


def test_title_review(spark):
    flat = spark.createDataFrame([(1, "a", "T", "S", None, None, None, None), (2, "b", "T", "S", None, None, None, None)], "id long, sku string, title string, source_title string, color string, material string, gender string, age_group string")
    answers = spark.createDataFrame([(1, "Nuovo\n titolo", "nero"), (2, "Rotto con", None)], "id long, title string, color string")
    out, audit = titles.apply_reviews(flat, answers, F.lit(T0))
    assert {r.id: (r.title, r.color) for r in out.collect()} == {1: ("Nuovo titolo", "nero"), 2: ("T", None)}
    assert {r.id: r.accepted for r in audit.collect()} == {1: True, 2: False}
    assert [r.id for r in titles.review_queue(flat, audit).collect()] == [2]


def test_sliding_log_counts_accepted_only(spark):
    rows = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, s)) for s in range(0, 60, 3)] + [("k", datetime(2024, 1, 1, 0, 1, 2)), ("j", T0)], "key string, at timestamp")
    got = {r.key: (r.received, r.accepted) for r in state.accepted_requests(rows, "key", "at", 8, 60).collect()}
    assert got == {"k": (21, 9), "j": (1, 1)}


def test_assets(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\xff\xd8\xff\xe0")), (2, bytearray(b"\x89PNG\r\n\x1a\n")), (3, bytearray(b"GIF"))], "id int, c binary")
    assert [r.m for r in rows.select(assets.mime_type(F.col("c")).alias("m")).collect()] == ["image/jpeg", "image/png", None]
    links = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, image_link string")
    got = {r.id: (None if r.content is None else bytes(r.content), r.error is None) for r in assets.fetched(links, lambda u: {"good": b"x"}[u]).collect()}
    assert got == {1: (b"x", True), 2: (None, False)}


def test_feed_files(spark, tmp_path):
    text = 'id,merchant_id,title,price,link,availability\n1,5,"Città ""bella"",\nnuova",10,u,in_stock\n2,5,Corta\n'
    plain, zipped, cp = tmp_path / "a.feed", tmp_path / "b.feed", tmp_path / "c.feed"
    plain.write_bytes(text.encode())
    zipped.write_bytes(gzip.compress(text.encode()))
    cp.write_bytes(text.replace("u,", "€,").encode("cp1252"))
    for source in (plain, zipped, cp):
        rows = feed.read_feed(spark, feed.stage(spark, str(source), str(tmp_path / "stage"))).orderBy("id").collect()
        assert [r.id for r in rows] == ["1", "2"] and rows[0].title.startswith("Città") and rows[1].price is None
    assert feed.detect_encoding(b"\xef\xbb\xbfa") == "utf-8" and feed.detect_encoding("è".encode("cp1252")) == "windows-1252"
    broken = tmp_path / "d.feed"
    broken.write_bytes(gzip.compress(text.encode() * 400)[:-200])
    with pytest.raises(feed.FeedError):
        feed.read_feed(spark, feed.stage(spark, str(broken), str(tmp_path / "stage")))
    waits = []
    with pytest.raises(feed.FeedError):
        feed.stage(spark, "nowhere", str(tmp_path / "stage"), wait=waits.append)
    assert waits == [1, 2]


def test_export_and_runs(spark, tmp_path):
    offers = spark.createDataFrame([("s", "t", 9.5, None)], "sku string, title string, price double, sale_price double")
    feed.write_export(offers, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == feed.EXPORT_COLUMNS and back.first().price == "9.50" and back.first().sale_price is None
    assert runs.run_status(True, 0) == "failed" and runs.run_status(False, 1) == "partial"
    assert "| a | 1 |" in runs.summary({"a": 1}, markdown=True) and runs.summary({"a": 1}) == "a: 1"


def test_streamed_feeds(spark, tmp_path):
    from vetrina.streaming.ingest import limit_requests, stream_feeds

    landing = tmp_path / "landing"
    landing.mkdir()
    header = "advertiser_id,id,title,price,link,availability\n"
    (landing / "1.csv").write_text(header + "1,a,Felpa,10,u,in_stock\n1,b,Polo,5,u,in_stock\n")
    root = str(tmp_path / "catalog")
    schema = spark.createDataFrame([], ", ".join(f"{c} string" for c in header.strip().split(","))).schema
    days = iter(datetime(2024, 1, d) for d in range(1, 9))
    run = lambda: stream_feeds(spark, str(landing), schema, root, str(tmp_path / "cp"), clock=lambda: next(days)).awaitTermination()
    run()
    (landing / "2.csv").write_text(header + "1,a,Felpa,12,u,in_stock\n1,b,Polo,5,u,out_of_stock\n")
    run()
    run()
    catalog = Catalog(spark, root)
    assert {r.source_product_id: (r.price, r.available) for r in catalog.offers().collect()} == {"a": (12.0, True), "b": (5.0, False)}
    log = catalog.table("runs").orderBy("started_at").collect()
    assert [(r.new, r.updated, r.sold_out, r.deactivated) for r in log] == [(2, 0, 0, 0), (0, 1, 1, 1)]
    src = tmp_path / "req"
    spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, s)) for s in range(5)], "key string, at timestamp").coalesce(1).write.json(str(src))
    stream = limit_requests(spark.readStream.schema("key string, at timestamp").json(str(src)), "key", "at", limit=3, seconds=60)
    stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("limited").where("accepted").count() == 3
