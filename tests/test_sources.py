"""Relational tables, local pictures, requests and small helpers."""

import pytest
from pyspark.sql import functions as F

from vetrina.operators import assets, checks, requests, search, views
from vetrina.operators.search import Filters
from vetrina.sources import tables


def test_relational_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/shop;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, f"t{i % 3}", i / 2) for i in range(40)], "id long, title string, price double")
    tables.write_jdbc(rows, url, "offers", options, mode="overwrite")
    tables.write_jdbc(rows.where("id < 2").withColumn("id", F.col("id") + 100), url, "offers", options)
    whole = tables.read_jdbc(spark, url, "offers", options)
    assert whole.count() == 42 and whole.toDF("id", "title", "price").where("id = 7").first().title == "t1"
    split = tables.read_jdbc(spark, url, "offers", options, partition=("id", 0, 102, 4))
    assert split.rdd.getNumPartitions() == 4 and split.count() == 42
    tables.write_partitioned(rows, str(tmp_path / "out"), "id", 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and len({r.f for r in back.select(F.input_file_name().alias("f")).collect()}) == 3


def test_local_pictures(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff rest")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n rest")
    (tmp_path / "c.txt").write_bytes(b"no picture")
    (tmp_path / "d.jpg").write_bytes(b"")
    got = {r.path.split("/")[-1]: r.mime for r in assets.local_images(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": "image/jpeg", "b.png": "image/png"}


def _view(spark, titles):
    rows = spark.createDataFrame([(i, t, 10.0 + i, None, 1) for i, t in enumerate(titles)], "id long, title string, price double, sale_price double, availability int")
    texts = "description brand product_type sottocategoria gender age_group color size material condizione merchant".split()
    return rows.withColumns({c: F.lit(None).cast("string") for c in texts})


def test_a_request_gets_ranked_results(spark):
    view = _view(spark, ["giacca rossa", "felpa blu", "felpa verde con cappuccio"])
    plain = requests.respond(view, {"query": "felpa cappuccio"}).collect()
    assert [(r.id, r.score) for r in plain] == [(2, 8), (1, 4)]
    asked = requests.respond(view, {"query": "x", "filters": {"maxPrice": 11}}, lambda q: {"search_keywords": "felpa", "sort_by": "price_asc"}).collect()
    assert [r.id for r in asked] == [1]
    with pytest.raises(ValueError):
        requests.respond(view, {"query": " "})


def test_places_and_clicks(spark):
    found = search.search(_view(spark, ["felpa", "felpa felpa", "altro"]), Filters(search_keywords="felpa"))
    placed = search.numbered(found, F.col("score").desc(), F.col("position")).collect()
    assert [(r.id, r.place) for r in placed] == [(0, 1), (1, 2)]
    assert search.click_parameters("c" * 60, 2) == {"campaign": "c" * 50, "clickref": "2"}


def test_wildcards_are_the_users_unless_escaped(spark):
    view = _view(spark, ["felpa 100%", "felpa 100 pile"])
    ids = lambda **more: [r.id for r in view.where(search.predicate(Filters(unwanted=("100%",)), **more)).collect()]
    assert ids() == [] and ids(escaped=True) == [1]


def test_a_sample_is_complete_or_nothing(spark):
    rows = spark.range(10)
    assert views.complete_sample(rows, 10).count() == 10
    for wanted in (9, 11):
        with pytest.raises(ValueError):
            views.complete_sample(rows, wanted)


def test_defaults(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id long, n int")
    assert {(r.id, r.n, r.m) for r in checks.with_defaults(rows, {"n": 7, "m": "x"}).collect()} == {(1, 7, "x"), (2, 5, "x")}
