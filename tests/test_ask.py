"""Typed answers, relational upserts and the request log."""

import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vetrina.operators import ask, sampling, search, state
from vetrina.operators.ask import Field
from vetrina.operators.enrich import Pacer
from vetrina.sources import tables
from vetrina.sources.store import Store


def test_values_are_checked_one_by_one(spark):
    rows = spark.createDataFrame([(i, b"\x89PNG\r\n\x1a\n" + bytes([i])) for i in range(6)], "id long, content binary").coalesce(1)
    good = {"colore_principale": "nero", "materiale_visivo": "pelle", "confidenza_materiale": "alta", "confidenza_generale": 90, "stile": ["sneaker"], "tokens_in": 7}
    answers = {0: good, 1: {**good, "stile": ["a"] * 5}, 2: {**good, "confidenza_generale": 101}, 3: {**good, "confidenza_materiale": "forse", "colori_visibili": "nero"}, 4: {**good, "colori_visibili": [1]}}

    def model(block):
        assert all(isinstance(r["content"], bytes) for r in block)
        return {r["id"]: answers[r["content"][-1]] for r in block if r["content"][-1] in answers}

    got = {r.id: r for r in ask.ask(rows, model, ask.TAGS, columns=["content"], block=2).collect()}
    assert (got[0].colore_principale, got[0].confidenza_generale, got[0].stile, got[0].error, got[0].tokens_in) == ("nero", 90.0, ["sneaker"], None, 7)
    assert got[1].rejected == {"stile": "more than 4"} and got[1].error is None and got[1].stile is None and got[1].materiale_visivo == "pelle"
    assert got[2].error == "confidenza_generale: out of bounds" and got[2].colore_principale is None
    assert got[3].rejected == {"confidenza_materiale": "not one of the values", "colori_visibili": "not a list"}
    assert got[4].rejected == {"colori_visibili": "not a text"} and got[5].error == "no answer"


def test_vectors_and_failures(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(5)], "sha string").coalesce(1)

    def model(block):
        if any(r["sha"] == "k4" for r in block):
            raise OSError("gone")
        return {r["sha"]: {"embedding": [1.0, float("nan") if r["sha"] == "k1" else 2]} for r in block}

    got = {r.sha: r for r in ask.ask(rows, model, ask.vector(2), "sha", block=1).collect()}
    assert list(got["k0"].embedding) == [1.0, 2.0] and got["k1"].error == "embedding: not a number" and got["k4"].error == "OSError: gone"
    paced = ask.ask(rows.repartition(3), lambda block: {r["sha"]: {"embedding": [1, 2]} for r in block}, ask.vector(2), "sha", pacer=lambda: Pacer(1e9)).collect()
    assert len(paced) == 5 and all(r.error is None for r in paced)
    assert ask.ask(rows.limit(0), model, ask.vector(2), "sha").collect() == []


def test_pictures_are_asked_for_once(spark):
    png = b"\x89PNG\r\n\x1a\n"
    fetched = spark.createDataFrame([(1, png + b"a"), (2, png + b"a"), (3, b"text"), (4, None), (5, png + b"b")], "id long, content binary")
    found = ask.pictures(fetched)
    assert sorted(bytes(r.content)[-1:] for r in found.collect()) == [b"a", b"b"]
    assert ask.pictures(fetched, found.where(F.col("content") == F.lit(png + b"a"))).count() == 1


def test_field_kinds():
    assert Field("x", "number").accepted(3) == 3.0 and Field("x").accepted(None) is None
    for field, value in ((Field("x", "number"), True), (Field("x", "number"), "3"), (Field("x", "vector", size=1), 3), (Field("x", required=True), None)):
        with pytest.raises(ValueError):
            field.accepted(value)


def test_relational_upsert_is_all_or_nothing(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/shop;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2)], "id long, title string, color string, rank int")
    tables.write_jdbc(old, url, "offers", options)
    new = spark.createDataFrame([(2, "B", "y", 20), (1, "A", None, 10), (3, "C", None, 30)], "id long, title string, color string, rank int")
    tables.upsert_jdbc(new, url, "offers", ["id"], options, keep_old=["color"], prefer_old=["rank"])
    read = lambda: {tuple(r) for r in tables.read_jdbc(spark, url, "offers", options).collect()}
    want = {(1, "A", "x", 1), (2, "B", "y", 2), (3, "C", None, 30)}
    assert read() == want
    tables.upsert_jdbc(new, url, "offers", ["id"], options, keep_old=["color"], prefer_old=["rank"])
    assert read() == want
    with pytest.raises(Exception):  # noqa: B017  the database's own error
        tables.upsert_jdbc(new.select("id", "title").withColumn("missing", F.lit(1)), url, "offers", ["id"], options)
    assert read() == want
    left = tables.read_jdbc(spark, url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'STAGING%') x", options)
    assert left.count() == 0


def test_stored_upsert_merges_as_the_database_does(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/shop;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    shop, kind = Store(spark, str(tmp_path / "store")), "id long, title string, color string, rank int"
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2), (4, "d", "w", None), (None, "n", "n", 0)], kind)
    new = spark.createDataFrame([(2, None, "y", 20), (1, "A", None, 10), (3, "C", None, 30), (4, "D", "v", 40), (None, "m", None, 1)], kind)
    for rows in (old, new, new.where("id > 1").select("title", "id")):
        tables.upsert_stored(rows, shop, "offers", ["id"], keep_old=["color"], prefer_old=["rank"])
        tables.write_jdbc(rows, url, "offers", options) if rows is old else tables.upsert_jdbc(rows, url, "offers", ["id"], options, *([c for c in names if c in rows.columns] for names in (["color"], ["rank"])))
        got = shop.read("offers").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, tables.read_jdbc(spark, url, "offers", options).collect()))
    with pytest.raises(ValueError, match="has no missing"):
        tables.upsert_stored(new.withColumn("missing", F.lit(1)), shop, "offers", ["id"])
    assert Counter(shop.read("offers").collect()) == Counter(got)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_ON_EXECUTORS = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from vetrina.plans.catalog_queries import QUERIES
from vetrina.sources import tables
conf = {"spark.checkpoint.dir": f"file://{sys.argv[2]}/shared", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
spark.range(30).selectExpr("id p_partkey", "'red ' || id p_name", "'B' p_brand", "'T' p_type", "1 p_size", "1.0D p_retailprice").repartition(4).write.parquet(f"{sys.argv[2]}/in/part.parquet")
got = {r.product_id: (r.title, r.color) for r in QUERIES["relational_upsert"](spark, f"{sys.argv[2]}/in").collect()}
want = {i: (f"red {i}", "red" if i % 7 else None) for i in range(0, 30, 2)}
want |= {i: (f"RED {i}", "verde" if i % 3 == 0 else want.get(i, (None, None))[1]) for i in range(0, 30, 5)}
assert got == want, (got, want)
try:
    tables.write_jdbc(spark.range(3), "jdbc:derby:memory:x;create=true", "t")
except ValueError as error:
    print("refused:", error)
"""


def test_relational_upsert_on_executors(tmp_path):
    done = subprocess.run([sys.executable, "-c", _ON_EXECUTORS, ROOT, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "refused: an embedded database" in done.stdout, done.stderr[-3000:]


def _log(times, limit, seconds):
    passed = []
    for t in sorted(times):
        if sum(t - x < seconds * 1_000_000 for x in passed) < limit:
            passed.append(t)
    return len(passed)


def test_requests_are_folded_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60_000_000)) for _ in range(400)] + [("c", 5)] * 20
    df = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_micros("t").alias("at"))
    for limit, seconds in ((3, 2), (1, 1), (8, 60), (0, 5)):
        got = {r.k: (r.received, r.accepted) for r in state.accepted_requests(df.union(df.limit(1).select("k", F.lit(None).cast("timestamp"))), "k", "at", limit, seconds).collect()}
        by = {}
        for k, t in rows:
            by.setdefault(k, []).append(t)
        assert got == {k: (len(ts), _log(ts, limit, seconds)) for k, ts in by.items()}


def test_a_burst_of_a_million(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 100).alias("at"))
    assert state.accepted_requests(df, "k", "at", 2, 10).first()["accepted"] == 20


def test_seeded_sample(spark):
    rows = spark.range(300).select("id", (F.col("id") % 7).alias("advertiser_id"), (F.col("id") % 50).cast("string").alias("clean_title"))
    first, again, other = (sampling.seeded(rows, 60, seed).collect() for seed in (1, 1, 2))
    assert first == again and {r.id for r in first} != {r.id for r in other}
    assert len({(r.advertiser_id, r.clean_title) for r in first}) == 60  # no family twice
    turns = {}
    for r in first:
        turns.setdefault(r.advertiser_id, []).append(r.turn)
    assert all(sorted(t) == list(range(1, len(t) + 1)) for t in turns.values()) and max(map(len, turns.values())) - min(map(len, turns.values())) <= 1


def test_helpers_of_requests_as_columns(spark):
    urls = ["http://a/b?c=1", 'q"uo\\te', ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r.k for r in df.orderBy("i").select(search.link_key_of(F.col("i"), F.col("u"), F.repeat(F.lit("c"), 60), F.lit("3")).alias("k")).collect()]
    assert got == [search.link_key(i, u, search.click_parameters("c" * 60, 3)) for i, u in enumerate(urls)]
    raw = ['{"brand": "x", "evil": 1, "sub_queries": [{"size": "m", "z": 2}], "color": null}', None]
    kept = [r.k for r in spark.createDataFrame([(x,) for x in raw], "x string").select(search.minimized_filters(F.col("x")).alias("k")).collect()]
    assert kept == ['{"brand": "x", "sub_queries": [{"size": "m"}]}', None]
    clean = [r.q for r in spark.createDataFrame([(" a\x07b ",), ("\x00",), ("x" * 501,)], "x string").select(search.sanitized(F.col("x")).alias("q")).collect()]
    assert clean == ["ab", None, None]
