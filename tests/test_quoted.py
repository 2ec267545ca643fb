"""Quoted CSV in splits of any size against one reading of the whole file."""

import csv
import io
import random

import pytest

from vetrina.sources import feed, quoted


@pytest.fixture
def splits(spark):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def of(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield of
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _file(path, seed, ending="\n", rows=60):
    rng = random.Random(seed)
    signs = ["a", "è", " ", ",", '""', "\n", "x,y", "\r\n", "12", "'"]
    out = ["id,title,note"]
    for i in range(rows):
        cells = [str(i)]
        for _ in range(2):
            cells.append(f'"{"".join(rng.choice(signs) for _ in range(rng.randrange(7)))}"' if rng.random() < 0.5 else rng.choice(["", "plain", '5" wide', 'a"b"c', "è"]))
        out.append(",".join(cells))
    text = ending.join(out) + rng.choice(["", ending])
    path.write_bytes(text.encode())
    return text


def _one_reading(text):
    found = list(csv.reader(io.StringIO(text, newline="")))
    return [tuple(r) for r in found[1:] if r]


@pytest.mark.parametrize("size", [23, 50, 400, 1 << 20])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_equal_one_reading(spark, tmp_path, splits, seed, size):
    path = tmp_path / "f.csv"
    text = _file(path, seed, "\r\n" if seed == 3 else "\n")
    splits(size)
    plain = lambda v: (v or "").replace("\r\n", "\n")
    df = feed.read_feed(spark, str(path))
    got = [tuple(map(plain, (r.id, r.title, r.note))) for r in df.orderBy("feed_pos").collect()]
    assert got == [tuple(map(plain, r)) for r in _one_reading(text)]
    if size == 50:
        assert quoted._lines(spark, str(path)).rdd.getNumPartitions() > 3


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [(b"", False, True), (b'"', True, False), (b'a,"b', True, False), (b'""', False, True), (b'"""', True, False), (b'x"y', False, False), (b'a,""", ', True, False), (b'",', True, False), (b'a","b', True, True), (b',"', True, False), (b'"a"b,"c', True, True)],
)
def test_states(line, outside, inside):
    assert (quoted.ends_inside(line, False), quoted.ends_inside(line, True)) == (outside, inside)


def test_states_are_those_of_a_parser():
    rng = random.Random(4)
    for _ in range(3000):
        line = "".join(rng.choice('ab,"') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            start = '"q' if inside else ""
            # A parser that is still inside swallows a following line.
            rows = list(csv.reader(io.StringIO(start + line + "\nEND\n", newline="")))
            assert quoted.ends_inside(line.encode(), inside) == (len(rows) == 1), (line, inside)


def test_quotes_that_never_close(spark, tmp_path, splits):
    (tmp_path / "f.csv").write_text('id,title\n1,"open\n' + "2,x\n" * 40)
    splits(40)
    with pytest.raises(feed.FeedError):
        feed.read_feed(spark, str(tmp_path / "f.csv"))


def test_headers(spark, tmp_path):
    assert feed.header_names(["a", "", "A", "feed_pos"]) == ["a_0", "_c1", "A", "feed_pos_3"]
    (tmp_path / "f.csv").write_bytes("﻿id,ti`tle,id\n1,x,2,beyond\n3\n\n4,y\n".encode())
    rows = feed.read_feed(spark, str(tmp_path / "f.csv")).orderBy("feed_pos")
    assert rows.columns == ["id_0", "ti`tle", "id", "feed_pos"]
    assert [tuple(r)[:3] for r in rows.collect()] == [("1", "x", "2"), ("3", None, None), ("4", "y", None)]
    (tmp_path / "e.csv").write_bytes(b"")
    assert feed.read_feed(spark, str(tmp_path / "e.csv")).count() == 0
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_a_feed_from_a_web_address(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/feed" else 404)
            self.end_headers()
            self.wfile.write(b"id,title\n1,x\n")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        path = feed.stage(spark, f"{at}/feed", f"file://{tmp_path}/stage")
        assert [r.title for r in feed.read_feed(spark, path).collect()] == ["x"]
        with pytest.raises(feed.FeedError):
            feed.stage(spark, f"{at}/none", f"file://{tmp_path}/stage", wait=lambda _: None)
    finally:
        server.shutdown()
