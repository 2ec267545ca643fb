"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import oracle
from test_dedup import _components, _fingerprint, _without_repeats
from vetrina.llm.registry import ORACLES, QUERIES

SF = oracle.SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def _rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert oracle.of_frame(QUERIES[name](spark, SF)) == oracle.of_sql(oracle.connect(SF), ORACLES[name])


def test_op3_holds_out_by_crc_and_scores_all(spark, texts):
    got = {r.doc_id: r for r in _rows(spark, "op3_quality_classifier")}
    assert got.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [r.predicted == labels[i] for i, r in got.items() if r.held_out and i in labels]
    assert np.mean(right) >= 0.9


def test_op5_is_brute_force(spark, texts):
    got = {r.doc_id: r for r in _rows(spark, "op5_quality_rules")}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = defaultdict(list)
        for k in range(len(words) - 4):
            places[tuple(words[k : k + 5])].append(k)
        again = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_op6_is_brute_force(spark, texts):
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    named = _components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in _rows(spark, "op6_simhash_near_dedup")} == {i: (f"{prints[i]:016x}", named[i]) for i in texts}


def test_op7_is_the_library(spark, texts, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in _rows(spark, "op7_bpe_round_trip"):
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_op8_rules_win(spark):
    from vetrina.llm.urls import RULES

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = {r.page_id: r for r in _rows(spark, "op8_url_filter")}
    assert got.keys() == urls.keys()
    for i, url in urls.items():
        host, path = ("", "") if not url or "://" not in url else re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = max(((len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, fit[1]) and got[i].verdict == (fit[2] or got[i].verdict)
        assert got[i].verdict in ("allow", "block")
        assert got[i].held_out == (zlib.crc32((url or "").encode()) % 3 == 1)


def test_op8_on_urls_that_it_was_not_fitted_on(spark):
    from vetrina.llm import common, urls

    pages = common.table(spark, "/root/testdata/sf0.1", "pages")
    labels = {r.url: r.label for r in urls.weak_labels(pages).collect()}
    own = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    seen = [r for r in urls.judge(pages).collect() if r.rule is None and r.held_out]
    right = [(r.verdict == "block") == bool(labels[own[r.page_id]]) for r in seen]
    blocked = [r.verdict == "block" for r in seen if labels[own[r.page_id]]]
    print(len(right), np.mean(right), len(blocked), np.mean(blocked))
    assert np.mean(right) >= 0.95 and np.mean(blocked) >= 0.8


def test_op8_entropy_counts_each_sign(spark):
    from vetrina.llm import urls

    texts = ["", "a", "aab", "http://a.example.com/x?y=1&y=2", "😀é😀", "z" * 300]
    rows = spark.createDataFrame([(t, "h", "/") for t in texts], "url string, host string, path string")
    got = {r.url: r.f_entropy for r in urls.with_features(rows).collect()}
    for t in texts:
        shares = [t.count(c) / len(t) for c in set(t)]
        assert abs(got[t] + sum(p * np.log2(p) for p in shares)) < 1e-5


@pytest.mark.parametrize("urls_", [[], [None, "no scheme", None]])
def test_op8_and_op4_on_odd_tables(spark, urls_):
    from vetrina.llm import chat, urls

    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls_)], "page_id long, url string, host string, _rule int")
    got = urls.judge(pages).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("", "", None, "allow")] * len(urls_)
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string")
    assert chat.format_rows(turns).count() == 0


def test_op9_places_all_pieces_without_gaps(spark, texts, library):
    want, total = set(), 0
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want |= {(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    rows = _rows(spark, "op9_best_fit_packing")
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(spans) <= -(-total // 4096) + 1


def test_op10_is_brute_force(spark, texts):
    want = {i: (n, len(spans), sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in _without_repeats(list(texts.items()))}
    assert {r.doc_id: (r.n_bytes, r.n_spans, r.n_removed, r.kept_sha256) for r in _rows(spark, "op10_suffix_array_dedup")} == want


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
