import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetrina.llm import chat, licenses, quality_model, quality_rules, urls

SF = "/root/testdata/sf0.01"


def test_license_scan_is_brute_force(docs):
    templates = {"A": "Licensed under the Apache License, Version 2.0.", "B": "Released under the MIT License.", "C": "Released under the X11 License."}
    rows = [(1, "Text\nReleased under the MIT License.\nmore"), (2, "LICENSED under the apache license version 2 0"), (3, None), (4, ""), (5, "one"), (6, "Released under the MIT License. and more"), (7, "the the the the the the"), (8, "\n".join(["Released under the MIT License."] * 3)), (9, "licensed under the Apache License, é Version 2.0.")]
    got = {r.doc_id: (r.n_matches, r.license, r.dice) for r in licenses.licenses(docs(rows), templates).collect()}

    def words(s):
        signs = {chr(c) for a, b in licenses.SIGN_RANGES for c in range(a, b + 1)}
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(" " if c in signs else c.lower() if c.isascii() else c for c in s))

    def grams(s):
        w = words(s)
        return {(a, b) for a, b in zip(w, w[1:], strict=False)}

    for i, text in rows:
        lines = (text or "").split("\n")
        units = [" ".join(lines)] * (len(lines) > 1) + lines
        found = []
        for u in units:
            g = grams(u)
            best = max(((2 * len(g & grams(t)) / (len(g) + len(grams(t))), n) for n, t in templates.items()), default=(0, "")) if g else (0, "")
            if best[0] >= 0.8:
                found.append(best)
        top = max(found, default=(None, None))
        assert got[i] == (len(found), top[1], None if top[0] is None else pytest.approx(top[0], abs=1e-6)), i
    assert licenses.licenses(docs([])).count() == 0


def _embedded(text, templates, least=0.8):
    """(license, dice) of the runs that count, comparing every stretch of words with every template."""
    split = lambda s: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in s))
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    dice = lambda p, q: 2 * len(set(p) & set(q)) / (len(set(p)) + len(set(q)))
    known = {n: pairs(split(t)) for n, t in templates.items()}
    lines, matched, at = [split(x) for x in text.split("\n")], [], 0
    for k, w in enumerate([*lines, sum(lines, [])]):
        whole = k == len(lines)
        first = 0 if whole else at
        top = max((dice(pairs(w), q) for q in known.values()), default=0) if len(w) > 1 else 0
        if top >= least:
            matched.append((first, first + len(w), top, not whole))
        at += 0 if whole else len(w)
    p = pairs(sum(lines, []))
    found = []
    for k, (n, q) in enumerate(sorted(known.items())):
        for i in range(len(p)):
            ends = [j for j in range(i, min(len(p), i + int(len(q) * (2 - least) / least + 1e-9))) if p[i] in q and p[j] in q]
            best = max(((dice(p[i : j + 1], q), -j) for j in ends), default=(0, 0))
            if best[0] >= least:
                found.append((-best[0], -k, i, 2 - best[1], n))
    kept = []
    for d, _, a, b, n in sorted(found):
        seen = any((line and f <= a and b <= e) or (f < b and a < e and c >= -d) for f, e, c, line in matched)
        if not seen and not any(a < y and x < b for x, y, *_ in kept):
            kept.append((a, b, n, -d))
    return sorted((n, round(d, 6)) for _, _, n, d in kept)


def test_license_notices_wrapped_and_embedded(docs):
    code = "import os\n\ndef f(x):\n    return x + 1\n" * 5
    prose = "Plain prose under the tree, and the license of the poet is to be read with the rights of all. " * 3
    rows, name_of = [], {}
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split()
        wrapped = "\n".join("# " + " ".join(words[i : i + 3]) for i in range(0, len(words), 3))
        rows += [(4 * k, prose + "\n" + wrapped + "\n" + code), (4 * k + 1, f"{prose} {text} {prose}"), (4 * k + 2, f"{wrapped}\n{prose}\n{wrapped}"), (4 * k + 3, wrapped + "\n" + "\n".join(words[::2]) + prose)]
        name_of |= {4 * k + j: name for j in range(4)}
    rows += [(90, "Copyright 2024 Foo. Released under the MIT License."), (91, "Released under\nthe MIT License. " + prose), (92, prose), (93, prose + " Released under the MIT License. Licensed under the Apache License, Version 2.0. " + prose), (94, "Released under the MIT License.\n" * 3 + prose)]
    got = {}
    for r in licenses.scan(docs(rows)).where("unit is null").collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.dice, 6)))
    assert {i: sorted(g) for i, g in got.items()} == {i: g for i, t in rows if (g := _embedded(t, licenses.TEMPLATES))}
    best = {r.doc_id: (r.license, r.dice) for r in licenses.licenses(docs(rows)).collect()}
    for i, name in name_of.items():
        assert best[i][0] == name and best[i][1] >= 0.8, i
    assert best[90] == best[91] == ("MIT", 1.0) and best[92] == (None, None)
    assert {n for n, _ in got[93]} == {"Apache-2.0", "MIT"} and 94 not in got


def test_license_signs_beyond_ascii_separate_words(docs):
    """No-break spaces and typographic quotes cost nothing; a needed word within a longer one is none."""
    gpl = licenses.TEMPLATES["GPL-3.0-header"].replace(" ", "\u00a0")
    header = licenses.TEMPLATES["Apache-2.0-header"].replace('("License")', "(\u201cLicense\u201d)")
    rows = [(1, gpl), (2, header), (3, "unreleasedunder the MITlicense " * 3)]
    assert {r.doc_id: (r.license, r.dice) for r in licenses.licenses(docs(rows)).collect()} == {1: ("GPL-3.0-header", 1.0), 2: ("Apache-2.0-header", 1.0), 3: (None, None)}


def test_license_needed_words_lose_nothing():
    for grams in licenses.template_bigrams(licenses.TEMPLATES).values():
        words = licenses.needed_words(grams, 0.8)
        assert sum(not set(words) & set(g.split()) for g in grams) < licenses.size_bounds(len(grams), 0.8)[0]


def test_license_bounds_lose_nothing():
    for n in (3, 7, 40):
        low, high = licenses.size_bounds(n, 0.8)
        sizes = [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= 0.8]
        assert (min(sizes), max(sizes)) == (low, high)


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":1}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"GPT","value":"b"},{"from":"tool","value":"c"}]}', [("user", "a"), ("assistant", "b"), ("tool", "c")]),
        ('{"conv_id":5,"text":"t","messages":[{"role":"system","content":"a"}]}', [("system", "a")]),
        ('{"messages":[{"role":"user"},{"role":"bot","content":"b"},{"content":"c","name":"x"}]}', [("user", None), ("assistant", "b"), (None, "c")]),
        ('{"messages":[{"role":"user","content":"a"}],"prompt":"p","response":"r"}', [("user", "a")]),
        ('{"messages":[],"id":3}', []),
        ('{"conversations":[{"from":"gpt","value":{"deep":[1]}}],"turn":2}', [("assistant", '{"deep":[1]}')]),
        ('{"instruction":"do","input":"it","output":"ok"}', [("user", "do\n\nit"), ("assistant", "ok")]),
        ('{"instruction":"do","input":"","output":"ok"}', [("user", "do"), ("assistant", "ok")]),
        ('{"prompt":"p","completion":"c","meta":{"x":1}}', [("user", "p"), ("assistant", "c")]),
        ('{"question":"q","answer":null}', [("user", "q"), ("assistant", None)]),
        ('{"other":1}', None),
        ("not json", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "i int, r string")
    got = [r.t for r in rows.select("i", chat.json_turns(F.col("r")).alias("t")).orderBy("i").collect()]
    assert [None if t is None else [(x.role, x.text) for x in t] for t in got] == [w for _, w in records]
    with pytest.raises(ValueError):
        chat.layouts_of(spark.createDataFrame([], "a int").schema)


def test_chat_table_of_mixed_layouts(spark):
    """One typed table, a layout per row; answers of every layout are under the loss mask, and no record vanishes."""
    rows = [
        (1, [("human", "a"), ("gpt", "b")], None, None, "x"),
        (2, None, "p", "r", None),
        (3, [("user", "c")], "p", "r", None),
        (4, [], None, None, None),
        (5, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "conv_id long, conversations array<struct<from: string, value: string>>, prompt string, response string, text string")
    out = chat.format_rows(table).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("f"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "|").alias("loss"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.loss) for r in out.select("conv_id", chat.read_turns(F.col("f")).alias("t"), "loss").collect()}
    assert got == {1: ([("user", "a"), ("assistant", "b")], "b"), 2: ([("user", "p"), ("assistant", "r")], "r"), 3: ([("user", "c")], ""), 4: ([], ""), 5: ([], "")}


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<s>", r"<\s> <\\/s> [\INST]", "[[INST]]", "[", "<", "plain", "", "[ROLE]x[/ROLE]", "\\", "<s<s>>", "[/INST"])
def test_chat_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "us[/ROLE]er", text), (1, 1, "assistant", text), (1, 2, None, None), (1, 1, "assistant", "b" + text)], "conv_id long, turn long, role string, text string")
    out = chat.format_rows(rows).select("segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("f"))
    got = out.select(chat.read_turns(F.col("f")).alias("t"), "segments").first()
    twice = sorted([text, "b" + text])
    assert [(t.role, t.text) for t in got.t] == [("us[/ROLE]er", text), ("assistant", twice[0]), ("assistant", twice[1]), ("", "")]
    assert sum(s.loss for s in got.segments) == 2


def test_chat_of_many_chunks_and_none(spark):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.format_rows(rows).select(chat.read_turns(F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("t")).first().t
    assert [t.text for t in got] == [str(i) for i in range(1000)]
    assert chat.format_rows(rows.limit(0)).count() == 0
    typed = spark.createDataFrame([("p", "r", 1)], "prompt string, response string, other int")
    assert chat.format_rows(typed).first().segments[1].text == "p"


def test_url_rules_are_brute_force(spark):
    given = [None, "", "no scheme", "http://A.Example.ORG/es/1?x#y", "http://example.org", "https://notexample.org/es/", "http://x.com/de/2", "http://X.COM/FR/", "http://org/", "a://b://c/d", "http://example.org/en/12", "http://h.net?a=1&b=2", "http://h.net#/es/", "http://user@spam-farm.net/a//b-c"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, u in enumerate(given):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = max(((len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, fit and fit[1])
        assert got[i].verdict == fit[2] if fit else got[i].verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_model_learns_held_out_urls(spark):
    rows = [(i, f"http://{'free-offer' if i % 2 else 'shop'}{i % 7}.example.{'net' if i % 3 else 'com'}/p/{i}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows[:200], "page_id long, url string, label int")
    rest = spark.createDataFrame([(i, u) for i, u, _ in rows[200:]], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(rest, urls.RULES[:1], labelled).collect()}
    right = sum((got[i] == "block") == bool(y) for i, _, y in rows[200:])
    assert right >= 190
    alone = urls.judge(rest, urls.RULES[:1], labelled.withColumn("label", F.lit(0)))
    assert {r.verdict for r in alone.collect()} == {"allow"}


def test_url_verdicts_do_not_depend_on_the_sample(spark, monkeypatch):
    """Urls of equal features, one in six blocked, beside clean ones of another kind: allowed below and above the bound."""
    names = ["".join(p) for p in itertools.permutations("abcdef")]
    rows = [(f"http://shop.example.net/{n}", int(i % 6 == 0)) for i, n in enumerate(names)] + [(f"http://shop.example.net/2024/long/{n}", 0) for n in names]
    labelled = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame(list(enumerate(u for u, _ in rows[::40])), "page_id long, url string")
    whole = {r.page_id: r.verdict for r in urls.judge(pages, urls.RULES[:1], labelled).collect()}
    monkeypatch.setattr(urls, "TRAIN_ROWS", 100)
    assert {r.page_id: r.verdict for r in urls.judge(pages, urls.RULES[:1], labelled).collect()} == whole
    assert set(whole.values()) == {"allow"}


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(hit)


def test_base_rules_are_brute_force(spark, docs, corpus):
    rows = [*corpus, (300, "a b c d e f a b c d e g"), (301, "x\nx\n \nx y"), (302, "#a *$% &|<> é# " * 4), (303, "a " * 30)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r)[:6] + (r.base_failed,) for r in quality_rules.judge(docs(rows), labels).collect())
    want = []
    for i, t in rows:
        b = _base(t)
        want.append((i, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert got == sorted(want)
    assert quality_rules.judge(docs([]), labels).count() == 0
    assert not any(r.ratio for r in quality_rules.judge(docs(rows), labels.limit(0)).collect())


def test_gram_ratio_is_brute_force():
    texts = [b"", b"abc", b"abcd", b"abcdeabcd", "é".encode() * 5]
    bucket, n = quality_rules.grams(texts)
    assert n.tolist() == [0, 0, 1, 6, 7]
    ratio = np.arange(quality_rules.BUCKETS, dtype=np.float32) / 1000
    got = quality_rules.mean_ratios(texts, ratio)
    for t, g in zip(texts, got, strict=True):
        own = [((int.from_bytes(t[i : i + 4], "little") * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(t) - 3)]
        assert g == pytest.approx(np.mean([ratio[b] for b in own]) if own else 0.0, rel=1e-5)


def test_quality_rules_tell_junk_from_prose(spark):
    found = quality_rules.op5_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    junk, good = [r for r in found if r.quality == 0], [r for r in found if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in junk) <= 0.2 * len(junk)


def test_quality_rules_verdict_is_brute_force(spark, docs, corpus, monkeypatch):
    """Ratio and verdict of every document from plain counts, with a map of ids so small that it lets others through."""
    monkeypatch.setattr(quality_rules, "BITS", 1 << 6)
    ids = sorted({i for i, _ in corpus})
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in ids[:90]] + [(ids[1], 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = {i for i in ids[:90] if i % 3 == 0} | {ids[1]}
    rows = docs([*corpus, (None, "no id at all " * 3)])
    found = quality_rules._trusted(rows, labels)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in found.collect()) == sorted(i for i, _ in corpus if i in trusted)
    bucket = lambda g: (int.from_bytes(g, "little") * 2654435761 % 2**32) >> 16
    grams = lambda t: [bucket(t[a : a + 4]) for a in range(len(t) - 3)]
    texts = [(i, (t or "").encode()) for i, t in [*corpus, (None, "no id at all " * 3)]]
    raw = Counter(g for _, t in texts for g in grams(t))
    target = Counter(g for i, t in texts if i in trusted for g in grams(t))
    n_raw, n_target = sum(raw.values()) + 65536, sum(target.values()) + 65536
    ratio = lambda g: np.log((target[g] + 1) / n_target) - np.log((raw[g] + 1) / n_raw)
    least = sum(n * ratio(g) for g, n in target.items()) / sum(target.values()) - quality_rules.MARGIN
    got = {}
    for r in quality_rules.judge(rows, labels).collect():
        got[r.doc_id] = r
    for i, t in texts:
        own = grams(t)
        want = sum(map(ratio, own)) / max(1, len(own))
        assert got[i].ratio == pytest.approx(want, abs=1e-5)
        assert got[i].kept == (not got[i].base_failed and want >= least)


def test_quality_model_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 80
    for y in (0, 1):
        own = [r for r in found if r.quality == y]
        assert sum(r.predicted == y for r in own) >= 0.9 * len(own)
    again = {r.doc_id: r.score for r in quality_model.quality(docs, labels).collect()}
    assert all(again[r.doc_id] == r.score for r in found)


def test_quality_model_edge_cases(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "x"), (3, "long " * 9000)], extra="_score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.quality(rows, none).collect()
    assert [r.score for r in got] == [0.5] * 4
    assert quality_model.drop_low_quality(rows, none).columns == rows.columns
    assert quality_model.quality(docs([]), none).count() == 0


def _plain_score(text, p):
    """The score of one text, passage by passage and sum by sum."""
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]

    def kind(b):
        if b > 127:
            return 1
        if chr(b).isupper():
            return 2
        if chr(b).isdigit():
            return 3
        if b == 10:
            return 5
        if b < 33:
            return 4
        return 6 + signs.index(b) if b in signs else 0

    hidden, drawn = [], []
    for at in range(0, max(1, len(text)), 400):
        part = text[at : at + 400]
        bins = np.zeros(256)
        for a, b, c in zip(part, part[1:], part[2:], strict=False):
            gram = (kind(a) * 64 + kind(b)) * 64 + kind(c)
            bins[(gram * 2654435761 % 2**32) >> 24] += 1
        words = part.split()
        n = max(1, len(words))
        again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        x = np.r_[np.sqrt(bins / max(1, bins.sum())), again, 1 - len(set(words)) / n]
        h = np.tanh(x @ p["W"] + p["b"])
        hidden.append(h)
        drawn.append(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))) @ p["w"])
    weight = np.exp(drawn) / np.exp(drawn).sum()
    return 1 / (1 + np.exp(-(sum(a * h for a, h in zip(weight, hidden, strict=True)) @ p["c"] + p["d"][0])))


def test_quality_scores_are_brute_force(spark, docs, corpus, monkeypatch):
    """Every row's score, against a plain forward pass over its whole text; portions of a few texts."""
    monkeypatch.setattr(quality_model, "PORTION", 3000)
    assert [(a, len(p)) for a, p in quality_model.portions([b"x" * 2000, b"", b"y" * 1500, b"z" * 9000, b"w"])] == [(0, 2), (2, 1), (3, 1), (4, 1)]
    rng = np.random.default_rng(5)
    model = quality_model.AttentionModel(rng)
    for v in model.p.values():
        v += rng.normal(0, 0.5, v.shape)
    rows = docs(corpus)
    got = sorted((r.doc_id, r._score) for r in quality_model.scored(rows, model, ["doc_id"]).collect())
    want = sorted((i, float(_plain_score((t or "").encode(), model.p))) for i, t in corpus)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)


def test_quality_training_reads_whole_texts_of_a_bounded_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_model, "TRAIN_PASSAGES", 30)
    seen = {}
    monkeypatch.setattr(quality_model, "fit", lambda x, counts, y: seen.update(counts=sorted(counts.tolist()), rows=len(x)) or quality_model.AttentionModel(np.random.default_rng(0)))
    free = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(free[0], "a" * 4000), (free[1], "b" * 400 * 31), (free[2], "c" * 4000), (free[3], "d" * 4000), *[(free[4], "e" * 800)] * 3, (free[4], "f")]
    labels = spark.createDataFrame([(free[k], 1 if k < 4 else 0, 0) for k in range(5)], "doc_id long, quality int, toxic int")
    quality_model.train(docs(rows), labels)
    assert seen == {"counts": [2, 10, 10, 10], "rows": 32}


def test_attention_gradient():
    rng = np.random.default_rng(0)
    model = quality_model.AttentionModel(rng)
    for v in model.p.values():
        v += rng.normal(0, 0.2, v.shape)
    x, counts, y, weight = rng.random((7, quality_model.INPUTS)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        s, _ = model.forward(x, counts)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    g = model.gradient(x, counts, y, weight)
    for name, value in model.p.items():
        at = tuple(0 for _ in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
