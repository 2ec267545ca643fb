import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from vetrina.llm import common, exact_dedup, simhash, substring_dedup


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_is_brute_force(docs, corpus):
    got = sorted(tuple(r) for r in exact_dedup.dedup(docs(corpus)).collect())
    groups = defaultdict(list)
    for i, t in corpus:
        groups[_norm(t)].append((-len(t or ""), i))
    want = []
    for i, t in corpus:
        g = groups[_norm(t)]
        want.append((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(_norm(t).encode()).hexdigest()))
    assert got == sorted(want)


def test_exact_dedup_over_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, common.new_path(spark, "test-index"))
    first, second = docs([(5, "a b"), (3, "ab"), (9, "c")]), docs([(1, "a  b"), (2, "d"), (4, "a b")])
    index.append(first)
    index.append(first)  # repeating a batch adds nothing
    assert index.entries().count() == 2
    index.append(second)  # a longer copy is better, a copy as long with a smaller id would be
    assert index.entries().count() == 4
    assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in index.decide(second).collect()} == {1: (1, True, 2), 2: (2, True, 1), 4: (1, False, 2)}
    index.close()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = exact_dedup.DigestIndex(spark, index.root)
        assert again.buckets == index.buckets and again.entries().count() == 4
        third = docs([(7, "ab"), (8, "e"), (9, " d"), (None, " d")])
        again.append(third)
        assert again.entries().count() == 6
        assert {r.doc_id: (r.keep_id, r.kept) for r in again.decide(third).collect()} == {7: (1, False), 8: (8, True), 9: (None, False), None: (None, True)}
        again.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_the_order_of_batches_does_not_matter(spark, docs, corpus):
    whole = {r.digest: (r.chars, r.keep_id) for r in exact_dedup._indexed(docs(corpus))[0].best().collect()}
    for parts in ([corpus[::2], corpus[1::2]], [corpus[1::2], corpus[::2], corpus[:5]]):
        index = exact_dedup.DigestIndex(spark, common.new_path(spark, "test-index"))
        for part in parts:
            index.append(docs(part))
        index.close()
        assert {r.digest: (r.chars, r.keep_id) for r in index.best().collect()} == whole


def test_of_rows_with_one_id_the_longest_stays(docs):
    rows = [(1, "a b"), (1, "ab"), (1, "a\tb"), (2, "a b")]
    kept = exact_dedup.drop_copies(docs(rows)).collect()
    assert len(kept) == 1 and kept[0].doc_id == 1 and kept[0].text in ("a b", "a\tb")


def test_drop_copies_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs([(1, "x"), (1, "x"), (2, "x "), (3, None)], extra="_digest"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "_digest"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_tables(docs):
    none = docs([])
    assert exact_dedup.dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius=4):
    ids = sorted(prints, key=lambda i: (i is None, i))
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= radius and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_are_brute_force(docs, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(corpus)).collect()}
    prints = {i: _fingerprint(t) for i, t in corpus}
    want = _components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize(("cap", "depth"), [(40, 14), (16_384, 2)])
def test_links_over_deep_trees_and_blocks(spark, monkeypatch, cap, depth):
    """Fingerprints at distances up to 5, a dense cluster among them, with tiny shards that are dealt in blocks or have second trees."""
    monkeypatch.setattr(simhash, "SHARD_GOAL", 16)
    monkeypatch.setattr(simhash, "SHARD_CAP", cap)
    monkeypatch.setattr(simhash, "MAX_DEPTH", depth)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.int64)
    prints = set(base.tolist())
    for x in base[:60].tolist():
        for bits in (1, 3, 4, 5):
            y = x
            for b in rng.choice(63, bits, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    for _ in range(150):
        prints.add(int(base[0]) ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)))
    rows = list(enumerate(sorted(prints)))
    got = {r.fp: r.component_id for r in simhash.components(spark.createDataFrame([(i, p) for i, p in rows], "doc_id long, fp long")).collect()}
    want = _components({i: p & (2**64 - 1) for i, p in rows})
    assert got == {p: want[i] for i, p in rows}


def test_a_null_doc_id_links_and_repeated_doc_ids_are_judged_by_row(docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w399", "v399")
    assert 0 < (_fingerprint(base) ^ _fingerprint(near)).bit_count() <= 4
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs([(None, base), (4, near), (9, "alone here")])).collect()}
    assert got == {(None, 4), (4, 4), (9, 9)}
    rows = docs([(7, base), (7, "quite another text"), (3, base), (3, base), (None, "nobody has this one"), (8, near)], extra="_sh_id")
    kept = simhash.drop_near_copies(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "nobody has this one"), (3, base), (7, "quite another text")]


def test_bands_cover_the_radius():
    for radius in (3, 4, 6):
        bands = simhash.bands(radius)
        assert sum(m for m, _ in bands) == 2**64 - 1
        assert sum(r + 1 for _, r in bands) > radius


def test_connected_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (3, 4), (3, 4)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(30)}}


def _without_repeats(rows):
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in rows:
        for a in range(len(t) - 49):
            w = t[a : a + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        out.append((i, len(t), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


def _removed(df):
    return sorted((r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in df.collect())


def test_suffix_array_dedup_is_brute_force(docs, corpus):
    assert _removed(substring_dedup.remove_repeats(docs(corpus))) == _without_repeats(corpus)


def test_suffix_array_dedup_in_parts_and_pieces(docs, corpus, monkeypatch):
    """Shards sorted in many parts and merged, long documents hashed in pieces; texts with zero bytes."""
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 200)
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 500)
    zeros = [(200, "\0" * 70 + "a"), (201, "b" + "\0" * 60), (202, "\0" * 49)]
    segments = substring_dedup.earlier([b"\0" * 50 + b"a", b"\0" * 51, b"b" + b"\0" * 50], np.array([3, 2, 1]))
    assert [s.tolist() for s in segments] == [[True, False], [True, True], [False, False]]
    block = substring_dedup.Block(__import__("pyarrow").table({"doc_id": [1], "text": [b"ab" * 100]}))
    assert sum(int(w.sum()) for *_, w, _ in block.runs()) == 151
    monkeypatch.undo()
    assert _removed(substring_dedup.remove_repeats(docs([*corpus, *zeros]))) == _without_repeats([*corpus, *zeros])


@pytest.mark.parametrize("most", [0, 12])
def test_suffix_array_dedup_of_hot_minimizers(docs, corpus, monkeypatch, most):
    """One gram in many differing surroundings, some of them shared; all minimizers, or the frequent ones, are hot."""
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", most)
    rng = np.random.default_rng(2)
    gram = "the same 16 bytes"
    around = ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(30)]
    rows = [(300 + i, around[i % 30] + gram + around[(i * 7 + i // 30) % 30]) for i in range(90)]
    rows += [(None, around[3] + gram + around[5])]
    want = _without_repeats([(-(2**63) if i is None else i, t) for i, t in [*corpus, *rows]])
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in substring_dedup.remove_repeats(docs([*corpus, *rows])).collect())
    assert got == want


def test_lists_of_minimizers_grow_with_the_text(spark, docs, corpus, monkeypatch):
    """One row for each minimizer of a block, however many blocks or shards there are."""
    import pyarrow as pa

    text = " ".join(t or "" for _, t in corpus).encode()
    rows = lambda parts: [pa.table({"doc_id": [k], "text": [text[k * len(text) // parts : (k + 1) * len(text) // parts]], "block": [k]}) for k in range(parts)]
    few, many = (sum(substring_dedup._minimizer_list(t).num_rows for t in rows(n)) for n in (2, 16))
    assert few <= many < 1.5 * few


def test_no_table_is_left_in_the_catalogue(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    substring_dedup.remove_repeats(docs([(1, "a" * 60), (2, "a" * 60)])).collect()
    exact_dedup.dedup(docs([(1, "a"), (2, "a")])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_without_repeats_carries_columns(docs):
    passage = "é" * 40 + " some passage that two documents share word for word"
    rows = docs([(1, "first " + passage), (2, passage + " second"), (None, None)], extra="c0")
    out = {r.doc_id: r for r in substring_dedup.without_repeats(rows).collect()}
    assert out[1].text == "first " + passage and out[2].text == " second" and out[None].text == ""
    assert out[2].n_chars == 7 and out[2].c0 == "x" and list(out[2].asDict()) == rows.columns
