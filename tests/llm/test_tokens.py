import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vetrina.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBpe(bpe.default_vocabulary())


_TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abcdeinorst '.,\n\t\x1c\x85Σéﬁ1"))), max_size=80)


@settings(max_examples=400, deadline=None)
@given(text=_TEXT)
def test_encoder_is_the_library(library, ours, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours.encode(text).tolist() == ids
    assert ours.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False).encode()


@pytest.mark.parametrize("text", ["", " \n", "it's don't we'll I'm", "a<|endoftext|>b <|startoftext|>", "ab" * 3000, "ΑΣ ΣΑΣ", "naïve Ǆ İstanbul", "3.14 1000", "\u0378 new\u1c89"])
def test_encoder_on_hard_texts(library, ours, text):
    assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    own = bpe.WordBpe(bpe.default_vocabulary())
    for text in ("the quick brown fox jumps over", "the lazy dog, the quick cat", "over the fox the dog"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_query(docs, corpus, library):
    got = sorted(tuple(r) for r in bpe.round_trip(docs(corpus)).collect())
    want = []
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(docs([])).count() == 0
    assert {r.doc_id: r.ids for r in bpe.encode(docs([(1, "the fox"), (2, None)])).collect()} == {1: library.encode("the fox").ids, 2: []}


def test_encoding_many_texts_is_encoding_each(ours, library, corpus, monkeypatch):
    """Texts with special tokens, rare code points and white space of every kind, in portions of a few."""
    monkeypatch.setattr(bpe, "PORTION", 500)
    texts = [t or "" for _, t in corpus] + ["<|x|> a", "a\x1cb c", "\u2003É\u00a0Σσ\x85x", "\U000107a3 new", " ", "\n a\t\tb ", "<" + next(iter(ours.special), "s>") + ">" + " tail"]
    assert [len(p) for p in bpe.portions(["a" * 600, "b", "c" * 499, "d"])] == [1, 2, 1]
    got = [ids.tolist() for part in bpe.portions(texts) for ids in ours.encode_many(part)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ours.encode_many([]) == []


def _check_packing(rows, capacity=packing.CAPACITY):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(docs, corpus, library):
    rows = packing.pack(docs(corpus)).collect()
    want = []
    for i, t in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = _check_packing(rows)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack(docs([])).count() == 0
    kept = packing.pack(docs([(1, "a b"), (1, "a b")], extra="_salt"), with_ids=True).collect()
    assert len(kept) == 2 and all(r.ids[-1] == 1 for r in kept)


@pytest.mark.parametrize("mean", [5.0, 6.8, 8.0])
def test_plan_is_near_the_bound(mean):
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(mean, 0.9, 20_000), 1, 4096).astype(np.int64)
    plan = packing.Plan(np.bincount(lengths, minlength=4097))
    assert not plan.left.any()
    bound = max(-(-lengths.sum() // 4096), int((lengths > 2048).sum()))
    assert plan.sequences <= 1.03 * bound + 1
    rank = np.zeros(len(lengths), np.int64)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        rank[own] = np.arange(len(own))
    sequence, offset = plan.place(lengths, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, lengths = sequence[order], offset[order], lengths[order]
    new = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[new] == 0).all() and ((offset + lengths)[:-1][~new[1:]] == offset[1:][~new[1:]]).all() and (offset + lengths).max() <= 4096


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 5)), np.array([0.0, 2.0, 0.0, 1.0, 3.0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
