"""BPE encoding and decoding with a public word-level vocabulary.

Encoding. An Aho-Corasick automaton of all tokens reads a word once and gives the longest token at each position. A walk
from the left keeps a candidate only if the pair table says that it can stand beside its left neighbour in a finished
merge sequence; otherwise the next shorter token, known for every token beforehand, is tried, and when none is left the
walk backtracks one token and never enters that position again. The first complete walk is the exact merge result, in
time linear in the word for a given vocabulary. Chunks between white space repeat, so each worker keeps a bounded table
of chunks already encoded.

Decoding. All token strings lie in one byte table with an offset per id; a text is gathered from it. The vocabulary
names no decoder, so tokens are joined by one space, as the library's ``decode`` does.

Defined cases: null and empty texts have no ids and decode to the empty text; special token strings in a text become
their ids; repeated rows are encoded row by row; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

#: Chunks that a worker remembers in each of two generations, at most.
MEMORY = 300_000
#: Characters of text that are encoded together.
PORTION = 1 << 21
#: The library's white space is Unicode's; ``str.split`` also splits at these four.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Outside the long-settled letters and signs; only there may a code point be too new for Python.
_RARE = re.compile("[^\x00-\u0377\u0400-\u0557\u2010-\u2027\u20a0-\u20bf\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")


def default_vocabulary() -> str:
    """Path of the vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary whose word ends are marked by a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library = path, None
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letter = byte_letters()
        vocab = model["vocab"]
        # The last symbol of a word is a letter of its own, 0x1000 further on.
        keyed = {t: (t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + 0x1000) if t.endswith(suffix) and len(t) > len(suffix) else t) for t in vocab}
        self.length = {i: len(keyed[t]) for t, i in vocab.items()}
        # Single symbols are looked up; the automaton finds the longer tokens.
        self.symbol = {keyed[t]: i for t, i in vocab.items() if len(keyed[t]) == 1}
        self.tokens = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(keyed[t]) > 1:
                self.tokens.add_word(keyed[t], (i, len(keyed[t]) - 1))
        self.tokens.make_automaton()
        self.by_text = {keyed[t]: i for t, i in vocab.items()}
        # The longest token that is a proper prefix of each token; -1 if none.
        self.shorter = [-1] * (max(vocab.values()) + 1)
        for t, i in self.by_text.items():
            self.shorter[i] = next((self.by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.by_text), -1)
        # Ids are not assumed to follow the merges' order: a rank is a token's place among the merges.
        n = max(vocab.values()) + 1
        self.rank = [0] * n
        self.split: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.merged: dict[tuple[int, int], int] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.split[made], self.rank[made] = (vocab[a], vocab[b]), at + 1
            self.merged[vocab[a], vocab[b]] = at + 1
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        strings = [b""] * (max([n, *(i + 1 for i in self.special.values())]))
        for t, i in [*vocab.items(), *self.special.items()]:
            strings[i] = t.encode() + b" "
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        self.strings = np.frombuffer(b"".join(strings), np.uint8)

    def _pair_fits(self, left: int, right: int, bound: int) -> bool:
        """Whether no merge of a rank below ``bound`` crosses the border of ``left`` and ``right`` while they are made.

        The later made of the two is undone towards the border; a merge of the two border tokens would have won if its
        rank is below that of the merge just undone.
        """
        rank, split = self.rank, self.split
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            if rank[left] == 0 and rank[right] == 0:
                return True
            # On the left of the border an equal rank merges first, so only what is earlier can still cross it.
            if rank[left] > rank[right]:
                bound, left = rank[left], split[left][1]
            else:
                bound, right = rank[right] + 1, split[right][0]

    def word(self, symbols: str) -> tuple[int, ...]:
        """Ids of a word given as byte letters, the last one moved to the word-end letters."""
        whole = self.by_text.get(symbols)
        if whole is not None and self._reachable(whole):
            return (whole,)
        n, length, shorter, fits, width = len(symbols), self.length, self.shorter, self.fits, len(self.rank)
        try:
            longest = [self.symbol[c] for c in symbols]
        except KeyError as error:
            raise ValueError(f"no token for {error.args[0]!r}") from error
        for end, (token, back) in self.tokens.iter(symbols):
            longest[end - back] = token
        out, ends, dead = [], [0], set()
        at, token, left = 0, longest[0], -1
        while True:
            while token >= 0:
                to = at + length[token]
                if to not in dead:
                    # The pair table is filled as pairs are met; the start of a word is the left neighbour -1.
                    good = fits.get(key := left * width + token)
                    if good is None:
                        good = fits[key] = self._reachable(token) and (left < 0 or self._pair_fits(left, token, width + 1))
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                if to == n:
                    return (*out, token)
                out.append(token)
                ends.append(to)
                at, left, token = to, token, longest[to]
            else:
                dead.add(at)
                token = shorter[out.pop()]
                ends.pop()
                at, left = ends[-1], out[-1] if out else -1

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        good = self.whole.get(token)
        if good is None:
            (a, b), merged = self.split[token], self.rank[token]
            good = self.whole[token] = merged == 0 or (self._reachable(a) and self._reachable(b) and self._pair_fits(a, b, merged))
        return good

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the vocabulary's splitting pattern."""
        symbols = piece if piece.isascii() and piece.isalpha() else "".join([self.letter[b] for b in piece.encode()])
        return array.array("I", self.word(symbols[:-1] + chr(ord(symbols[-1]) + 0x1000))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space; chunks and their pieces share one memory."""
        found = self.older.get(chunk)
        if found is None:
            # Letters alone, or with one mark behind them, need no pattern.
            if chunk.isalpha():
                found = self._piece(chunk)
            elif not chunk:
                return b""
            else:
                pieces = [chunk[:-1], chunk[-1]] if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha() else self.pieces.findall(chunk)
                if len(pieces) == 1 and pieces[0] == chunk:
                    found = self._piece(chunk)
                else:
                    found = b"".join([self.known.get(p) or self._chunk(p) for p in pieces])
        if len(chunk) <= 64:
            self.known[chunk] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = text.split() if _NOT_SPACE.search(text) is None else regex.split(r"\p{White_Space}+", text)
        out = list(map(self.known.get, chunks))
        if None in out:
            out = [self.known.get(c) or self._chunk(c) if x is None else x for c, x in zip(chunks, out, strict=True)]
            # What was not met since the memory was last full is forgotten.
            if len(self.known) > MEMORY:
                self.older, self.known = self.known, {}
            if len(self.fits) > MEMORY:
                self.fits.clear()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, without any that mark its start or end."""
        if not text.isascii() and _RARE.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._by_library(text)
        if self.cut is None or "<" not in text or not self.cut.search(text):
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(np.array([self.special[found[0]]], "<u4").tobytes())
            at = found.end()
        return np.frombuffer(b"".join([*out, *self._plain(text[at:])]), "<u4")

    def _plain_text(self, text: str) -> str | None:
        """Chunks of ``text`` between ASCII white space; null if it has special tokens or needs the library."""
        if "<" in text and self.cut is not None and self.cut.search(text):
            return None
        if text.isascii():
            return text.lower()
        if _RARE.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return None
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return " ".join(text.split() if _NOT_SPACE.search(text) is None else regex.split(r"\p{White_Space}+", text))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of some texts; a chunk that they repeat is looked up once."""
        plain = [self._plain_text(t) for t in texts]
        parts = pc.ascii_split_whitespace(pa.array(["" if p is None else p for p in plain], pa.large_string()))
        chunks = parts.values.dictionary_encode()
        found = [self.known.get(c) or self._chunk(c) for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        if len(self.fits) > MEMORY:
            self.fits.clear()
        table, size = np.frombuffer(b"".join(found), "<u4"), np.array(list(map(len, found)), np.int64) // 4
        at = chunks.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        # Places are counted in 32 bits where they fit, which is all but one text of gigabytes.
        kind = np.int32 if max(total, len(table)) < 2**31 else np.int64
        shift = ((np.cumsum(size) - size)[at] - (ends - n)).astype(kind)
        ids = table[np.repeat(shift, n) + np.arange(total, dtype=kind)]
        cuts = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        return [self.encode(t) if p is None else ids[a:b] for t, p, a, b in zip(texts, plain, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _by_library(self, text: str) -> np.ndarray:
        """For texts with code points newer than this Python's Unicode tables, which the vocabulary's library may know."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the tokens' strings, joined by one space."""
        start, stop = self.offset[ids], self.offset[ids.astype(np.int64) + 1]
        size = stop - start
        place = np.cumsum(size)
        if not len(place):
            return b""
        return self.strings[np.repeat(start - (place - size), size) + np.arange(place[-1])][:-1].tobytes()


def portions(texts: list[str]) -> Iterator[list[str]]:
    """Some texts at a time: ``PORTION`` characters, or one longer text."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > PORTION:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The worker's own tokenizer for ``path``; the file must be on every executor."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as an array of ints."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            at = 0
            for part in portions(batch.column("text").to_pylist()):
                ids = bpe.encode_many(part)
                flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to, in one pass."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        decimal = [str(i) for i in range(len(bpe.offset))]
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for ids in (x for part in portions(batch.column("text").to_pylist()) for x in bpe.encode_many(part)):
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
