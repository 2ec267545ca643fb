"""Sizes in titles and texts, found word by word.

A text is a row of words with what stands between them. A size takes one word (letters, a number, a region with its
number) or several (``EU 42``, ``38,5``, ``W 32 L 34``, ``taglia unica``). It counts behind a label anywhere, as a list
with separators, and at the end of a text behind a blank or a separator. Texts that name no label are not split at all;
of these only the last words are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vetrina import vocab

_WORD = re.compile(r"\w+")
_LETTERS = frozenset([*vocab.SIZE_LETTERS, *(f"{n}xl" for n in range(2, vocab.SIZE_LARGEST_XL + 1)), *(w for w in vocab.SIZE_WORDS if " " not in w)])
#: Letters that are no words of their own, which go wherever they stand.
_LONG_LETTERS = frozenset(w for w in _LETTERS if len(w) > 1 and w not in vocab.SIZE_WORDS)
_PHRASES = frozenset(tuple(w.split(" ")) for w in vocab.SIZE_WORDS if " " in w)
_ONE_WORDS = [tuple(w.split(" ")) for w in vocab.SIZE_ONE_WORDS]
#: Words of a size at most, and of the end of a text that are looked at.
_MOST, _LAST_WORDS = 4, 6
_JOINS, _LISTS, _CUTS = "/,;|-", ":-", "-|,"


class _Words:
    """The words of a text in lower case, and where they stand."""

    def __init__(self, text: str, begin: int = 0):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text, begin)]
        self.low = [text[a:b].lower() for a, b in self.spans]

    def between(self, i: int) -> str:
        """What stands before word ``i``, back to the word before it."""
        return self.text[self.spans[i - 1][1] if i else 0 : self.spans[i][0]]

    def apart(self, i: int, signs: str) -> bool:
        """Whether blanks and one of ``signs`` at most stand before word ``i``."""
        gap = self.between(i).strip()
        return gap == "" or gap in signs and len(gap) == 1

    def number(self, i: int, digits: str, first: int, last: int, zero: bool) -> int:
        """Words that a number of a range takes, decimals included, if ``digits`` (of word ``i``) is one; else 0."""
        if not (digits.isdecimal() and len(digits) <= 2 and first <= int(digits) <= last) or len(digits) == 2 and digits[0] == "0" and not zero:
            return 0
        decimals = i + 1 < len(self.low) and self.low[i + 1].isdecimal() and self.between(i + 1) in (".", ",")
        return 1 + decimals

    def size(self, i: int) -> int:
        """Words that a size beginning with word ``i`` takes; 0 if there is none."""
        word = self.low[i]
        if word in _LETTERS:
            return 1
        if n := len(word) == 2 and self.number(i, word, *vocab.SIZE_NUMBERS, False):
            return n
        if i + 1 < len(self.low) and (word, self.low[i + 1]) in _PHRASES and self.between(i + 1) == " ":
            return 2
        region = word[:2]
        if region in vocab.SIZE_REGIONS:
            ends, zero = vocab.SIZE_REGIONS[region], region in vocab.SIZE_ZERO_REGIONS
            if len(word) > 2:
                return self.number(i, word[2:], *ends, zero)
            if i + 1 < len(self.low) and self.between(i + 1).isspace() and (n := self.number(i + 1, self.low[i + 1], *ends, zero)):
                return 1 + n
        if word[0] == "w":
            joined = ""
            for n, part in enumerate(self.low[i : i + _MOST]):
                if n and not self.between(i + n).isspace():
                    break
                joined += part
                if len(joined) == 6 and joined[3] == "l" and (joined[1:3] + joined[4:]).isdecimal():
                    return n + 1
        return 0

    def labelled(self) -> Iterator[tuple[int, int, int]]:
        """(start of the label, start, end of the sizes) of each label with sizes behind it."""
        i = 0
        while i < len(self.low):
            at = i
            i += 1
            label = next((x for x in vocab.SIZE_LABELS if self.low[at].endswith(x)), None)
            if label is None or i >= len(self.low) or not self.apart(i, _LISTS) or not (n := self.size(i)):
                continue
            begin, end = i, i + n
            while end < len(self.low) and (gap := self.between(end).strip()) and len(gap) == 1 and gap in _JOINS and (n := self.size(end)):
                end += n
            yield self.spans[at][1] - len(label), self.spans[begin][0], self.spans[end - 1][1]
            i = end

    def last(self) -> tuple[int, int] | None:
        """(start of what goes before it, start) of the size that the text ends with."""
        if not self.spans or self.spans[-1][1] != len(self.text):
            return None
        for i in range(max(0, len(self.low) - _MOST), len(self.low)):
            if i + self.size(i) == len(self.low) and (i or self.spans[0][0]):
                gap = self.between(i)
                rest = gap.rstrip()
                if rest[-1:] and rest[-1] in _CUTS:
                    return self.spans[i][0] - len(gap) + len(rest[:-1].rstrip()), self.spans[i][0]
                if rest != gap:
                    return self.spans[i][0] - len(gap) + len(rest), self.spans[i][0]
        return None


def _has_label(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in vocab.SIZE_LABELS)


_LAST_WORD, _ENDS = re.compile(r"\w+$"), frozenset(w.split(" ")[-1] for w in [*_LETTERS, *vocab.SIZE_WORDS])
_ANYWHERE = re.compile(r"\b(?:" + "|".join(sorted(_LONG_LETTERS | {p[0] for p in _ONE_WORDS})) + r")\b", re.IGNORECASE)


def _end_of(text: str) -> tuple[int, int] | None:
    """``_Words.last`` of a text, of which only the last words are taken apart, and few at all."""
    word = _LAST_WORD.search(text, max(0, len(text) - 12))
    if word is None or not (word[0][-1].isdecimal() or word[0].lower() in _ENDS):
        return None
    begin = max(0, len(text) - 12 * _LAST_WORDS)
    begin = text.find(" ", begin) if begin else 0
    words = _Words(text, max(begin, 0))
    return words.last() if begin <= 0 or len(words.spans) > _MOST else _Words(text).last()


def find(text: str) -> str | None:
    """The sizes behind the first label that has some, else the size at the end."""
    if _has_label(text) and (found := next(_Words(text).labelled(), None)):
        return text[found[1] : found[2]]
    end = _end_of(text)
    return text[end[1] :] if end else None


def strip(text: str) -> str:
    """A title without labelled sizes, words for the one size, letters that are no words, and a size at its end."""
    if _has_label(text):
        out, at = [], 0
        for label, _, end in _Words(text).labelled():
            out.append(text[at:label])
            at = end
        text = "".join([*out, text[at:]])
    cuts: list[tuple[int, int]] = []
    words = _Words(text) if _ANYWHERE.search(text) else None
    for i, word in enumerate(words.low if words else ()):
        for phrase in _ONE_WORDS:
            n = len(phrase)
            if word == phrase[0] and tuple(words.low[i : i + n]) == phrase and all(words.between(k).isspace() for k in range(i + 1, i + n)):
                gap = words.between(i)
                rest = gap.rstrip()
                begin = words.spans[i][0] - (len(gap) - len(rest[:-1].rstrip()) if rest[-1:] and rest[-1] in _CUTS else 0)
                cuts.append((begin, words.spans[i + n - 1][1]))
        if word in _LONG_LETTERS:
            cuts.append(words.spans[i])
    for begin, end in reversed(sorted(cuts)):
        text = text[:begin] + text[end:]
    if end := _end_of(text):
        text = text[: end[0]]
    return text.strip(" -|,")


def _mapped(texts: pa.Array, f) -> pa.Array:
    return pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _found(texts: pa.Array) -> pa.Array:
    return _mapped(texts, find)


@F.arrow_udf(StringType())
def _stripped(texts: pa.Array) -> pa.Array:
    return _mapped(texts, strip)


def of_title_and_text(titles: pa.Array, texts: pa.Array) -> tuple[pa.Array, ...]:
    """(titles without sizes, those once more, sizes of the titles, sizes of the texts)."""
    short = _mapped(titles, strip)
    return short, _mapped(short, strip), _mapped(titles, find), _mapped(texts, find)


def found(c: Column) -> Column:
    """What a text says about its size, as it stands there."""
    return _found(c.cast("string"))


def stripped(c: Column) -> Column:
    """A title without explicit sizes; bare numbers go at its end only."""
    return _stripped(c.cast("string"))
