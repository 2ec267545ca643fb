"""Column functions that clean texts, titles and attribute words.

Everything is a composition of built-in expressions but for accents, which Spark cannot fold: Arrow functions do that,
and they touch only texts beyond ASCII. Each function names its input once, however often it needs it, so that functions
of functions stay small.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vetrina import vocab
from vetrina.functions import sizes

Rules = Iterable[tuple[str, ...]]


def _beyond_ascii(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    beyond = pc.invert(pc.fill_null(pc.string_is_ascii(texts), True))
    if not pc.any(beyond).as_py():
        return texts
    changed = pa.array([change(x) for x in texts.filter(beyond).to_pylist()], texts.type)
    return pc.replace_with_mask(texts, beyond, changed)


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _composed(text: str) -> str:
    return unicodedata.normalize("NFC", text)


@F.arrow_udf(StringType())
def _fold(texts: pa.Array) -> pa.Array:
    return _beyond_ascii(texts, _without_marks)


@F.arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return _beyond_ascii(texts, _composed)


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _fold(c.cast("string"))


def _shown(text: str) -> str | None:
    """``display_text`` of one text."""
    if text.isascii() and text.isprintable():
        plain = text if "  " not in text else " ".join(text.split())
    else:
        plain = " ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in _composed(text)).split())
    return plain.strip() or None


def folded(fold_: dict[str, Column], shown: dict[str, Column], size: tuple[str, str]) -> Column:
    """A struct of folded texts, of texts as they are shown, and of the sizes that two of the latter, a title and a text,
    name: ``short``, ``shorter`` (the title without sizes, once and again), ``title_size`` and ``text_size``. All of it
    takes one exchange with Python."""
    n, title, text = len(fold_), list(shown).index(size[0]), list(shown).index(size[1])
    names = [*fold_, *shown, "short", "shorter", "title_size", "text_size"]

    def run(*texts: pa.Array) -> pa.Array:
        seen = [pa.array([None if x is None else _shown(x) for x in t.to_pylist()], pa.string()) for t in texts[n:]]
        return pa.StructArray.from_arrays([*(_beyond_ascii(x, _without_marks) for x in texts[:n]), *seen, *sizes.of_title_and_text(seen[title], seen[text])], names)

    kind = StructType([StructField(name, StringType()) for name in names])
    return F.arrow_udf(run, kind)(*(c.cast("string") for c in (*fold_.values(), *shown.values())))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    # Single blanks stay as they are: most texts are not copied.
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|[^\S ]", " "))


def normalized_text(c: Column, folded: bool = False) -> Column:
    """Searchable form: folded, lower case, only word characters and ``%+./-``. ``folded``: c is without marks already."""
    text = F.lower(c if folded else fold(c))
    return filled(squeeze(F.regexp_replace(F.translate(text, ",", " "), r"(?U)[^\w\s%+./-]", " ")))


def _any(terms: Iterable[str]) -> str:
    """A pattern of all terms, the longest that fits first. Terms share their beginnings, so that few are tried at a place."""
    tree: dict[str, dict] = {}
    for term in terms:
        node = tree
        for sign in term:
            node = node.setdefault(sign, {})
        node[""] = {}

    def pattern(node: dict[str, dict]) -> str:
        parts = [re.sub(r"([^\w\s])", r"\\\1", sign) + pattern(below) for sign, below in sorted(node.items()) if sign]
        if not parts:
            return ""
        if len(parts) == 1 and "" not in node:
            return parts[0]
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return pattern(tree)


#: What stands between a number and its unit: blanks, with one hyphen at most.
_BEFORE_UNIT = rf"(?<=\b\d{{1,30}})\s*[- ]?\s*(?=(?:{'|'.join(vocab.UNITS)})\b)"


def clean_title(c: Column, folded: bool = False) -> Column:
    """Search title: units joined to their numbers, no marketing phrases, ASCII letters and digits only."""
    text = F.regexp_replace(normalized_text(c, folded), _BEFORE_UNIT, "")
    text = F.regexp_replace(text, rf"(?U)\b(?:{_any(vocab.MARKETING_PHRASES)})\b", " ")
    return filled(squeeze(F.regexp_replace(text, r"(?U)[^a-z0-9\s]", " ")))


def display_text(c: Column, composed: bool = False) -> Column:
    """The original text, composed, without control characters. ``composed``: c is composed, or without marks, already."""
    return filled(squeeze(F.regexp_replace(c if composed else _compose(c.cast("string")), r"\p{C}", " ")))


def normalized_brand(c: Column, folded: bool = False) -> Column:
    return F.get(F.array_except(F.array(normalized_text(c, folded)), F.array(*map(F.lit, vocab.NULL_BRANDS))), F.lit(0))


def word_groups(text: Column, most: int) -> Column:
    """The words of a text, and its groups of up to ``most`` neighbouring words."""

    def groups(words: Column) -> Column:
        out = [words]
        for n in range(2, most + 1):
            # Groups that reach beyond the last word are null, which equals no term.
            out.append(F.zip_with(out[-1], F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.concat(*out)

    return let(F.split(text, " "), groups)


def _longest(terms: Iterable[str]) -> int:
    return max(t.count(" ") + 1 for t in terms)


def rule_terms(text: Column, *rules: Rules) -> Column:
    """The terms of any of some rules that are words of a text: what ``rule_of`` needs, found once for all of them."""
    terms = sorted({t for own in rules for _, *some in own for t in some})
    # A set of literals is hashed once for a plan, an array of them once for a row.
    return F.filter(word_groups(text, _longest(terms)), lambda x: x.isin(terms))


def _ranks(rules: Rules) -> dict[str, int]:
    """The place of the first rule, in their order, of each term."""
    rank: dict[str, int] = {}
    for at, (_, *own) in enumerate(rules):
        for term in own:
            rank.setdefault(term, at)
    return rank


def rule_rank(terms: Column, rules: Rules) -> Column:
    """The place of the first rule, in their order, of which one of ``terms`` is a term."""
    by_term = F.create_map(*[F.lit(x) for pair in _ranks(rules).items() for x in pair])
    return F.array_min(F.transform(terms, lambda x: F.try_element_at(by_term, x)))


def rule_at(rank: Column, rules: Rules) -> Column:
    """Canonical value of the rule at a place."""
    return F.get(F.array(*(F.lit(value) for value, *_ in rules)), rank)


def edge_rank(before: Column, after: Column, rules: Rules) -> Column:
    """The place of the first rule of which the last word of a text and the first one of the text behind it are a term."""
    pairs = {term: at for term, at in _ranks(rules).items() if " " in term}
    if _longest(pairs or [""]) > 2:
        raise ValueError("a term of three words may lie over three texts")
    both = [(*term.split(" "), at) for term, at in pairs.items()]
    found = [F.when((before == first) & (after == last), F.lit(at)) for first, last, at in both]
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("int")


def rule_of(terms: Column, rules: Rules) -> Column:
    """Canonical value of the first rule, in their order, of which one of ``terms`` is a term."""
    rules = list(rules)
    return rule_at(rule_rank(terms, rules), rules)


def first_rule(text: Column, rules: Rules) -> Column:
    """Canonical value of the first rule, in their order, of which a term is a word of ``text``."""
    rules = list(rules)
    return rule_of(rule_terms(text, rules), rules)


def known_value(c: Column, rules: Rules, folded: bool = False) -> Column:
    """Canonical value of a column, null if the vocabulary has none."""
    return first_rule(normalized_text(c, folded), rules)


def canonical_value(c: Column, rules: Rules) -> Column:
    """Canonical value of a column, or its normalised text."""
    return let(normalized_text(c), lambda text: F.coalesce(first_rule(text, rules), text))


def attribute_terms(value: str | None, rules: Rules) -> list[str]:
    """All terms of a canonical value; the value itself if it is not in the vocabulary."""
    if not value:
        return []
    return next((list(terms) for own, *terms in rules if own == value), [value])


def synonyms(c: Column, rules: Rules) -> Column:
    """All terms of a canonical value as an array; the value itself if it is not in the vocabulary, none for an empty one."""
    known: dict[str, list[str]] = {}
    for own, *terms in rules:
        known.setdefault(own, terms)
    by_value = F.create_map(*[x for own, terms in known.items() for x in (F.lit(own), F.array(*map(F.lit, terms)))])
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(F.try_element_at(by_value, c), F.array(c))).otherwise(F.array().cast("array<string>"))


def _phrases(words: Iterable[str]) -> str:
    return "|".join(w.replace(" ", r"\s+") for w in words)


def normalized_size(c: Column, folded: bool = False) -> Column:
    """Sizes as a comma list without repeats, in order of appearance; a comma between digits is a decimal one."""
    raw = F.translate(F.regexp_replace(c.cast("string"), r"(\d),(\d)", "$1.$2"), ",", "/")
    text = normalized_text(raw, folded)
    text = F.regexp_replace(text, rf"(?U)\b(?:{_phrases(vocab.SIZE_ONE_ALIASES)})\b", "taglia unica")
    text = F.regexp_replace(text, rf"(?U)\b(?:{'|'.join(vocab.SIZE_ZERO_REGIONS)})\s*", "")
    parts = F.filter(F.transform(F.split(text, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return filled(F.concat_ws(", ", F.array_distinct(parts)))


def extracted_size(c: Column) -> Column:
    """The size that a text names: labelled anywhere, else at its end."""
    return normalized_size(sizes.found(c), folded=True)


def without_size(c: Column) -> Column:
    """A title without explicit sizes; bare numbers go at its end only."""
    return sizes.stripped(c)


def _tail() -> str:
    """What a title must not end in: separators, and connectors and conjunctions behind a separator, however many."""
    connectors, pairs = "|".join(vocab.TITLE_CONNECTORS), "|".join(vocab.TITLE_PAIR_CONJUNCTIONS)
    lone = "|".join([*vocab.TITLE_CONNECTORS, *vocab.TITLE_CONJUNCTIONS])
    before, after = r"[\s\-|,/]", r"[\s\-–—|,;:/.]"
    return rf"(?iU)(?:{after}|(?<={before})(?:(?:{connectors})\s+(?:{pairs})|{lone})\b(?={after}|$))+$"


_TAIL = _tail()
def _parts(c: Column) -> Column:
    """A text as words and what stands between them, in turn."""
    return F.split(c, r"(?U)\b")


def _without_links(text: Column) -> Column:
    """``text`` without a linking word and a conjunction that follows it: neither has a part of the title behind it."""
    links, ends = F.array(*map(F.lit, vocab.TITLE_LINKS)), F.array(*map(F.lit, vocab.TITLE_CONJUNCTIONS[:2]))

    def cut(parts: Column) -> Column:
        at = lambda i: F.lower(F.coalesce(F.get(parts, i), F.lit("")))
        pair = lambda i: F.array_contains(links, at(i)) & (F.trim(at(i + 1)) == "") & (at(i + 1) != "") & F.array_contains(ends, at(i + 2))
        return F.array_join(F.transform(parts, lambda p, i: F.when(pair(i), " ").when(pair(i - 1) | pair(i - 2), "").otherwise(p)), "")

    # Few titles have such a conjunction; the others are not taken apart.
    return F.when(text.rlike(rf"(?iU)\b(?:{'|'.join(vocab.TITLE_CONJUNCTIONS[:2])})\b"), let(_parts(text), cut)).otherwise(text)


def _spelt(text: Column) -> Column:
    """Pairs of words that feeds often misspell, put right; ``text`` has single blanks."""
    for wrong, right in vocab.SPELLINGS.items():
        text = _replaced_pair(text, *wrong.split(" "), right)
    return text


def _replaced_pair(text: Column, first: str, last: str, right: str) -> Column:
    def put(parts: Column) -> Column:
        at = lambda i: F.lower(F.coalesce(F.get(parts, i), F.lit("")))
        here = lambda i: (at(i) == first) & (at(i + 1) == " ") & (at(i + 2) == last)
        return F.array_join(F.transform(parts, lambda p, i: F.when(here(i), right).when(here(i - 1) | here(i - 2), "").otherwise(p)), "")

    # Few titles have both words; the others are not taken apart.
    low = F.lower(text)
    return F.when(F.contains(low, F.lit(first)) & F.contains(low, F.lit(last)), let(_parts(text), put)).otherwise(text)


def _without_words(c: Column, words: Iterable[str]) -> Column:
    return F.regexp_replace(c, rf"(?iU)(?<!\w)(?:{_any(words)})(?!\w)", " ")


def display_title(title: Column, brand: Column | None = None) -> Column:
    """Short title without sizes, marketing, brand and attribute words, ending in a whole word.

    Words of every attribute vocabulary go whatever the row's own attributes are, which covers those as well. If nothing
    is left, the title without sizes stays. Give the result a column of its own, behind a shuffle or a generator, before
    another function that folds is put on it: Spark does not take such a pair of Python functions apart.
    """
    return let(without_size(title), lambda short: shortened(short, brand))


def _brand_pattern(brand: Column) -> Column:
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(filled(brand), F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    return F.coalesce(quoted, F.lit("(?!)"))


def names_brand(short: Column, brand: Column) -> Column:
    """Whether ``shortened`` of a title differs for its brand."""
    return F.rlike(_without_words(short, vocab.MARKETING_PHRASES), _brand_pattern(brand))


def shortened(short: Column, brand: Column | None) -> Column:
    """``display_title`` of a title without sizes."""
    text = _without_words(short, vocab.MARKETING_PHRASES)
    if brand is not None:
        text = F.regexp_replace(text, _brand_pattern(brand), F.lit(" "))
    attributes = (vocab.COLOR_RULES, vocab.MATERIAL_RULES, vocab.GENDER_RULES, vocab.AGE_GROUP_RULES)
    text = _without_words(text, [*(t for rules in attributes for _, *terms in rules for t in terms), *vocab.DISPLAY_ONLY_WORDS])
    text = F.regexp_replace(squeeze(let(text, _without_links)), _TAIL, "")
    text = let(text, _spelt)
    text = F.btrim(squeeze(text), F.lit(" -|,/:;."))
    return F.coalesce(filled(text), short)


def family_title(clean: Column) -> Column:
    """A clean title without colours and sizes: what colour and size variants of a model share."""
    text = F.regexp_replace(clean, rf"\b(?:{'|'.join(vocab.FAMILY_COLORS)})\b", " ")
    first, last = vocab.SIZE_NUMBERS
    return squeeze(F.regexp_replace(text, rf"\b(?:{'|'.join([*vocab.SIZE_LETTERS, *map(str, range(first, last + 1))])})\b", " "))


def title_issues(title: Column) -> Column:
    """What is wrong with a title, as an array of codes in a fixed order."""
    words = {t for rules in (vocab.COLOR_RULES, vocab.MATERIAL_RULES, vocab.GENDER_RULES, vocab.AGE_GROUP_RULES) for _, *terms in rules for t in terms if len(t) > 2}
    terms = sorted(words | set(vocab.TITLE_ATTRIBUTE_WORDS))

    def issues(text: Column) -> Column:
        found = F.array(
            F.when(F.substring_index(text, " ", -1).isin(vocab.TITLE_TRAILING_WORDS), F.lit("connettivo_finale")),
            F.when(F.size(F.filter(word_groups(text, _longest(terms)), lambda x: x.isin(terms))) > 0, F.lit("attributo_nel_titolo")),
            F.when(text.rlike(rf"(?U)\b(?:{'|'.join(vocab.TITLE_LINKS)})\s*$"), F.lit("preposizione_finale")),
        )
        return F.when(text == "", F.array(F.lit("titolo_vuoto"))).otherwise(F.array_compact(found))

    return let(F.coalesce(normalized_text(title), F.lit("")), issues)


def visual_colors(c: Column) -> Column:
    """Known colours that a text names, as a sorted array."""
    words = F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), "/,-", "   "), r"\s+")
    alias = F.create_map(*[F.lit(x) for pair in vocab.VISUAL_COLOR_ALIASES.items() for x in pair])
    own = F.transform(words, lambda w: F.coalesce(F.try_element_at(alias, w), w))
    return F.array_sort(F.array_intersect(own, F.array(*map(F.lit, vocab.VISUAL_COLORS))))


def color_conflict(feed: Column, seen: Column) -> Column:
    """Whether two colour arrays are both filled, neither multicoloured, and disjoint."""
    many = F.array_contains(feed, "multicolore") | F.array_contains(seen, "multicolore")
    return (F.size(feed) > 0) & (F.size(seen) > 0) & ~many & ~F.arrays_overlap(feed, seen)


def ranking_text(c: Column) -> Column:
    """Text as the ranker compares it: folded, ASCII letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(c.cast("string"), F.lit("")))), "(?U)[^a-z0-9]+", " "))


def without_controls(c: Column) -> Column:
    """A proposed title without control characters."""
    return squeeze(F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " "))


def without_code_fence(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*|\s*```$", ""))
