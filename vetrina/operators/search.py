"""Structured search: filters to predicates, pages, ranking with reasons, merging, facets."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vetrina import vocab
from vetrina.functions.text import ranking_text
from vetrina.functions.values import all_of, any_of, catalog_size, effective_price, size_order

PAGE, SUB_PAGE = 30, 15
MAX_SLIDER = 250
DEFAULT_REASON = "corrisponde ai filtri applicati"


@dataclass(frozen=True)
class Filters:
    """What a search asks for; only filled fields restrict."""

    brand: str | None = None
    merchant: str | None = None
    gender: str | None = None
    age_group: str | None = None
    condizione: str | None = None
    product_type: str | None = None
    product_types_list: tuple[str, ...] = ()
    sottocategoria: str | None = None
    color: str | None = None
    color_logic: str | None = None
    material: str | None = None
    material_logic: str | None = None
    size: str | None = None
    search_keywords: str | None = None
    unwanted: tuple[str, ...] = ()
    excluded_color: str | None = None
    excluded_material: str | None = None
    excluded_product_type: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    only_on_sale: bool | None = None
    in_stock_only: bool | None = None
    sort_by: str | None = None
    sub_queries: tuple[Filters, ...] = field(default=())


@dataclass(frozen=True)
class ManualFilters:
    """The page's own controls, with the values that mean no choice."""

    merchant: str = "Tutti"
    gender: str = "Tutti"
    size: str = "Tutte"
    max_price: float = MAX_SLIDER
    on_sale: bool = False


def overlay(filters: Filters, manual: ManualFilters | None) -> Filters:
    """Filters with the manual ones that differ from their defaults."""
    if manual is None:
        return filters
    chosen: dict[str, object] = {}
    if manual.merchant and manual.merchant != "Tutti":
        chosen["merchant"] = manual.merchant
    if manual.gender and manual.gender != "Tutti":
        chosen["gender"] = manual.gender
    if manual.size and manual.size != "Tutte":
        chosen["size"] = manual.size
    if manual.max_price < MAX_SLIDER:
        chosen["max_price"] = float(manual.max_price)
    if manual.on_sale:
        chosen["only_on_sale"] = True
    return replace(filters, **chosen)


def stem(word: str) -> str:
    """Lower case, without final vowels if longer than three letters."""
    word = word.lower()
    return re.sub("[aeiou]+$", "", word) if len(word) > 3 else word


def split_list(raw: str) -> list[str]:
    return [x.strip() for x in raw.replace(" e ", ",").split(",") if x.strip()]


def query_age_group(value: str) -> str | None:
    """The stored value of a spoken age group; an unknown one does not filter."""
    return vocab.QUERY_AGE_GROUPS.get(value.strip().lower())


def sanitize(query: object, most: int = 500) -> str:
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", "" if query is None else str(query)).strip()
    if not text:
        raise ValueError("the query is empty")
    if len(text) > most:
        raise ValueError(f"the query is longer than {most} characters")
    return text


def sanitized(c: Column, most: int = 500) -> Column:
    """``sanitize`` for a column: null for a query that is empty or too long."""
    text = F.trim(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    return F.when((text != "") & (F.length(text) <= most), text)


def like(c: Column, value: str, escaped: bool = False) -> Column:
    """Substring without case; ``%`` and ``_`` of the value are wildcards unless ``escaped``."""
    if escaped:
        value = re.sub(r"([\\%_])", r"\\\1", value)
    return c.ilike(f"%{value}%")


def predicate(f: Filters, escaped: bool = False) -> Column:
    """The conjunction of all filled filters over the search view; unavailable offers never pass."""
    has = lambda c, v: like(F.col(c), v, escaped)
    out: list[Column] = [F.col("availability") == 1]
    if f.gender:
        out.append(F.lower("gender") == f.gender.lower())
    if f.age_group and (group := query_age_group(f.age_group)):
        out.append(F.lower("age_group") == group)
    if f.condizione:
        out.append(F.lower("condizione") == f.condizione.lower())
    for c in ("brand", "merchant"):
        if value := getattr(f, c):
            out.append(has(c, value))
    for c, logic in (("material", f.material_logic), ("color", f.color_logic)):
        values = split_list(getattr(f, c) or "")
        if values:
            join = all_of if (logic or "AND").upper() == "AND" else any_of
            out.append(join([has(c, stem(x)) for x in values]))
    for word in f.unwanted:
        out.append(~has("title", word) & ~like(F.coalesce("description", F.lit("")), word, escaped))
    anywhere = lambda v, columns: any_of([has(c, v) for c in columns])
    kind = ("product_type", "sottocategoria", "title")
    if f.product_types_list:
        out.append(any_of([anywhere(x, kind) for x in f.product_types_list]))
    elif f.product_type:
        out.append(anywhere(f.product_type, kind))
    if f.sottocategoria:
        out.append(anywhere(f.sottocategoria, ("sottocategoria", "title")))
    words = (f.search_keywords or "").replace(",", " ").split()
    if words:
        out.append(any_of([anywhere(w, ("title", "description", "product_type", "sottocategoria")) for w in words]))
    if f.excluded_color:
        out.append(~has("color", stem(f.excluded_color.strip())) | F.col("color").isNull())
    if f.excluded_material:
        out.append(~has("material", f.excluded_material) | F.col("material").isNull())
    if f.excluded_product_type:
        out.append(~like(F.coalesce("product_type", F.lit("")), f.excluded_product_type, escaped) & ~has("title", f.excluded_product_type))
    if f.size and f.size.strip():
        wanted = f.size.strip().lower()
        out.append(F.exists(F.split(F.coalesce("size", F.lit("")), ","), lambda x: F.lower(F.trim(x)) == wanted))
    price = effective_price(F.col("price"), F.col("sale_price"))
    if f.max_price is not None:
        out.append(price <= F.lit(f.max_price))
    if f.min_price:
        out.append(price >= F.lit(f.min_price))
    if f.only_on_sale:
        out.append(F.col("sale_price").isNotNull() & (F.col("sale_price") < F.col("price")))
    return all_of(out)


def page_order(f: Filters) -> list[Column]:
    price = F.coalesce("sale_price", "price")
    first = {"price_asc": [price.asc_nulls_last()], "price_desc": [price.desc_nulls_first()]}.get(f.sort_by or "", [])
    return [*first, F.col("id").asc()]


def query_page(view: DataFrame, f: Filters, limit: int = 20, offset: int = 0, escaped: bool = False) -> DataFrame:
    """A page of the view, with each row's ``position`` in it. The page is cut before anything is ranked."""
    rows = view.where(predicate(f, escaped)).orderBy(*page_order(f))
    rows = (rows.offset(offset) if offset else rows).limit(limit)
    # The page has ``limit`` rows, so one partition numbers them.
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*page_order(f))) - 1)


def _plain(value: object) -> str:
    import unicodedata

    text = unicodedata.normalize("NFKD", str(value))
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower()).strip()


def _holds(c: Column, wanted: str) -> Column:
    return F.contains(ranking_text(c), F.lit(wanted)) if wanted else F.lit(False)


def rank(rows: DataFrame, f: Filters) -> DataFrame:
    """Rows with an additive ``score`` and up to three ``reasons``, best first, equal ones in their old order."""
    parts: list[tuple[Column, int, Column]] = []
    text = lambda label, c: F.concat(F.lit(f"{label} "), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    if f.brand:
        parts.append((_holds(F.col("brand"), _plain(f.brand)), 30, text("marca", "brand")))
    kind = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("product_type", "sottocategoria", "title")))
    in_sub = _holds(kind, _plain(f.sottocategoria)) if f.sottocategoria else F.lit(False)
    if f.sottocategoria:
        parts.append((in_sub, 35, text("categoria", "sottocategoria")))
    if f.product_type:
        parts.append((~in_sub & _holds(kind, _plain(f.product_type)), 20, text("tipologia", "product_type")))
    for c, label, points, logic in (("color", "colore", 15, f.color_logic), ("material", "materiale", 10, f.material_logic)):
        wanted = [w for w in map(_plain, re.split(r",|\s+(?:e|o)\s+", getattr(f, c) or "", flags=re.I)) if w]
        if wanted:
            join = all_of if (logic or "OR").upper() == "AND" else any_of
            parts.append((join([_holds(F.col(c), w) for w in wanted]), points, text(label, c)))
    for c, label, points in (("gender", "genere", 8), ("size", "taglia", 8), ("merchant", "negozio", 8), ("condizione", "condizione", 5)):
        if value := getattr(f, c):
            parts.append((_holds(F.col(c), _plain(value)), points, text(label, c)))
    words = [w for w in _plain(f.search_keywords or "").split(" ") if len(w) > 2 and w not in vocab.RANKING_STOP_WORDS]
    score = sum((F.when(F.coalesce(hit, F.lit(False)), points).otherwise(0) for hit, points, _ in parts), F.lit(0))
    reasons = [F.when(F.coalesce(hit, F.lit(False)), why) for hit, _, why in parts]
    if words:
        searched = F.concat_ws(" ", *(ranking_text(F.col(c)) for c in ("title", "description", "product_type", "sottocategoria")))
        found = sum((F.when(F.contains(searched, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
        score = score + F.least(found * 4, F.lit(20))
        reasons.append(F.when(found > 0, F.concat(found.cast("string"), F.lit(" parole chiave pertinenti"))))
    why = F.slice(F.array_compact(F.array(*reasons)), 1, 3) if reasons else F.array().cast("array<string>")
    out = rows.withColumns({"score": score.cast("int"), "reasons": F.when(F.size(why) > 0, why).otherwise(F.array(F.lit(DEFAULT_REASON)))})
    return out.orderBy(F.col("score").desc(), "position")


def search(view: DataFrame, f: Filters, manual: ManualFilters | None = None, rank_all: bool = False) -> DataFrame:
    """Ranked results. Sub-queries are ranked on their own pages and merged: best score first, each offer once.

    ``rank_all`` ranks every match instead of one page of them.
    """

    def ranked(own: Filters, limit: int) -> DataFrame:
        if rank_all:
            return rank(view.where(predicate(own)).withColumn("position", F.col("id")), own)
        return rank(query_page(view, own, limit), own)

    subs = [overlay(s, manual) for s in f.sub_queries]
    subs = [s for s in subs if any(getattr(s, x.name) for x in fields(s) if x.name != "sub_queries")]
    if not subs:
        return ranked(overlay(f, manual), PAGE)
    merged = None
    for i, own in enumerate(subs):
        one = ranked(own, SUB_PAGE).withColumn("_sub", F.lit(i))
        merged = one if merged is None else merged.unionByName(one)
    # Equal scores keep the order of the sub-queries, then their own order.
    order = [F.col("score").desc(), F.col("_sub"), F.col("position")]
    best = merged.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_rn = 1")
    return best.orderBy(*order).drop("_rn", "_sub")


def numbered(ranked: DataFrame, *order: Column) -> DataFrame:
    """Results with their ``place`` from 1, for click parameters: a page's rows, or a facet's few values, in one window."""
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def merchants(view: DataFrame) -> DataFrame:
    return view.where("availability = 1").select("merchant").distinct().orderBy("merchant")


def sizes(view: DataFrame) -> DataFrame:
    """Distinct sizes on offer, in the page's order."""
    rows = view.where("availability = 1 and size is not null").select("size", "title").distinct()
    one = rows.select(F.explode(F.split(F.coalesce(catalog_size(F.col("size"), F.col("title")), F.lit("")), ",")).alias("size"))
    one = one.select(F.trim("size").alias("size")).where("size <> ''").distinct()
    return one.orderBy(*size_order(F.col("size")))


def available_count(view: DataFrame) -> DataFrame:
    return view.agg(F.count_if(F.col("availability") == 1).alias("n"))


def minimized(filters: Mapping[str, object]) -> dict[str, object]:
    """Filters as the history keeps them: allowed keys, filled, sorted, sub-queries alike."""
    out = {k: filters[k] for k in sorted(filters) if k in vocab.HISTORY_KEYS and filters[k] is not None}
    if isinstance(filters.get("sub_queries"), (list, tuple)):
        out["sub_queries"] = [minimized(s) for s in filters["sub_queries"]]
    return out


@F.arrow_udf(StringType())
def _minimized_json(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else json.dumps(minimized(json.loads(x)), ensure_ascii=False) for x in texts.to_pylist()], pa.string())


def minimized_filters(c: Column) -> Column:
    """``minimized`` for a column of JSON objects."""
    return _minimized_json(c)


def history_text(entries: list[Mapping[str, object]], most: int = 1000) -> str:
    return "\n".join(json.dumps(minimized(e), ensure_ascii=False) for e in entries)[-most:]


def click_parameters(campaign: str, place: int) -> dict[str, str]:
    return {"campaign": campaign[:50], "clickref": str(place)}


def link_key(advertiser: int, url: str, parameters: Mapping[str, str]) -> str:
    """Cache key of a link: digest of canonical JSON, keys sorted, ASCII only."""
    return sha256(json.dumps({"advertiser": advertiser, "parameters": dict(parameters), "url": url}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _json_text(c: Column) -> Column:
    """A JSON string, for texts in ASCII without control characters."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))


def link_key_of(advertiser: Column, url: Column, campaign: Column, place: Column) -> Column:
    """``link_key`` with the parameters of a click, for columns of ASCII texts."""
    parameters = F.concat(F.lit('{"campaign":'), _json_text(F.substring(campaign, 1, 50)), F.lit(',"clickref":'), _json_text(place), F.lit("}"))
    return F.sha2(F.concat(F.lit('{"advertiser":'), advertiser.cast("string"), F.lit(',"parameters":'), parameters, F.lit(',"url":'), _json_text(url), F.lit("}")), 256)
