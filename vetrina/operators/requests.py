"""The search service as functions: requests in, DataFrames out; models and link services are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetrina.operators.search import MAX_SLIDER, Filters, ManualFilters, sanitize, search
from vetrina.operators.state import fresh_links, put_links

_NAMES = {f.name for f in fields(Filters)}


def parse_request(body: Mapping[str, object]) -> tuple[str, ManualFilters]:
    """(query, manual filters) of a request body, with the page's defaults."""
    manual = body.get("filters") or {}
    price = manual.get("maxPrice")
    return sanitize(body.get("query")), ManualFilters(
        merchant=str(manual.get("merchant") or "Tutti"),
        gender=str(manual.get("gender") or "Tutti"),
        size=str(manual.get("size") or "Tutte"),
        max_price=float(MAX_SLIDER if price is None else price),
        on_sale=manual.get("onSale") is True,
    )


def to_filters(extracted: Mapping[str, object] | None, query: str) -> Filters:
    """A model's answer as filters; without one the query's words are searched. Unknown keys are ignored."""
    if not extracted:
        return Filters(search_keywords=query, in_stock_only=True)
    known = {k: v for k, v in extracted.items() if k in _NAMES and k != "sub_queries" and v is not None}
    known |= {k: tuple(known[k]) for k in ("product_types_list", "unwanted") if k in known}
    subs = extracted.get("sub_queries")
    return Filters(**known, sub_queries=tuple(to_filters(s, query) for s in subs if s) if isinstance(subs, (list, tuple)) else ())


def message(count: int) -> str:
    if not count:
        return "Nessun articolo rispetta tutti i filtri: prova a rimuoverne uno o ad ampliare la fascia di prezzo."
    return f"{count} articol{'o' if count == 1 else 'i'} compatibil{'e' if count == 1 else 'i'} con i filtri, in ordine di pertinenza."


def respond(view: DataFrame, body: Mapping[str, object], extract: Callable[[str], Mapping[str, object] | None] = lambda _: None) -> DataFrame:
    """Ranked results for a request."""
    query, manual = parse_request(body)
    return search(view, to_filters(extract(query), query), manual)


def with_links(results: DataFrame, cache: DataFrame, build: Callable[[str], str], now: Column, key: Column) -> tuple[DataFrame, DataFrame]:
    """(results with ``link``, the cache after them): fresh links are reused, others are built, failures keep the plain link.

    Write the second part before using it twice, or links are built twice.
    """
    keyed = results.withColumn("key", key)
    fresh = fresh_links(cache, now).select("key", F.col("link").alias("_cached"))
    todo = keyed.join(fresh, "key", "left_anti").select("key", "merchant_deep_link").dropDuplicates(["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, url in zip(batch["key"], batch["merchant_deep_link"], strict=True):
                try:
                    out.append((k, build(url)))
                except Exception:
                    out.append((k, None))
            yield pd.DataFrame(out, columns=["key", "link"])

    built = todo.mapInPandas(run, "key string, link string").where("link is not null").withColumn("created_at", now)
    known = put_links(cache, built.select(*cache.columns))
    links = fresh_links(known, now).select("key", "link")
    out = keyed.join(links, "key", "left").withColumn("link", F.coalesce("link", "aw_deep_link", "merchant_deep_link"))
    return out.drop("key"), known
