"""Balanced samples of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced(products: DataFrame, limit: int, order: Column | str = "feed_pos", family: Column | None = None, repeats: bool = True) -> DataFrame:
    """Up to ``limit`` products: merchants take turns, and a merchant shows each family once before any repeat.

    The turns are a closed form: a product's turn is its rank in its merchant, repeats of a family ranked behind.
    ``repeats`` false leaves repeats out.
    """
    order = F.col(order) if isinstance(order, str) else order
    family = F.lower("clean_title") if family is None else family
    rows = products.withColumn("_copy", F.row_number().over(Window.partitionBy("advertiser_id", family).orderBy(order)) > 1)
    if not repeats:
        rows = rows.where("not _copy")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("advertiser_id").orderBy("_copy", order)))
    return rows.drop("_copy").orderBy("turn", "advertiser_id").limit(limit)


def seeded(products: DataFrame, limit: int, seed: int, key: str = "id") -> DataFrame:
    """A reproducible random balanced sample without repeated families."""
    return balanced(products, limit, F.xxhash64(F.lit(seed), F.col(key)), repeats=False)
