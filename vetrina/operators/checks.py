"""Data-quality checks: the constraints that a database would hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, unique: Sequence[str] = (), filled: Sequence[str] = (), not_negative: Sequence[str] = ()) -> DataFrame:
    """One row of counts: nulls by column, negatives by column, and rows beyond the first of a key."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in filled]
    counts += [F.count_if(F.col(c) < 0).alias(f"{c}_negative") for c in not_negative]
    out = df.agg(F.count("*").alias("rows"), *counts)
    if unique:
        copies = df.groupBy(*unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("copies"))
        out = out.join(copies)  # one row each
    return out


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Defaults for null values, and for columns that are missing."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
