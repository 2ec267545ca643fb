"""Embedding whitening: exact sums, one aggregation over every pair of dimensions, LAPACK, then a projection of each row.

Entries become whole numbers x = floor(scale * c) + shift. A first aggregation sums each dimension exactly. A second has
one generated SQL expression for each pair of the upper triangle, which sums products of entries that were centred
before. The driver gets these sums alone (their number depends on the dimension, not on the rows), assembles the
covariance and decomposes it with LAPACK; a matrix of as many columns as components goes back with the tasks. Rows are
projected in Arrow batches, and a last aggregation of the same form measures the covariance of what came out.

No step shuffles rows: each task adds up its own rows, and what meets are one row of sums for each task.

Centring is exact where it matters: with m the whole part of a dimension's mean and r the rest, x - m is a whole number,
and (x - m) - r loses nothing by the size of x.

Defined cases: rows with a null vector or a null or non-finite entry are left out, as are null entries' rows; shorter
vectors are filled up with entries of zero to the longest one's length; repeated rows count each on their own; a null id
is carried like any other; a component without variance (an eigenvalue of rounding size) has whitened values of zero and
does not count in ``identity_error``; a deviation beyond a long is null; an empty table, or one whose vectors are all
left out or empty, gives an empty result; extra columns are not read. Entries beyond 2^62 in size end the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

#: Sums of one aggregation, at most; more pairs than that (beyond some 100 dimensions) take several.
SUMS = 6000
_COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_list(rows: DataFrame, scale: int, shift: int) -> tuple[DataFrame, int]:
    """((vec_id, x) of the rows that remain, dimensions)."""
    wrong = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(F.col("embedding").isNotNull() & ~wrong).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    least, most = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))
    if least != most:
        x = F.concat(x, F.array_repeat(F.lit(shift).cast("long"), F.lit(most) - F.size("embedding")))
    return kept.select("vec_id", x.alias("x")), most or 0


def pair_sums(rows: DataFrame, names: list[str]) -> np.ndarray:
    """The symmetric matrix of summed products of columns: the upper triangle as generated expressions."""
    # Columns that cannot be null make the sums' code a third as long.
    rows = rows.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    out = np.zeros((len(names), len(names)))
    for at in range(0, len(pairs), SUMS):
        some = pairs[at : at + SUMS]
        found = rows.agg(*(F.expr(f"sum({names[i]} * {names[j]}) AS s{k}") for k, (i, j) in enumerate(some))).first()
        for (i, j), s in zip(some, found, strict=True):
            out[i, j] = out[j, i] = s
    return out


def decompose(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the first ``most`` components, by falling eigenvalue."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


def whiten(rows: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each remaining row of ``rows`` (vec_id, embedding) and component.

    Columns: vec_id, component (from 1), n (rows of the fit list), deviation (exact sum of (n * x - S)^2 over the
    dimensions), whitened, explained (share of the trace), identity_error (one value: how far the covariance of the
    whitened values is from the identity).
    """
    spark = rows.sparkSession
    kept, width = fit_list(rows, scale, shift)
    if not width:
        return spark.createDataFrame([], _COLUMNS)
    n, *total = kept.agg(F.count("*"), *(F.sum(F.col("x")[i]) for i in range(width))).first()
    whole, rest = [s // n for s in total], [s % n for s in total]

    near = [F.col("x")[i] - F.lit(whole[i]).cast("long") for i in range(width)]
    centred = kept.select(*((near[i] - F.lit(rest[i] / n)).alias(f"c{i}") for i in range(width)))
    covariance = pair_sums(centred, centred.columns) / n
    trace = float(np.trace(covariance))
    values, vectors = decompose(covariance, min(components, width))
    live = values > trace * width * np.finfo(float).eps
    weights = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    means = np.array([r / n for r in rest])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("d").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            w = (x - means) @ weights
            ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("deviation"), pa.ListArray.from_arrays(ends, np.ascontiguousarray(w).ravel())], names=["vec_id", "deviation", "w"])

    # n * x - S is n * (x - whole) - rest; what does not fit a long is null.
    moved = F.array(*(F.try_subtract(F.try_multiply(F.lit(n).cast("long"), F.col("d")[i]), F.lit(r).cast("long")) for i, r in enumerate(rest)))
    squares = F.aggregate("_moved", F.lit(0).cast("long"), lambda a, y: F.try_add(a, F.try_multiply(y, y)))
    placed = kept.select("vec_id", F.array(*near).alias("d")).withColumn("_moved", moved).select("vec_id", squares.alias("deviation"), "d")
    # Read three times: for means, for products, and for the result.
    wide = common.materialize(placed.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    names = [f"w{k}" for k in range(len(values))]
    flat = wide.select(*(F.col("w")[k].alias(name) for k, name in enumerate(names)))
    middle = flat.agg(*(F.avg(c) for c in names)).first()
    got = pair_sums(flat.select(*((F.col(c) - F.lit(m)).alias(c) for c, m in zip(names, middle, strict=True))), names) / n
    error = float(np.abs(got - np.eye(len(names)))[np.ix_(live, live)].max(initial=0.0))
    shares = F.array(*(F.lit(float(v / trace) if trace > 0 else 0.0) for v in values))
    each = wide.select("vec_id", "deviation", F.posexplode("w").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("_k")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
