"""Request state: the sliding log of accepted requests, caches with a lifetime, histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS, LINK_DAYS = 8, 60, 7


def accepted_requests(requests: DataFrame, key: str, at: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, received, accepted): a request passes if fewer than ``limit`` passed in the ``seconds`` before it.

    Refused requests do not count, so this is a fold over each key's times and not a window count. A task reads its keys'
    times in order and holds the log of one key, ``limit`` times at most, however many requests there are; once the log
    is full, the next one to pass is found by a search. Requests without a time are left out.
    """
    span = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: pa.Array | None = None
        log: list[int] = []
        received = accepted = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([own, pa.array([received], pa.int64()), pa.array([accepted], pa.int64())], names=[key, "received", "accepted"])

        for batch in batches:
            runs = pc.run_end_encode(batch.column(key))
            times = batch.column("_t").to_numpy()
            begin = 0
            for i, end in enumerate(runs.run_ends.to_pylist()):
                name = runs.values.slice(i, 1)
                if own is None or not own.equals(name):
                    if own is not None:
                        yield done()
                    own, log, received, accepted = name, [], 0, 0
                part, k = times[begin:end], 0
                received += len(part)
                while k < len(part):
                    log = [x for x in log if part[k] - x < span]
                    if len(log) < limit:
                        log.append(int(part[k]))
                        accepted += 1
                        k += 1
                    else:
                        k += int(np.searchsorted(part[k:], log[0] + span)) if log else len(part)
                begin = end
        if own is not None:
            yield done()

    rows = requests.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).where("_t is not null")
    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "_t").mapInArrow(fold, f"`{key}` {kind}, received long, accepted long")


def fresh_links(cache: DataFrame, now: Column, days: int = LINK_DAYS) -> DataFrame:
    """Cached links that have not outlived their days."""
    return cache.where(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def put_links(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new links in place of older ones of the same key."""
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def last_entries(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n entries of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Feedback and audit tables only grow."""
    return table.unionByName(rows, allowMissingColumns=True)


def cart_totals(items: DataFrame) -> DataFrame:
    """Sum of shown prices by currency."""
    shown = F.when((F.col("sale_price") > 0) & (F.col("sale_price") < F.col("price")), F.col("sale_price")).otherwise(F.col("price"))
    return items.groupBy("currency").agg(F.sum(shown.cast("decimal(12,2)")).alias("total"), F.count("*").alias("items"))
