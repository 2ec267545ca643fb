"""Feeds as a stream: files of a landing folder are imported batch by batch, and requests are limited as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from vetrina.operators import enrich
from vetrina.operators.state import LIMIT, WINDOW_SECONDS
from vetrina.operators.sync import sync


def stream_feeds(spark: SparkSession, landing: str, schema: StructType, root: str, checkpoint: str, model: enrich.Model = enrich.stub, budget: int = 0, clock: Callable[[], datetime] = datetime.now) -> StreamingQuery:
    """Import the feeds that lie in ``landing``, a file at a time, into the catalogue at ``root``, and stop.

    Each file is a whole feed and is imported as ``sync`` does it: classified, enriched, guarded and logged. The
    checkpoint remembers which files are done; a file that is imported again after a failure changes nothing but times.
    """
    rows = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxFilesPerTrigger", 1).csv(landing)

    def run(batch: DataFrame, _: int) -> None:
        sync(spark, batch.withColumn("feed_pos", F.monotonically_increasing_id()), root, clock(), model, budget)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limiter(limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The sliding log of one key: times of accepted requests, at most ``limit``, survive between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(batches)).sort_values("t")
        out = []
        for t in frame["t"].tolist():
            log = [x for x in log if t - x < seconds * 1_000_000]
            passes = len(log) < limit
            if passes:
                log.append(t)
            out.append((key[0], t, passes))
        state.update((log,))
        yield pd.DataFrame(out, columns=["key", "t", "accepted"])

    return run


def limit_requests(requests: DataFrame, key: str, at: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """A stream of requests with ``accepted``; micros in ``t``."""
    rows = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(limiter(limit, seconds), "key string, t long, accepted boolean", "log array<bigint>", "append", GroupStateTimeout.NoTimeout)
