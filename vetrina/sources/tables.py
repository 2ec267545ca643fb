"""Relational tables as sources and sinks, for catalogues that live in a database."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.sources.shared import one_jvm
from vetrina.sources.store import Store


def read_jdbc(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table or query over JDBC; ``partition`` is (numeric column, lower, upper, parts) for parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if partition:
        column, lower, upper, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None, mode: str = "append") -> None:
    if url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://") and not one_jvm(df.sparkSession):
        raise ValueError("an embedded database is one JVM's own: executors would write to others of the same name; use a server, or upsert_stored")
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).mode(mode).save()


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: Sequence[str], options: Mapping[str, str] | None = None, keep_old: Sequence[str] = (), prefer_old: Sequence[str] = ()) -> None:
    """Update and insert rows by ``keys``, all or none.

    Executors write a staging table beside the target; then the database itself merges it, in one transaction, so a
    writer that stops at any time leaves the target as it was. ``keep_old``: a null does not overwrite. ``prefer_old``: a
    filled old value stays. ``df`` has one row per key.
    """
    options = dict(options or {})
    staging = f"staging_{uuid.uuid4().hex[:12]}"
    write_jdbc(df, url, staging, options)
    jvm = df.sparkSession._jvm
    settings = jvm.java.util.Properties()
    for name, value in options.items():
        if name in ("user", "password"):
            settings.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    quoted = {c: f'"{c}"' for c in df.columns}
    value = {c: f"s.{q}" for c, q in quoted.items()}
    value |= {c: f"COALESCE(s.{quoted[c]}, t.{quoted[c]})" for c in keep_old} | {c: f"COALESCE(t.{quoted[c]}, s.{quoted[c]})" for c in prefer_old}
    updates = ", ".join(f"{quoted[c]} = {value[c]}" for c in df.columns if c not in keys)
    merge = (
        f"MERGE INTO {table} t USING {staging} s ON {' AND '.join(f't.{quoted[k]} = s.{quoted[k]}' for k in keys)}"
        + (f" WHEN MATCHED THEN UPDATE SET {updates}" if updates else "")
        + f" WHEN NOT MATCHED THEN INSERT ({', '.join(quoted.values())}) VALUES ({', '.join(f's.{q}' for q in quoted.values())})"
    )
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            statement.executeUpdate(merge)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            statement.executeUpdate(f"DROP TABLE {staging}")
            connection.commit()
    finally:
        connection.close()


def upsert_stored(df: DataFrame, store: Store, table: str, keys: Sequence[str], keep_old: Sequence[str] = (), prefer_old: Sequence[str] = ()) -> None:
    """``upsert_jdbc`` into a table of a store, which driver and executors share: one full join, published in one step.

    Columns that ``df`` lacks stay as they are; a column that the table lacks is an error. Keys that are null equal none.
    """
    change = store.begin()
    old = change.read(table)
    if old is None:
        change.replace(table, df)
        change.publish()
        return
    if beyond := [c for c in df.columns if c not in old.columns]:
        raise ValueError(f"{table} has no {', '.join(beyond)}")
    o, n = old.select(F.struct(*old.columns).alias("_old"), *(F.col(k).alias(f"_old_{k}") for k in keys)), df.select(F.struct(*df.columns).alias("_new"), *(F.col(k).alias(f"_new_{k}") for k in keys))
    both = o.join(n, [F.col(f"_old_{k}") == F.col(f"_new_{k}") for k in keys], "full")

    def merged(name: str, kind: str):
        was = F.col("_old")[name]
        if name not in df.columns:
            return was.alias(name)
        now = F.col("_new")[name].cast(kind)
        found = F.coalesce(now, was) if name in keep_old else F.coalesce(was, now) if name in prefer_old else now
        return F.when(F.col("_new").isNull(), was).when(F.col("_old").isNull(), now).otherwise(found).alias(name)

    change.replace(table, both.select(*(merged(name, kind) for name, kind in old.dtypes)))
    change.publish()


def write_partitioned(df: DataFrame, path: str, by: str, files: int) -> None:
    """Parquet clustered by a column: readers that filter on it skip files by their statistics."""
    df.repartitionByRange(files, by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)
