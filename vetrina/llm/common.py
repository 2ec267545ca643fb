"""Shared plumbing of the training-data operators: tables, shared storage and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words in every contract here.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store it supports will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-JVM session may do without the setting; on a cluster a missing setting is an error,
    because a machine-local folder would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/vetrina/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hooked(edges: DataFrame, label: str) -> DataFrame:
    """Edges (u, v) with ``m``, the least neighbour of ``u`` or ``u`` itself.

    The minima are pre-aggregated and written, so both join sides are plain exchanges and a hub's edges can be split.
    """
    minima = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), label)
    return edges.join(minima.withColumn("m", F.least("m", "u")).hint("merge"), "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Alternates large-star and small-star contraction: each round only rewires edges towards smaller nodes, the number
    of edges never grows, and a hub is handled by a pre-aggregated minimum. Nodes without an edge are not returned.
    Self-loops and repeated edges are ignored; an empty table gives an empty result.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()
    edges = materialize(edges, "cc-edges")
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, "cc-min").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        hooked = _hooked(down, "cc-min")
        small = hooked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "cc-small")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
