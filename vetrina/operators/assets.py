"""Image assets: one row per picture, links to offers, resolution of colours, similarity of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.functions import text as t
from vetrina.operators.snapshot import upsert

MAX_BYTES, CONFIDENT = 12 << 20, 80


def with_image(rows: DataFrame, limit: int = 0) -> DataFrame:
    """Rows with a filled image link, by id; ``limit`` 0 takes all."""
    out = rows.where(F.col("image_link").isNotNull() & (F.trim("image_link") != ""))
    return out.orderBy("id").limit(limit) if limit else out


def mime_type(content: Column) -> Column:
    """JPEG or PNG by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head == "89504E470D0A1A0A", "image/png")


def local_images(spark: SparkSession, path: str) -> DataFrame:
    """Usable pictures of a folder: path, content, sha256, mime."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length").between(1, MAX_BYTES))
    return rows.select("path", "content", F.sha2("content", 256).alias("image_sha256"), mime_type(F.col("content")).alias("mime")).where("mime is not null")


def fetched(rows: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """(id, content, error) by a pluggable fetcher; each failure stays with its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, link in zip(batch["id"], batch["image_link"], strict=True):
                try:
                    content = fetch(link)
                    out.append((key, content, None) if len(content) <= MAX_BYTES else (key, None, "too large"))
                except Exception as error:
                    out.append((key, None, str(error)[:300]))
            yield pd.DataFrame(out, columns=["id", "content", "error"])

    return rows.select(F.col("id").cast("long").alias("id"), "image_link").mapInPandas(run, "id long, content binary, error string")


def upsert_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assets by picture: what is known stays, only the link and the time are new."""
    stay = [c for c in old.columns if c not in ("image_sha256", "image_link", "updated_at")]
    return upsert(old, new, ["image_sha256"], prefer_old=stay)


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """What is not there yet, for an append."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def resolved_color(feed: Column, seen: Column, confidence: Column, decision: Column, gate: bool = True) -> Column:
    """struct(color, source): the feed's colour, the picture's where the feed has none or a review says so.

    ``gate`` asks for a confident picture; the preview form does without and names open conflicts.
    """
    own, other = t.visual_colors(feed), t.visual_colors(seen)
    sure = F.coalesce(confidence, F.lit(0)) >= CONFIDENT if gate else F.lit(True)
    both = F.array_join(F.array_sort(F.array_union(own, other)), ", ")
    pick = lambda c, s: F.struct(c.alias("color"), F.lit(s).alias("source"))
    has_feed = F.coalesce(F.trim(feed), F.lit("")) != ""
    out = (
        F.when(~has_feed & sure & (F.size(other) > 0), pick(F.array_join(other, ", "), "visione"))
        .when((decision == "usa_visione") & sure & (F.size(other) > 0), pick(F.array_join(other, ", "), "revisione"))
        .when(decision == "mantieni_entrambi", pick(both, "revisione"))
        .when(decision == "non_conclusivo", pick(feed, "non_conclusivo"))
    )
    if not gate:
        out = out.when(decision.isNull() & t.color_conflict(own, other), pick(feed, "conflitto_da_revisionare"))
    return out.otherwise(pick(feed, "feed"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def most_similar(assets: DataFrame, vector: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k assets nearest to one vector."""
    score = F.round(cosine(F.col(column), F.array(*map(F.lit, map(float, vector)))), 6)
    return assets.select(key, score.alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(k)
