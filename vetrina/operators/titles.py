"""Titles: refresh of displayed and parent titles, and their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetrina.functions import text as t
from vetrina.operators.identity import cheapest_offer


def refreshed(flat: DataFrame) -> DataFrame:
    """Flat rows with title and search title derived anew from the source title, or the title where there is none.

    Rows without either stay as they are.
    """
    source = F.coalesce(t.filled(F.trim("source_title")), t.filled(F.trim("title")))
    # Behind a generator, so that the search title is made of the title and not of its expression.
    out = flat.withColumn("_source", source)
    out = out.select("*", F.explode(F.array(t.display_title(F.col("_source"), F.col("brand")))).alias("_title"))
    have = F.col("_source").isNotNull()
    made = {"title": F.col("_title"), "clean_title": t.clean_title(F.col("_title")), "source_title": F.col("_source")}
    return out.withColumns({c: F.when(have, x).otherwise(F.col(c)) for c, x in made.items()}).select(*flat.columns)


def with_brand(title: Column, brand: Column, once: bool = False) -> Column:
    """A parent's title: the brand behind it; ``once``: not if the title has it already."""
    both = F.concat_ws(" ", title, t.filled(brand))
    return F.when(F.contains(F.lower(title), F.lower(brand)), title).otherwise(both) if once else both


def parent_titles(products: DataFrame, offers: DataFrame, once: bool = False) -> DataFrame:
    """Parents titled by their cheapest offer; parents without offers keep their title."""
    best = cheapest_offer(offers).select("product_id", F.col("title").alias("_title"), F.col("brand").alias("_brand"))
    joined = products.join(best, products["id"] == best["product_id"], "left").drop(best["product_id"])
    return joined.withColumn("canonical_title", F.coalesce(with_brand(F.col("_title"), F.col("_brand"), once), F.col("canonical_title"))).select(*products.columns)


def review_queue(rows: DataFrame, reviews: DataFrame, limit: int = 0) -> DataFrame:
    """Rows without an accepted review of the same source title, by id; ``limit`` 0 takes all."""
    done = reviews.where("accepted").select("sku", "source_title").distinct()
    todo = rows.join(done, ["sku", "source_title"], "left_anti").orderBy("id")
    return todo.limit(limit) if limit else todo


def parsed_answers(raw: DataFrame, asked: DataFrame) -> DataFrame:
    """Objects of a model's JSON list, the code fence removed; ids that were not asked for are dropped."""
    items = F.from_json(t.without_code_fence(F.col("answer")), "array<struct<id: string, title: string, color: string, material: string, gender: string, age_group: string>>")
    rows = raw.select(F.explode(F.coalesce(items, F.array().cast("array<struct<id: string, title: string, color: string, material: string, gender: string, age_group: string>>"))).alias("x")).select("x.*")
    return rows.join(asked.select("id").distinct(), "id", "left_semi")


def apply_reviews(flat: DataFrame, answers: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(flat rows with accepted titles and completed attributes, audit rows to append)."""
    attributes = ["color", "material", "gender", "age_group"]
    own = answers.select("id", t.without_controls(F.col("title")).alias("_title"), *(F.col(c).alias(f"_{c}") for c in attributes if c in answers.columns))
    joined = flat.join(own, "id", "left")
    issues = t.title_issues(F.col("_title"))
    joined = joined.withColumn("_issues", F.when(F.col("_title").isNotNull(), issues)).withColumn("_ok", F.size("_issues") == 0)
    out = joined.withColumns({c: F.when(F.col("_ok"), F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)) for c in attributes if c in answers.columns})
    out = out.withColumn("title", F.when(F.col("_ok"), F.col("_title")).otherwise(F.col("title")))
    audit = joined.where("_title is not null").select("id", "sku", "source_title", F.col("_title").alias("proposed_title"), F.col("_ok").alias("accepted"), F.col("_issues").alias("issues"), at.alias("reviewed_at"))
    return out.select(*flat.columns), audit
