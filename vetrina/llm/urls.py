"""URL filters: domain rules first, then gradient-boosted trees on lexical features, JVM-side throughout.

Features of a url: its length, the depth of its path, shares of digits and of hyphens, the entropy of its characters,
its number of parameters, host labels, and two statistics of its host's last label over the labelled urls (their
number, and the smoothed share of blocked ones). Trees are fitted on a bounded sample of labelled urls, ``TRAIN_ROWS``
of each label at most, the first by a hash of the url, weighted so that each label counts as often as in all labelled
urls. Every url is judged. Urls of one residue (``HELD_OUT`` of ``FOLDS``, by CRC-32) are never fitted on: what the trees say of
them tells how they do on urls that they have not seen.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model
on its own characters (a null url as an empty one); an empty path fits no rule, as every rule's path starts with a
slash; of the rules that fit the longest wins, of equals the last by name; without two labels in the labelled urls the
model allows everything, or blocks everything if all are blocked; repeated rows are judged row by row; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

#: (verdict, host, path) of the contract's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words in a host that mark a url as blocked in the labelled urls made by ``weak_labels``.
BLOCK_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]
TRAIN_ROWS = 10_000
TREES, DEPTH = 10, 3
FOLDS, HELD_OUT = 3, 1
FEATURES = ["f_length", "f_depth", "f_digits", "f_hyphens", "f_entropy", "f_params", "f_labels", "f_suffix_n", "f_suffix_blocked"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, or null. Rules are a short list, part of the plan."""
    found = []
    for verdict, own, start in rules:
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(len(own + start)).alias("n"), F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def _share(text: Column, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))) / F.greatest(F.length(text), F.lit(1))


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path, ..) with the lexical features and the host's last label."""
    url = F.translate(F.coalesce("url", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # Signs are counted once: sorted, a run of equal ones ends where the next differs, and its length is the distance.
    signs = F.array_sort(F.split("_url", ""))
    n = F.length("_url")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.get("_signs", i - 1).eqNullSafe(F.get("_signs", i)))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct(i.alias("last"), (s["sum"] + (i - s["last"]) * F.log2((i - s["last"]).cast("double"))).alias("sum"))
    entropy = F.when(n > 0, F.log2(n.cast("double")) - F.aggregate(ends, start, step, lambda s: s["sum"]) / n).otherwise(0.0)
    return rows.withColumn("_url", url).withColumn("_signs", signs).withColumns(
        {
            "f_length": F.length("_url").cast("double"),
            "f_depth": F.regexp_count("path", F.lit("/+[^/]")).cast("double"),
            "f_digits": _share(F.col("_url"), string.digits),
            "f_hyphens": _share(F.col("_url"), "-"),
            "f_entropy": F.round(entropy, 6),
            "f_params": F.regexp_count("_url", F.lit("[?&][^=&#]+=")).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    ).drop("_signs")


def is_held_out(url: Column) -> Column:
    return F.crc32(F.coalesce(url, F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, f_suffix_n, f_suffix_blocked) over labelled rows; ``label`` is 1 for blocked."""
    n, blocked = F.count("*"), F.sum("label")
    return labelled.groupBy("suffix").agg(F.log2(n + 1.0).alias("f_suffix_n"), ((blocked + 1.0) / (n + 2.0)).alias("f_suffix_blocked"))


class UrlModel:
    """Trees, or the one label there was, and the suffix statistics, which are written and joined, broadcast only below
    Spark's own bound of size."""

    def __init__(self, labelled: DataFrame):
        labelled = common.materialize(with_features(labelled), "urls-labelled")
        self.suffixes = common.materialize(suffix_statistics(labelled), "url-suffixes")
        counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        self.only = None if len(counts) == 2 else float(next(iter(counts), 0))
        self.model: PipelineModel | None = None
        if self.only is None:
            rows = self._joined(labelled)
            picks = [rows.where(F.col("label") == y).orderBy(F.xxhash64("url"), *FEATURES).limit(TRAIN_ROWS).withColumn("_weight", F.lit(counts[y] / min(counts[y], TRAIN_ROWS))) for y in (0, 1)]
            sample = common.materialize(picks[0].union(picks[1]).select("label", "_weight", *FEATURES), "urls-sample")
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=5, featuresCol="_features", labelCol="label", weightCol="_weight", predictionCol="_blocked")
            self.model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"), trees]).fit(sample)

    def _joined(self, rows: DataFrame) -> DataFrame:
        filled = rows.join(self.suffixes, "suffix", "left")
        return filled.fillna({"f_suffix_n": 0.0, "f_suffix_blocked": 0.5})

    def judge(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_blocked``, 1.0 or 0.0."""
        if self.model is None:
            return rows.withColumn("_blocked", F.lit(self.only))
        return self.model.transform(self._joined(with_features(rows)))


def weak_labels(pages: DataFrame, words: list[str] = BLOCK_WORDS) -> DataFrame:
    """(url, label): 1 where a label of the host is, or joins by hyphens, one of ``words``."""
    host, _ = host_and_path(F.col("url"))
    own = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words)))
    return pages.where("url is not null").select("url", own.cast("int").alias("label"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, held_out (urls that nothing was fitted on).

    ``labelled`` has urls with a label, 1 for blocked; where it is not given, ``weak_labels`` of the pages are used.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = weak_labels(pages)
    labelled = labelled.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"))
    found = UrlModel(labelled.where(~is_held_out(F.col("url")))).judge(rows)
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_blocked") == 1, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), is_held_out(F.col("url")).alias("held_out"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
