"""Exact dedup: a persistent digest index, bucketed and sorted by hash, probed by sort-merge anti-join.

Texts are equal when they agree after deleting ASCII white space. Of equal texts the longest stays, then the one with the
smallest doc_id, whatever batch brought it: each batch is reduced to its best row of each digest, and what the index does
not have as good already is appended. So an index may have several entries of a digest, of which the best counts, and
the order of batches does not matter. ``dedup`` and ``drop_copies`` bring a table to one index in ``BATCHES`` batches.

Defined cases: null text counts as empty (empty texts are copies of each other); a null doc_id sorts before any other;
rows that repeat a doc_id are judged row by row in ``decide`` and kept once, one of the longest, in ``keep_best``; an
empty table gives an empty result; extra columns are carried by ``keep_best`` whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common


def text_digest(column: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text without ASCII white space."""
    return F.sha2(F.translate(F.coalesce(F.col(column), F.lit("")), common.ASCII_SPACE, ""), 256)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, digest) of each row."""
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), text_digest().alias("digest"))


def _rank(chars: str, doc_id: str) -> Column:
    """What is least for the row that stays; nulls come first."""
    return F.struct(-F.col(chars), F.col(doc_id))


class DigestIndex:
    """Digests seen so far: digest, chars and keep_id of a row that was the best of its digest when it came.

    The table lives at ``path`` and is registered under ``name``; opening an existing path continues it, with the number
    of buckets it was made with, which is part of its path and so of no session.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int | None = None):
        self.spark, self.root = spark, path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        known = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        made = [int(n.removeprefix("buckets-")) for n in known if n.startswith("buckets-")]
        self.buckets = made[0] if made else buckets or common.shuffle_partitions(spark)
        self.path = f"{path}/buckets-{self.buckets}"
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, chars BIGINT, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def close(self) -> None:
        """Take the name out of the catalogue; the files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def entries(self) -> DataFrame:
        """The index as plain files: a join may then deal both sides itself and split a hot digest."""
        return self.spark.read.schema("digest STRING, chars BIGINT, keep_id BIGINT").parquet(self.path)

    def best(self) -> DataFrame:
        """The entry of each digest that counts."""
        found = self.entries().groupBy("digest").agg(F.min(_rank("chars", "keep_id")).alias("_best"))
        return found.select("digest", (-F.col("_best.col1")).alias("chars"), F.col("_best.keep_id").alias("keep_id"))

    def append(self, docs: DataFrame) -> None:
        self.append_keyed(keyed(docs))

    def append_keyed(self, rows: DataFrame) -> None:
        """Add the best row of each digest of ``rows`` (doc_id, chars, digest), unless the index has one as good.

        Copies are reduced before the shuffle, and the index's own buckets are read as they lie. A batch that is repeated
        adds nothing.
        """
        own = rows.groupBy("digest").agg(F.min(_rank("chars", "doc_id")).alias("_best"))
        own = own.select("digest", (-F.col("_best.col1")).alias("chars"), F.col("_best.doc_id").cast("long").alias("keep_id")).alias("b")
        there = self.spark.table(self.name).hint("merge").alias("i")
        as_good = (F.col("i.chars") > F.col("b.chars")) | (F.col("i.chars") == F.col("b.chars")) & (F.col("i.keep_id").isNull() | F.coalesce(F.col("i.keep_id") <= F.col("b.keep_id"), F.lit(False)))
        fresh = own.join(there, (F.col("i.digest") == F.col("b.digest")) & as_good, "left_anti")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)

    def decide(self, docs: DataFrame) -> DataFrame:
        return self.decide_keyed(keyed(docs))

    def decide_keyed(self, rows: DataFrame) -> DataFrame:
        """One row per row of batches already appended: doc_id, keep_id, group_size (rows of its digest among ``rows``),
        kept, text_sha256."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        # Written, so that both sides of the join are plain exchanges, of which a hot one can be split.
        known = common.materialize(sizes.join(self.best().hint("merge"), "digest").select("digest", "keep_id", "group_size"), "digests-best")
        found = rows.join(known.hint("merge"), "digest")
        return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))

    def keep_best(self, docs: DataFrame) -> DataFrame:
        """The rows of appended batches that stay, with all their columns."""
        key, chars, keep = (common.free_name(c, docs.columns) for c in ("_digest", "_chars", "_keep_id"))
        known = common.materialize(self.best().toDF(key, chars, keep), "digests-best")
        found = docs.withColumn(key, text_digest()).join(known.hint("merge"), key)
        kept = found.where(F.col("doc_id").eqNullSafe(F.col(keep)) & (F.length(F.coalesce("text", F.lit(""))) == F.col(chars)))
        # Rows are sorted by their key here; what is left to drop are rows that repeat an id with as long a text.
        return kept.dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Batches in which a table is brought to an index.
BATCHES = 4


def _indexed(docs: DataFrame) -> tuple[DigestIndex, DataFrame]:
    """An index to which ``docs`` came in batches, and their keys."""
    spark = docs.sparkSession
    rows = common.materialize(keyed(docs), "digests-keyed")
    index = DigestIndex(spark, common.new_path(spark, "digests"))
    for n in range(BATCHES):
        index.append_keyed(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == n))
    index.close()
    return index, rows


def dedup(docs: DataFrame) -> DataFrame:
    """Decisions for ``docs`` against a new index."""
    index, rows = _indexed(docs)
    return index.decide_keyed(rows)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies, by a new index."""
    index, _ = _indexed(docs)
    return index.keep_best(docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept,
       h AS text_sha256
FROM keyed
"""
