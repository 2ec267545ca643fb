"""Quality rules: word counts and repetition, then a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed four-byte grams are counted over whole texts: the trusted target (documents
labelled quality 1) and the raw corpus (all documents). A document's ratio is the mean, over its grams, of
log p(target) - log p(raw). The threshold lies ``MARGIN`` below the mean ratio of the target's own grams. Documents that
the base rules fail are not judged further.

Counts cover every document; what reaches the driver is one number per bucket and multinomial. The trusted documents are
found by a merge join, before which a bitmap of hashed trusted ids, of ``BITS`` bits at any size, drops most of the
others: it never drops a trusted one.

Defined cases: a null or empty text has no words and fails the base rules; a text without grams has ratio 0; with no
target rows both multinomials are the raw one, so every ratio is 0; a document with several labels is trusted if any of
them is quality 1; repeated rows are judged (and counted) row by row; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

BUCKETS, GRAM_BYTES = 1 << 16, 4
SMOOTHING = 1.0
#: How far below the target's own mean a document's ratio may be.
MARGIN = 0.25
MIN_WORDS, REPEAT_WORDS, MAX_REPEAT_PERCENT = 10, 5, 20
#: Bits of the map of trusted ids: 8 MB, whatever the number of labels.
BITS = 1 << 26
#: Bytes of trusted texts that one task counts, about, so that counts are added up before they are dealt.
COUNTED = 32 << 20
#: Bytes that are taken together, few enough that their arrays stay in cache.
CHUNK = 256 << 10
_SYMBOLS = b"#*$%&|<>"


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every four-byte gram, grams by text), text after text."""
    body = b"".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    n = max(0, len(body) - GRAM_BYTES + 1)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    word = np.ndarray((n,), "<u4", body, strides=(1,))
    bucket = ((word * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    inside = np.ones(n, bool)
    for back in range(1, GRAM_BYTES):
        at = np.cumsum(size)[:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    return bucket[inside], np.maximum(size - GRAM_BYTES + 1, 0)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over the ``text`` bytes of ``rows``; every task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _chunks(batch.column("text").to_pylist()):
                total += np.bincount(grams(part)[0], minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _by_bucket(counts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for r in counts.collect():  # one row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, both smoothed."""
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    p, q = target + SMOOTHING, raw + SMOOTHING
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def mean_ratios(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """The length-normalised log-likelihood ratio of every text."""
    out = []
    for part in _chunks(texts):
        bucket, n = grams(part)
        total = np.concatenate([[0.0], np.cumsum(ratio[bucket], dtype=np.float64)])
        ends = np.cumsum(n)
        out.append((total[ends] - total[ends - n]) / np.maximum(n, 1))
    return np.concatenate(out) if out else np.zeros(0)


def repeated_words(words: list[bytes], ids: dict[bytes, int]) -> int:
    """Words that lie in a window of ``REPEAT_WORDS`` words that occurs twice or more in ``words``."""
    n = len(words) - REPEAT_WORDS + 1
    if n < 2:
        return 0
    known = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    # Exact keys: pairs are ranked, then pairs of pairs, then the fifth word is added.
    two = np.unique(known[:-1] << np.uint64(32) | known[1:], return_inverse=True)[1].astype(np.uint64)
    if int(two.max()) == len(two) - 1:
        return 0
    four = np.unique(two[:-2] << np.uint64(32) | two[2:], return_inverse=True)[1].astype(np.uint64)
    if int(four.max()) == len(four) - 1:
        return 0
    _, at, often = np.unique(four[:n] << np.uint64(32) | known[REPEAT_WORDS - 1 :], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(often[at] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    step[hit] += 1
    step[hit + REPEAT_WORDS] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    words = text.split()
    body = b"".join(words)
    chars = len(body) if body.isascii() else len(body.decode("utf-8", "replace"))
    symbols = len(body) - len(body.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words, {})


def _maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose doc_id is not in ``ids``; all others stay."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS))
    part = F.bitmap_bucket_number(place).alias("_part")
    maps = ids.select(part, F.bitmap_bit_position(place).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # A map has 4 KB, and there are BITS / 32,768 of them at most.
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_part"))
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    # Alike at every size: the labels grow with the corpus, so they are merged, never broadcast.
    # An inner join with distinct ids: a semi join would be pushed below the map.
    return _maybe_in(rows, trusted).join(trusted.hint("merge"), "doc_id")


def threshold(target: np.ndarray, ratio: np.ndarray) -> float:
    """``MARGIN`` below the mean ratio of the target's grams, which is the divergence of the two multinomials."""
    return float((target * ratio).sum() / max(1.0, target.sum())) - MARGIN


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, ratio, kept."""
    raw = _by_bucket(gram_counts(docs.select(common.text_bytes().alias("text"))))
    share = labels.where("quality = 1").count() / max(1, docs.count())
    parts = 1 + int(min(1.0, share) * raw.sum() / COUNTED)
    target = _by_bucket(gram_counts(_trusted(docs, labels).coalesce(parts)))
    ratio = log_ratio(target, raw)
    least = threshold(target, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            columns = [pa.array(counts[:, k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(mean_ratios(texts, ratio))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= least))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
