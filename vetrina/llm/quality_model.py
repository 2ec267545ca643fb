"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. A passage is encoded by hashed trigrams of character classes (letters
by case, digits, white space, bytes beyond ASCII, and every ASCII sign by itself), as square roots of their shares, and
by two shares of repeated words. One layer maps a passage to ``HIDDEN`` numbers; gated attention, a softmax of w (tanh(V h) * sigmoid(U h)), weights the
passages of a document; the weighted mean is scored by a logistic unit. Only document labels are used.

Lower-case letters are one class, so the encoder sees layout, signs and repetition, not words: it is small, and cannot
learn a text's topic or language by its vocabulary.

The model is fitted on the driver, on a bounded sample of labelled rows: ``TRAIN_ROWS`` documents of each label at most,
the first by a hash of doc_id, as many as have ``TRAIN_PASSAGES`` passages of each label together; a single document
beyond that is not learnt from. All passages of a document in the sample are read, as they are in scoring.

Defined cases: null and empty texts are one empty passage and have a score; a null doc_id is never learnt from and
counts as held out of nothing (held_out false); a document with several labels has the smallest; of rows that repeat a
doc_id the least text is learnt from, and all are scored row by row; without two labels in the training rows every score is the share of label 1 (0.5 if there are
none); an empty table gives an empty result; labels, lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm import common

PASSAGE, BINS, HIDDEN, GATE = 400, 256, 24, 12
#: Inputs of a passage: the trigram bins, the share of words that repeat the one before, and that of words seen before.
INPUTS = BINS + 2
TRAIN_ROWS, TRAIN_PASSAGES = 2_000, 40_000
#: Bytes of text that are encoded at a time.
PORTION = 256 << 10
STEPS, BATCH, RATE = 500, 128, 0.01


def _classes() -> np.ndarray:
    """A class for every byte."""
    table = np.zeros(256, np.uint32)
    table[128:] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[: ord("!")] = 4
    table[ord("\n")] = 5
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[signs] = 6 + np.arange(len(signs))
    return table


_CLASS = _classes()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, passages by text)."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    parts = [t[k * PASSAGE : (k + 1) * PASSAGE] for t, n in zip(texts, counts.tolist(), strict=True) for k in range(n)]
    out = np.zeros((len(parts), INPUTS), np.float32)
    for a in range(0, len(parts), 2048):
        some = parts[a : a + 2048]
        size = np.array([len(p) for p in some])
        c = _CLASS[np.frombuffer(b"".join(some), np.uint8)]
        owner = np.repeat(np.arange(len(some)), size)
        if len(c) < 3:
            continue
        gram = (c[:-2] * np.uint32(64) + c[1:-1]) * np.uint32(64) + c[2:]
        bin_ = (gram * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1)
        whole = owner[2:] == owner[:-2]
        found = np.bincount((owner[:-2] * BINS + bin_)[whole], minlength=len(some) * BINS).reshape(-1, BINS)
        out[a : a + len(some), :BINS] = np.sqrt(found / np.maximum(found.sum(axis=1, keepdims=True), 1))
    out[:, BINS:] = [_repetition(p.split()) for p in parts]
    return out, counts


def portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first position, texts) of some texts at a time: ``PORTION`` bytes, or one longer text."""
    part, size, first = [], 0, 0
    for at, text in enumerate(texts):
        if part and size + len(text) > PORTION:
            yield first, part
            part, size, first = [], 0, at
        part.append(text)
        size += len(text)
    if part:
        yield first, part


def _repetition(words: list[bytes]) -> tuple[float, float]:
    n = max(1, len(words))
    return sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(words)) / n


class AttentionModel:
    """Parameters of the network, and its gradient."""

    def __init__(self, rng: np.random.Generator):
        self.p = {
            "W": rng.normal(0, 1 / 4, (INPUTS, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": np.zeros(GATE),
            "c": np.zeros(HIDDEN),
            "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        first = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(h * a[:, None], first)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30))), (h, t, s, a, z)

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (h, t, s, a, z) = self.forward(x, counts)
        out = (score - y) * weight / weight.sum()
        dz = np.repeat(out[:, None] * p["c"], counts, axis=0)
        pull = (dz * h).sum(axis=1)
        mean = np.add.reduceat(pull * a, np.cumsum(counts) - counts)
        de = a * (pull - np.repeat(mean, counts))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 11) -> AttentionModel:
    """Adam on balanced classes; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    model = AttentionModel(rng)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        model.p["d"][0] = np.log(share / (1 - share))
        return model
    first = np.cumsum(counts) - counts
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, STEPS + 1):
        own = rng.integers(0, len(y), min(BATCH, len(y)))
        rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in own])
        g = model.gradient(x[rows], counts[own], y[own], weight[own])
        for k in model.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    picks = [known.where(F.col("y") == y).orderBy(*first).limit(TRAIN_ROWS) for y in (0, 1)]
    sample = common.materialize(picks[0].union(picks[1]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")), "quality-sample")
    # The sample has 2 * TRAIN_ROWS rows at most, and as many texts are carried on.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = common.materialize(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "y", common.text_bytes().alias("text")), "quality-texts")
    size = F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1))
    # Documents beyond the bound are passed over, the others are taken in their order while they fit.
    fit_in = texts.select("doc_id", "y", size.alias("n")).where(F.col("n") <= TRAIN_PASSAGES)
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(*first))
    taken = fit_in.withColumn("_sum", so_far).where(F.col("_sum") <= TRAIN_PASSAGES).select("doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x, counts = passages(part.column("text").to_pylist())
                cut = np.split(x.astype(np.float16), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([c.tobytes() for c in cut], pa.binary())], names=["doc_id", "y", "x"])

    got = texts.join(F.broadcast(taken), "doc_id", "left_semi").mapInArrow(encode, "doc_id long, y int, x binary").collect()
    got = sorted({(r.doc_id, r.y, bytes(r.x)) for r in got})
    x = [np.frombuffer(r[2], np.float16).reshape(-1, INPUTS).astype(np.float32) for r in got]
    return fit(np.concatenate([*x, np.zeros((0, INPUTS), np.float32)]), np.array([len(p) for p in x], np.int64), np.array([r[1] for r in got], float))


def scored(docs: DataFrame, model: AttentionModel, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` with a last column for the score, keeping ``columns``."""
    text, score_name = common.free_name("_text", columns), common.free_name("_score", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                score = np.zeros(some.num_rows)
                for first, part in portions(some.column(text).to_pylist()):
                    x, counts = passages(part)
                    score[first : first + len(counts)] = model.forward(x, counts)[0]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(score)], names=[*columns, score_name])

    out = docs.select(*[F.col(f"`{c}`") for c in columns], common.text_bytes().alias(text))
    fields = [f for f in docs.schema if f.name in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return out.mapInArrow(run, f"{schema}, {score_name} double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    found = scored(docs, train(docs, labels), ["doc_id"])
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns are carried."""
    kept = scored(docs, train(docs, labels), docs.columns)
    score = kept.columns[-1]
    return kept.where(F.col(score) >= 0.5).drop(score)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
