"""Hard-negative mining: every anchor's integer scores against all rows, sorted, and read between two limits.

Anchors are a stated share of the rows, so the scores are a table of anchors by rows that is never kept. Rows are packed
into tiles of at most ``TILE_ROWS``, anchors into blocks of ``ANCHORS``; each block meets each tile once by a merge join
on the tile's number, in which only one tile is held at a time. A task sees one pair: it computes the scores of the
block against the tile, sorts each anchor's by score and id, finds a positive's upper limit by binary search and reads
on from there. A first round gives each anchor's best rows of its own label, the second what lies between the limits of
each of these; what leaves a task are the first few of a tile, and a window keeps the first of all tiles. So no task
holds more than a tile, whatever the number of rows, labels or copies, and nothing is gathered by the driver but two
counts.

Scores are exact: products are made in doubles where no sum can reach 2^53, else in whole numbers of any size.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of unequal
length are filled up with zeros; a null id belongs to no anchor, comes after all other ids and is returned as null;
repeated rows count each on their own, so a copy of an anchor is another row, and copies with one id fill as many
places; ties go by id; an anchor without positives, or a positive without negatives, gives no rows; an empty table gives
an empty result; extra columns are not read. A score beyond a long ends the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm import common

#: Rows of a tile, at most and at least (but for the last rows), and anchors of a block.
TILE_ROWS, LEAST_TILE_ROWS, ANCHORS = 1 << 16, 1 << 12, 1 << 10
#: Scores that are in memory at once.
CELLS = 1 << 21
#: An id that stands for null while rows are packed.
_NO_ID = np.iinfo(np.int64).max
_PACKED = "block long, ids binary, labels binary, kind string, width int, matrix binary"


def eligible(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    taken = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~wrong)
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def _whole(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector, filled up with zeros; in the smallest kind that holds it."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))
    most = np.abs(flat).max(initial=0)
    if most >= 2.0**63:
        raise OverflowError("a component is too large for a whole number of 64 bits")
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat.astype(kind)
    return out


def _packed(rows: DataFrame, blocks: int, scale: int) -> DataFrame:
    """Rows dealt out evenly to ``blocks`` records; a record's rows are in the order of their ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [b for b in batches if b.num_rows]:
            found = pa.Table.from_batches(parts).combine_chunks()
            ids = found["vec_id"].fill_null(_NO_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors = found["embedding"].chunk(0)
            matrix = _whole(vectors, scale)[order]
            labels = found["label"].to_numpy()[order]
            record = [[TaskContext.get().partitionId()], [ids[order].tobytes()], [labels.tobytes()], [matrix.dtype.name], [matrix.shape[1]], [np.ascontiguousarray(matrix).tobytes()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(record, kinds, strict=True)], names=["block", "ids", "labels", "kind", "width", "matrix"])

    return rows.repartition(blocks).mapInArrow(pack, _PACKED)


class _Block:
    """A record's rows again."""

    def __init__(self, record: dict, prefix: str = ""):
        of = lambda name: record[prefix + name]
        self.ids, self.labels = np.frombuffer(of("ids"), np.int64), np.frombuffer(of("labels"), np.int64)
        self.matrix = np.frombuffer(of("matrix"), of("kind")).reshape(len(self.ids), of("width"))
        self.most = int(np.abs(self.matrix.astype(np.float64)).max(initial=0)) + 1


def _scores(anchors: _Block, which: np.ndarray, tile: _Block, rows: np.ndarray) -> np.ndarray:
    """Inner products of some anchors with some rows of a tile, as longs."""
    width = min(anchors.matrix.shape[1], tile.matrix.shape[1])
    a, b = anchors.matrix[which, :width], tile.matrix[rows, :width]
    if anchors.most * tile.most * max(width, 1) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64) if width else np.zeros((len(a), len(b)), np.int64)


def _some(which: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """A few anchors at a time, so that their scores against ``n`` rows stay within bounds."""
    step = max(1, CELLS // max(n, 1))
    for at in range(0, len(which), step):
        yield which[at : at + step]


def _first_of_own(anchors: _Block, tile: _Block, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, scores, ids) of the first ``most`` rows of the anchor's own label in a tile."""
    for label in np.unique(anchors.labels):
        rows = np.flatnonzero(tile.labels == label)
        if not len(rows):
            continue
        ids = tile.ids[rows]
        for which in _some(np.flatnonzero(anchors.labels == label), len(rows)):
            for a, s in zip(which, _scores(anchors, which, tile, rows), strict=True):
                at = np.arange(len(s)) if len(s) <= most else np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most])
                at = at[np.lexsort((ids[at], -s[at]))[:most]]
                yield int(a), s[at], ids[at]


def _between(anchors: _Block, positives: dict[int, list[tuple[int, int, int]]], tile: _Block, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, positive, scores, ids) of the first ``most`` rows of another label between a positive's (place, low, high)."""
    with_any = np.array(sorted(positives), np.int64)
    for label in np.unique(anchors.labels[with_any]):
        rows = np.flatnonzero(tile.labels != label)
        if not len(rows):
            continue
        ids = tile.ids[rows]
        for which in _some(with_any[anchors.labels[with_any] == label], len(rows)):
            for a, s in zip(which, _scores(anchors, which, tile, rows), strict=True):
                order = np.lexsort((ids, -s))
                falling = -s[order]  # negated scores rise
                for place, low, high in positives[int(a)]:
                    begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                    at = order[begin : min(end, begin + most)]
                    if len(at):
                        yield int(a), place, s[at], ids[at]


def _positives(found: list[dict], own: _Block, count: int) -> dict[int, list[tuple[int, int]]]:
    """The first ``count`` (score, id) of each anchor without the anchor's own row, which may or may not be among them."""
    by: dict[int, list[tuple[int, int]]] = {}
    for x in found:
        by.setdefault(x["a"], []).append((x["score"], x["id"]))
    for a, pairs in by.items():
        pairs.sort(key=lambda p: (-p[0], p[1]))
        v = own.matrix[a].astype(object)
        itself = (int(v @ v) if len(v) else 0, int(own.ids[a]))
        if itself in pairs:
            pairs.remove(itself)
        by[a] = pairs[:count]
    return by


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (vec_id, label, embedding).

    An anchor's positives are its first other rows of its label by score. Its negatives for one of them are the first
    rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    taken = eligible(rows)
    chosen = taken.where(is_anchor)
    n, n_anchors = taken.agg(F.count("*"), F.count_if(is_anchor)).first()
    size = min(TILE_ROWS, max(LEAST_TILE_ROWS, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))
    n_tiles = max(1, math.ceil(n / size))
    tiles = common.materialize(_packed(taken, n_tiles, scale).withColumnRenamed("block", "tile"), "negatives-tiles")
    blocks = common.materialize(_packed(chosen, max(1, math.ceil(n_anchors / ANCHORS)), scale), "negatives-anchors")

    def pairs(left: DataFrame) -> DataFrame:
        """Each block with each tile; of the join's sides the blocks stream past the one tile of their key."""
        own = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))).alias("tile"))
        return own.join(tiles.hint("merge"), "tile").drop("tile")

    def first_of_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _records(batches):
            found = list(_first_of_own(_Block(r, "a_"), _Block(r), positives + 1))
            counts = [len(s) for _, s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(sum(counts), r["a_block"])),
                    pa.array(np.repeat(np.array([a for a, _, _ in found], np.int32), counts)),
                    pa.array(np.concatenate([*(s for _, s, _ in found), np.zeros(0, np.int64)])),
                    pa.array(np.concatenate([*(i for _, _, i in found), np.zeros(0, np.int64)])),
                ],
                names=["block", "a", "score", "id"],
            )

    best = Window.partitionBy("block", "a").orderBy(F.desc("score"), "id")
    own = pairs(blocks).mapInArrow(first_of_own, "block long, a int, score long, id long").withColumn("_place", F.row_number().over(best))
    listed = own.where(F.col("_place") <= positives + 1).groupBy("block").agg(F.collect_list(F.struct("a", "score", "id")).alias("found"))
    armed = common.materialize(blocks.join(listed.hint("merge"), "block"), "negatives-positives")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _records(batches):
            mine_, tile = _Block(r, "a_"), _Block(r)
            near = _positives(r["a_found"], mine_, positives)
            bounds = {a: [(p, -(-low * s // 100), high * s // 100) for p, (s, _) in enumerate(of)] for a, of in near.items() if of}
            bounds = {a: [(p, lo, hi) for p, lo, hi in of if lo <= hi] for a, of in bounds.items()}
            found = list(_between(mine_, {a: of for a, of in bounds.items() if of}, tile, negatives))
            counts = [len(s) for _, _, s, _ in found]
            each = lambda values, kind=np.int64: pa.array(np.repeat(np.array(values, kind), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(sum(counts), r["a_block"])),
                    each([a for a, _, _, _ in found], np.int32),
                    each([p for _, p, _, _ in found], np.int32),
                    each([mine_.ids[a] for a, _, _, _ in found]),
                    each([near[a][p][1] for a, p, _, _ in found]),
                    each([near[a][p][0] for a, p, _, _ in found]),
                    pa.array(np.concatenate([*(s for _, _, s, _ in found), np.zeros(0, np.int64)])),
                    pa.array(np.concatenate([*(i for _, _, _, i in found), np.zeros(0, np.int64)])),
                ],
                names=["block", "a", "p", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"],
            )

    schema = "block long, a int, p int, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long"
    order = Window.partitionBy("block", "a", "p").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs(armed).mapInArrow(between, schema).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    id_ = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c)
    return ranked.select("anchor_id", id_("positive_id"), "rank", id_("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: The same rows by plain joins.
ORACLE = """WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
