"""Best-fit packing of token sequences by fitted length patterns.

Only the histogram of piece lengths, which has ``CAPACITY`` cells at most whatever the input, reaches the driver.
There, patterns of a few documents are enumerated on a coarse grid, their repeat counts are fitted to the histogram by
non-negative least squares (active set) and rounded down, and the patterns are filled with exact lengths: the last place
of each takes the best fit. What is left is packed by best fit, longest first. The plan is a list of rank ranges by
length, so each piece finds its sequence and offset from its rank among the pieces of its length. Ranks are counted
within salted parts of a length, of which the histogram gives each length as many as it needs, so that a common length
does not meet in one task. A piece that fills a sequence needs no rank and takes no part in any shuffle.

Defined cases: a null or empty text is one piece of one token (the end id); repeated rows are packed as often as they
occur; only documents longer than a sequence are cut, and only their last piece may be shorter; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm import bpe, common

CAPACITY, END_ID = 4096, 1
#: Cells of the coarse grid, and documents of an enumerated pattern at most.
GRID, PLACES = 64, 4
#: Pieces of one length that are ranked together, about.
RANKED = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    path = vocabulary or bpe.default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for part in bpe.portions(batch.column("text").to_pylist()):
                rows: list[tuple] = []
                tokens: list[np.ndarray] = []
                for doc_id, own in zip(doc_ids[at : at + len(part)], tokenizer.encode_many(part), strict=True):
                    ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(piece), zlib.crc32(piece)))
                        tokens.append(piece)
                at += len(part)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(tokens).astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _PIECE + ", ids array<int>" * with_ids)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-10:
            break
        free[int(slope.argmax())] = True
        while free.any():
            own = np.flatnonzero(free)
            best = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if best.min() > 0:
                x[:] = 0
                x[own] = best
                break
            down = own[best <= 0]
            step = (x[down] / np.maximum(x[down] - best[best <= 0], 1e-300)).min()
            x[own] += step * (best - x[own])
            free &= x > 1e-12
            x[~free] = 0
    return x


def patterns(grid: int = GRID, places: int = PLACES) -> list[tuple[int, ...]]:
    """Multisets of grid cells, largest first, that about fill a sequence; a cell is half full on average."""
    out: list[tuple[int, ...]] = []
    for k in range(1, places + 1):
        for total in {grid + k // 2, grid + (k - 1) // 2}:
            for head in itertools.combinations_with_replacement(range(grid, 0, -1), k - 1):
                last = total - sum(head)
                if 1 <= last <= (head[-1] if head else grid):
                    out.append((*head, last))
    return out


class Plan:
    """Where the pieces of each length go: ranges of ranks by length, each with its first sequence and its offset."""

    def __init__(self, histogram: np.ndarray, capacity: int = CAPACITY):
        self.capacity, self.left = capacity, histogram.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.sequences = 0
        self.ranges: list[tuple[int, int, int, int]] = []
        cell = -(-capacity // GRID)
        self._by_patterns(cell)
        for length in range(capacity, 0, -1):
            while self.left[length]:
                self._fill([length], int(self.left[length]))
        ranges = np.array(sorted(self.ranges), np.int64).reshape(-1, 4)
        self.length, self.first, self.base, self.offset = ranges.T

    def _largest(self, low: int, high: int, taken: list[int]) -> int:
        """The largest length in [low, high] of which a piece is left beside those taken; 0 if none."""
        for length in low + np.flatnonzero(self.left[low : high + 1])[::-1] if high >= low else ():
            if self.left[length] > taken.count(length):
                return int(length)
        return 0

    def _fill(self, taken: list[int], repeats: int) -> int:
        """Complete ``taken`` by best fit and use it as often as it can be, ``repeats`` times at most."""
        gap = self.capacity - sum(taken)
        while gap and (length := self._largest(1, gap, taken)):
            taken.append(length)
            gap -= length
        times = min([repeats, *(int(self.left[x]) // taken.count(x) for x in set(taken))])
        at = 0
        for length in taken:
            self.ranges.append((length, int(self.used[length]), self.sequences, at))
            self.used[length] += times
            self.left[length] -= times
            at += length
        self.sequences += times
        return times

    def _by_patterns(self, cell: int) -> None:
        lengths = np.arange(1, self.capacity + 1)
        cells = np.bincount((lengths - 1) // cell, weights=self.left[1:], minlength=GRID)[:GRID]
        if not cells.any():
            return
        known = patterns()
        a = np.zeros((GRID, len(known)))
        for j, p in enumerate(known):
            for c in p:
                a[c - 1, j] += 1
        fitted = np.floor(nnls(a, cells / cells.sum()) * cells.sum() + 1e-9).astype(np.int64)
        for j in sorted(np.flatnonzero(fitted), key=lambda j: (-known[j][0], j)):
            repeats = int(fitted[j])
            while repeats:
                taken: list[int] = []
                for c in known[j][: max(1, len(known[j]) - 1)]:
                    room = self.capacity - sum(taken)
                    taken.append(self._largest((c - 1) * cell + 1, min(c * cell, room), taken))
                if 0 in taken:
                    break
                repeats -= self._fill(taken, repeats)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks."""
        key = (self.length << 44) + self.first
        at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
        return self.base[at] + rank - self.first[at], self.offset[at]


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (materialised pieces, with a number of each row as ``_row``) with sequence_id and offset."""
    names = [c for c in cut.columns if c != "_row"]
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # a row for each length up to the capacity
        histogram[r["length"]] = r["count"]
    full = int(histogram[capacity])
    histogram[capacity] = 0
    plan = Plan(histogram, capacity)
    # One number per length up to the capacity, as part of the plan.
    parts = F.array(*(F.lit(int(n)) for n in 1 + histogram // RANKED))
    salted = cut.where(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.get(parts, F.col("length").cast("int"))).cast("int"))
    part = Window.partitionBy("length", "_salt").orderBy("_row")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "_salt").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.withColumn("_rank", F.row_number().over(part) - F.lit(1)).join(counts, ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    placed = ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
    if not full:
        return placed
    whole = cut.where(F.col("length") == capacity)
    return placed.union(whole.select(*names, (F.col("_row") + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    cut = pieces(docs, vocabulary, CAPACITY, with_ids).withColumn("_row", F.monotonically_increasing_id())
    return place(common.materialize(cut, "pieces"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
