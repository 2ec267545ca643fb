"""SimHash near-dedup over vantage-point trees.

A fingerprint sums the XXH64 hashes (seed 42) of four-word shingles bit by bit. Fingerprints link at ``radius`` or
fewer differing bits, and documents of one component are near-duplicates.

Search. On all 64 bits a vantage point prunes little: distances of unrelated fingerprints gather at 32. So the 64 bits
are cut into three bands; two fingerprints within four bits are within one bit on some band (pigeonhole), and the
Hamming distance on a band is a metric as well. Each band has its own vantage-point tree. A tree's inner nodes split by
the distance to a vantage point; its leaves are the shards. Every fingerprint has one home shard per band, and visits
those further shards that the triangle inequality cannot exclude. Within a shard the pairs are exact: all 64 bits.
Trees are fitted on a bounded sample (``SAMPLE``); every fingerprint is indexed, and recall is 1 by construction.

A tree of one band is ``MAX_DEPTH`` deep at most. Beyond that a shard is cut further by the tree of a second band: of two
fingerprints within four bits that are near on one band, one of the other two bands is within two bits, so either second
tree, with radius two, finds its share of the links. Shards so stay about ``SHARD_GOAL`` large as fingerprints grow.

A shard that outgrows ``SHARD_CAP`` rows nevertheless is dealt out in blocks of homes and blocks of visitors. Shards give
spanning stars, never all pairs of a group. Links are between fingerprints; documents only name the components.

Defined cases: null and empty texts have fingerprint zero, linked like any other; repeated rows are answered row by
row; a null doc_id links like any other, and is a component's name only if the component has no other; an empty table
gives an empty result; only doc_id and text are read. ``drop_near_copies`` keeps one row of each component, that of its
name (of rows that share it, the one with the least hash of its text), whatever its columns are called.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

SHINGLE_WORDS = 4
RADIUS = 4
#: Fingerprints that trees are fitted on, at most.
SAMPLE = 20_000
#: Homes (or visitors) of a shard that one task compares, at most.
SHARD_CAP = 16_384
#: Homes that a shard should have, and the depth of one tree at most.
SHARD_GOAL, MAX_DEPTH = 2_048, 14


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> bytes:
    """The big-endian fingerprint of a UTF-8 text. ASCII lower case and ASCII white space only, as ``bytes`` has them."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    ends = list(itertools.accumulate(map(len, tokens), lambda a, b: a + 1 + b))
    if len(tokens) <= words:
        hashes = xxhash.xxh64_digest(joined, 42)
        n = 1
    else:
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)])
        n = len(tokens) - words + 1
    ones = np.zeros(64, np.int64)
    grid = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        ones += np.unpackbits(grid[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = b"".join([fingerprint(t.as_py()) for t in batch.column("text")])
        values = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(values)], names=[*kept, "fp"])


def fingerprints(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, .., fp): the fingerprint as a signed long, behind the columns ``carry``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, common.text_bytes().alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_fingerprints, f"{kept}, fp long")


def bands(radius: int) -> list[tuple[int, int]]:
    """(mask, radius on the mask) such that fingerprints within ``radius`` are near on one mask at least."""
    parts = radius // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(((1 << b) - 1) ^ ((1 << a) - 1), radius // parts) for a, b in itertools.pairwise(cuts)]


class VantageTree:
    """A complete binary tree in heap order; node i splits at distance ``cut[i]`` from ``point[i]``."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, depth: int):
        self.mask, self.radius, self.depth = np.uint64(mask), radius, depth
        inner = (1 << depth) - 1
        self.point, self.cut = np.zeros(inner, np.uint64), np.full(inner, 64, np.int16)
        self._fit(sample & self.mask, 0, np.random.default_rng(7))

    def _fit(self, own: np.ndarray, node: int, rng: np.random.Generator) -> None:
        if node >= len(self.point) or len(own) < 4:
            return
        best = None
        for point in own[rng.integers(0, len(own), 12)]:
            d = np.bitwise_count(own ^ point).astype(np.int16)
            for cut in {int(np.median(d)), int(np.median(d)) - 1}:
                left = float(np.mean(d <= cut))
                near = float(np.mean((d > cut - self.radius) & (d <= cut + self.radius)))
                if 0 < left < 1 and (best is None or abs(left - 0.5) + near < best[0]):
                    best = (abs(left - 0.5) + near, point, cut, d)
        if best is None:
            return
        _, self.point[node], self.cut[node], d = best
        self._fit(own[d <= self.cut[node]], 2 * node + 1, rng)
        self._fit(own[d > self.cut[node]], 2 * node + 2, rng)

    def route(self, prints: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, is home) of every visit; ``home`` tells which of ``prints`` come as homes (all by default).

        A link between two sides of a split is found from the near side: homes on the near side visit the far side if
        the triangle inequality allows it, and visitors then follow every branch that it allows.
        """
        row, node = np.arange(len(prints)), np.zeros(len(prints), np.int64)
        home = np.ones(len(prints), bool) if home is None else home
        own, r = prints & self.mask, self.radius
        for _ in range(self.depth):
            d, cut = np.bitwise_count(own[row] ^ self.point[node]).astype(np.int16), self.cut[node]
            left = np.where(home, d <= cut, d - r <= cut)
            right = np.where(home, d > cut, d + r > cut)
            cross = home & left & (d + r > cut)
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2, 2 * node[cross] + 2])
            row = np.concatenate([row[left], row[right], row[cross]])
            home = np.concatenate([home[left], home[right], np.zeros(int(cross.sum()), bool)])
        return row, node - len(self.point), home


def _stars(target: np.ndarray, query: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning stars over the links between ``target`` and ``query``, as positions in their concatenation."""
    both = np.concatenate([target, query])
    linked = np.zeros(len(both), bool)
    for at in range(0, len(both), 512):
        near = np.bitwise_count(both[at : at + 512, None] ^ target[None, :]) <= radius
        span = np.arange(at, min(at + 512, len(target)))
        near[span - at, span] = False
        linked[at : at + 512] |= near.any(axis=1)
        linked[: len(target)] |= near.any(axis=0)
    out, rest = [], np.flatnonzero(linked)
    while len(rest):
        root, frontier, rest = int(rest[0]), rest[:1], rest[1:]
        while len(frontier) and len(rest):
            found = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), 256):
                found |= (np.bitwise_count(both[frontier[at : at + 256], None] ^ both[rest][None, :]) <= radius).any(axis=0)
            frontier, rest = rest[found], rest[~found]
            out.extend((root, int(x)) for x in frontier)
    return out


def _in_shard(shard: pa.Table, radius: int) -> pa.Table:
    stored, role = shard.column("fp").to_numpy(), shard.column("role").to_numpy()
    place = np.concatenate([np.flatnonzero(role != 0), np.flatnonzero(role == 0)])
    prints, n = stored.view(np.uint64)[place], int((role != 0).sum())
    pairs = np.array(_stars(prints[:n], prints[n:], radius), np.int64).reshape(-1, 2)
    return pa.table({"u": stored[place[pairs[:, 0]]], "v": stored[place[pairs[:, 1]]]})


class Forest:
    """The trees of all bands, and for many fingerprints the second trees below them."""

    def __init__(self, sample: np.ndarray, n: int, radius: int):
        levels = max(0, math.ceil(math.log2(max(n, 1) / SHARD_GOAL)))
        self.depth, self.below = min(levels, MAX_DEPTH), min(max(0, levels - MAX_DEPTH), MAX_DEPTH)
        known = bands(radius)
        self.first = [VantageTree(sample, mask, r, self.depth) for mask, r in known]
        # Off a band with r differing bits or fewer, the rest has the radius at most, and the lesser part half of that.
        least = radius // (len(known) - 1) if len(known) > 1 else radius
        self.second = [VantageTree(sample, mask, least, self.below) for mask, _ in known] if self.below and len(known) > 1 else []

    def route(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, shard, is home) of every visit, tree by tree; shards of different trees have different numbers."""
        for i, tree in enumerate(self.first):
            row, shard, home = tree.route(prints)
            shard = (i << self.depth) + shard
            if not self.second:
                yield row, shard, home
            for j, other in enumerate(self.second):
                if j != i:
                    again, leaf, own = other.route(prints[row], home)
                    yield row[again], (shard[again] * len(self.second) + j << self.below) + leaf, own


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp), enough to connect all that link."""
    spark = prints.sparkSession
    n = prints.count()
    sample = [r.fp for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    forest = Forest(np.array(sample, np.int64).view(np.uint64), n, radius)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096).to_numpy()
                for row, shard, home in forest.route(fp.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(home.astype(np.int8)), pa.array(fp[row])], names=["shard", "role", "fp"])

    routed = common.materialize(prints.select("fp").mapInArrow(visits, "shard long, role tinyint, fp long"), "vp-visits")
    sizes = routed.groupBy("shard").agg(F.count_if(F.col("role") == 1).alias("homes"), F.count("*").alias("rows"))
    large = common.materialize(sizes.where(F.col("rows") > 2 * SHARD_CAP).select("shard", F.greatest(F.ceil(F.col("homes") / SHARD_CAP), F.lit(1)).alias("a"), F.ceil(F.col("rows") / SHARD_CAP).alias("b")), "vp-large")
    dealt = routed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if not large.isEmpty():
        # A shard is rarely large, but their number grows with the input: merged, not broadcast.
        hot = routed.join(large.hint("merge"), "shard")
        own = F.pmod(F.xxhash64("fp"), F.col("a")), F.pmod(F.xxhash64("fp"), F.col("b"))
        as_target = hot.where("role = 1").withColumn("i", own[0]).withColumn("j", F.explode(F.expr("sequence(0L, b - 1)")))
        as_query = hot.withColumn("role", F.lit(0).cast("tinyint")).withColumn("j", own[1]).withColumn("i", F.explode(F.expr("sequence(0L, a - 1)")))
        columns = ["shard", "role", "fp", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")]
        dealt = dealt.join(large.hint("merge"), "shard", "left_anti").select(*columns).union(as_target.select(*columns)).union(as_query.select(*columns))
    return dealt.groupBy("shard", "i", "j").applyInArrow(lambda t: _in_shard(t, radius), "u long, v long")


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of (doc_id, fp)."""
    distinct = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-least")
    found = common.connected_components(links(distinct, radius))
    joined = distinct.join(found.withColumnRenamed("id", "fp").hint("merge"), "fp", "left")
    joined = common.materialize(joined.select("fp", "least", F.coalesce("component", "fp").alias("component")), "fp-joined")
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(names.hint("merge"), "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    prints = common.materialize(fingerprints(docs), "fingerprints")
    named = common.materialize(components(prints, radius), "fp-components")
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_key() -> list[Column]:
    """Columns that tell rows of different doc_id or text apart, without nulls."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))]


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component; all columns are carried."""
    key = [common.free_name(f"_key{k}", docs.columns) for k in range(3)]
    rows = docs.select("doc_id", "text", *(c.alias(k) for c, k in zip(_row_key(), key, strict=True)))
    prints = common.materialize(fingerprints(rows, key), "fingerprints")
    distinct = common.materialize(prints.groupBy("fp").agg(F.min(F.struct(*key)).alias("least")), "fp-least")
    found = common.connected_components(links(distinct, radius))
    joined = distinct.join(found.withColumnRenamed("id", "fp").hint("merge"), "fp", "left")
    chosen = joined.groupBy(F.coalesce("component", "fp")).agg(F.min("least").alias("least")).select("least.*")
    keyed = docs.withColumns(dict(zip(key, _row_key(), strict=True)))
    kept = keyed.join(chosen.hint("merge"), key, "left_semi").dropDuplicates(key)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
