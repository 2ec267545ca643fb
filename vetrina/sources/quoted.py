"""Quoted CSV of any size, read in splits: records may have line ends within quotes, and still no task reads the whole file.

Whether a line end is one of a record depends on all quotes before it. Each split is therefore read once for what it does
to that: in which state it ends if it begins outside a quoted field, and in which if it begins inside. The driver chains
these answers, two flags a split, and in a second pass each split knows its state and cuts its lines into records. What
is left at its ends is put together: a record that is open at the end of one split is closed early in the next.

A quote opens a field only as its first sign, and a doubled one within stays; whatever stands between a closing quote and
the next comma belongs to the field. Spark's own CSV expression then parses each record.

Defined cases: lines without signs are passed over; a line end may be ``\\n`` or ``\\r\\n``; an open quote that swallows
more than ``LONGEST`` bytes, or a whole split, is an error, as the rest of the file would be one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a record, at most.
LONGEST = 16 << 20
_PYTHON = {"windows-1252": "cp1252"}


class QuoteError(ValueError):
    """A quote that is never closed."""


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or at a field's start, ends inside one."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            at = line.find(b",", at + 1) + 1
            if not at:
                return False
            inside = line[at : at + 1] == b'"'
            at += inside
        if not inside:
            if at == 0 and line[:1] == b'"':
                at = 1
            else:
                at = line.find(b',"', max(at - 1, 0)) + 2
                if at < 2:
                    return False
            inside = True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(block, lines) of a batch, in order."""
    blocks = batch.column("block").to_numpy()
    lines = batch.column("line").to_pylist()
    at = 0
    while at < len(lines):
        end = at + int((blocks[at:] == blocks[at]).argmin() or len(lines) - at)
        yield int(blocks[at]), lines[at:end]
        at = end


def _states(spark: SparkSession, path: str) -> dict[int, bool]:
    """Whether each split, by its first byte, begins inside a quoted field."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bool]] = {}
        for batch in batches:
            for block, lines in _by_block(batch):
                state = found.setdefault(block, [False, True, False])
                for line in lines:
                    if b'"' in line:
                        state[0] = ends_inside(line, state[0])
                        state[1] = ends_inside(line, state[1])
                        state[2] |= not state[1]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array([s[k] for s in found.values()], pa.bool_()) for k in range(3))], names=["block", "after_outside", "after_inside", "closes"])

    # A row a split.
    found = sorted(_lines(spark, path).mapInArrow(scan, "block long, after_outside boolean, after_inside boolean, closes boolean").collect())
    out, inside = {}, False
    for r in found:
        if inside and not r.closes:
            raise QuoteError(f"a quote is open over the whole split at byte {r.block}")
        out[r.block] = inside
        inside = r.after_inside if inside else r.after_outside
    if inside:
        raise QuoteError("the last quote of the file is not closed")
    return out


def records(spark: SparkSession, path: str, encoding: str = "utf-8", split: bool = True) -> DataFrame:
    """(pos, record): the text of each record behind the header, with a number that grows with its place in the file."""
    states = _states(spark, path) if split else {0: False}
    order = {block: n for n, block in enumerate(sorted(states))}
    decode = _PYTHON.get(encoding, encoding)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, n = -1, False, 0
        held: list[bytes] = []
        size = 0

        def out(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
            texts = [t[:-1] if k != 0 and t.endswith(b"\r") else t for _, k, t in rows]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int64()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array([t.decode(decode, "replace") for t in texts], pa.string())], names=["pos", "part", "record"])

        for batch in batches:
            rows: list[tuple[int, int | None, bytes]] = []
            for at, lines in _by_block(batch):
                if at != block:
                    if held:  # the last split's open record
                        rows.append((order[block] << 32 | n, 0, b"\n".join(held)))
                    block, inside, n, held, size = at, states.get(at, False), 0, [], 0
                    lead = inside
                for line in lines:
                    quoted = b'"' in line
                    if not inside and not quoted:
                        if line and line != b"\r":
                            rows.append((order[block] << 32 | n, None, line))
                            n += 1
                        continue
                    held.append(line)
                    size += len(line) + 1
                    if size > LONGEST:
                        raise QuoteError(f"a record is longer than {LONGEST} bytes")
                    if quoted:
                        inside = ends_inside(line, inside)
                    if not inside:
                        whole = b"\n".join(held)
                        if lead:  # it closes a record of the split before
                            rows.append((order[block] << 32, 1, whole))
                        else:
                            rows.append((order[block] << 32 | n, None, whole))
                            n += 1
                        lead, held, size = False, [], 0
            yield out(rows)
        if held:
            yield out([(order[block] << 32 | n, 0, b"\n".join(held))])

    found = _lines(spark, path).mapInArrow(cut, "pos long, part int, record string")
    whole = found.where("part is null").select("pos", "record")
    if any(states.values()):
        # An open record goes by the number of the split that closes it.
        closes = F.when(F.col("part") == 1, F.shiftright("pos", 32)).otherwise(F.shiftright("pos", 32) + 1)
        halves = found.where("part is not null").withColumn("split", closes)
        joined = halves.groupBy("split").agg(F.min("pos").alias("pos"), F.concat_ws("\n", F.max(F.when(F.col("part") == 0, F.col("record"))), F.max(F.when(F.col("part") == 1, F.col("record")))).alias("record"))
        whole = whole.unionByName(joined.select("pos", "record"))
    return whole.where("pos <> 0")
