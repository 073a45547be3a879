"""Removal of repeated passages: every byte covered by a SPAN-byte string that starts anywhere else too.

Method. A suffix order is merged from shards by iterative refinement of intervals, on
sampled suffixes. In each shard (a slice of a task's rows) every SPAN-byte window is
filed under the smallest hash of the K-byte contexts in it, its anchor; equal windows
have equal anchors at equal offsets, so only some one in eighty of all suffixes stands
for all windows. The shards' intervals are then interleaved and refined in rounds of
growing context, and an interval of one suffix drops out:

1. K bytes at the anchor: suffixes alone in their interval start no repeat.
2. The anchor's whole segment, the bytes under all the windows filed with it: where two
   segments are equal, every window of them repeats, and the common prefix is known to
   pass SPAN without looking at single windows.
3. Where an interval holds unequal segments, contexts growing by STEP bytes to the left
   and to the right of the anchor bound how far it agrees with any other on either side.
4. SPAN bytes at each window that those bounds leave.

The merge is a shuffle by interval name; no task orders all suffixes or holds an
interval, and a frequent passage is one class after round 2. Between rounds, what is
still open goes back to the shards as a bit table of fixed size (a name outside it is
surely closed; a false hit only costs a row), so that texts are read again in place and
not shuffled. Contexts are named by 64-bit hashes, which stand for their bytes.

Defined cases. Null is empty, as are texts shorter than SPAN bytes: nothing to remove.
Strings are judged on the input, not on what is left, and never cross documents;
overlapping occurrences in one document count. Repeated rows are two places, so both
lose what they share. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.llm import textkernel as tk
from genomeloom.sources.shared import staged, table

SPAN, K, STEP = 200, 32, 28
OPEN_BITS, NEAR_BITS = 24, 26
PLACE_BITS = 24
PIECE = 1 << 22


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima of blocks from both sides meet."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Contexts:
    """Hashes of any byte span of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = tk._powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + tk.U(1)) * up[: len(data)], out=self.sums[1:])

    def names(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        wide = np.asarray(size).astype(np.uint64)
        return tk.mix((self.sums[start + size] - self.sums[start]) * self.down[start] + wide * tk.GOLD)


def segments(ctx: Contexts, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, anchor's context, segment's context); places are offsets in ``data``."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    name = ctx.names(np.arange(len(data) - K + 1), K)
    keep = tk.U((1 << 64) - (1 << PLACE_BITS))
    least = _sliding_min((name & keep) | np.arange(len(name), dtype=np.uint64), SPAN - K + 1)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:n]
    at = np.flatnonzero(np.arange(n) + SPAN <= rows[row + 1])
    anchor = (least[at] & ~keep).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(anchor) != 0)]) if len(at) else np.zeros(0, bool))
    first, last, anchor = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at, anchor[new]
    whole = ctx.names(first, last - first + SPAN) ^ tk.mix((anchor - first).astype(np.uint64))
    return row[first], first, last, anchor, name[anchor], whole


def _pieces(column: pa.Array):
    """Slices of rows; a longer text alone, in pieces that overlap by less than a window: (rows, bytes, row offsets, bytes before)."""
    for lo, hi, data, rows in tk.slices(column, 1 << 20):
        if len(data) <= PIECE:
            yield range(lo, hi), data, rows, 0
        else:
            for at in range(0, len(data) - SPAN + 1, PIECE):
                part = data[at : at + PIECE + SPAN - 1]
                yield range(lo, hi), part, np.array([0, len(part)]), at


def _segment_rows(docs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for own, data, bounds, before in _pieces(batch.column(1)):
                row, first, last, _, near, whole = segments(Contexts(data), data, bounds)
                base = before - bounds[row]
                yield pa.record_batch(
                    [pa.array(uid[own.start + row]), pa.array((first + base).astype(np.int32)), pa.array((last + base).astype(np.int32)), pa.array(near.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["uid", "first", "last", "near", "whole"],
                )

    return docs.mapInArrow(rows, "uid long, first int, last int, near long, whole long")


def _open_segments(batches, still_open: tk.BitTable):
    """(uid, offset base, contexts, bytes, row bounds, first, last, anchor) of open segments by slice; equal ones once a task."""
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        uid = batch.column(0).to_numpy()
        for own, data, bounds, before in _pieces(batch.column(1)):
            ctx = Contexts(data)
            row, first, last, anchor, near, whole = segments(ctx, data, bounds)
            at = np.flatnonzero(still_open(near))
            at = at[np.unique(whole[at], return_index=True)[1]]
            at = at[~np.isin(whole[at], seen)]
            if len(seen) < 1 << 20:
                seen = np.concatenate([seen, whole[at]])
            if len(at):
                yield uid[own.start + row[at]], before - bounds[row[at]], ctx, bounds[row[at]], bounds[row[at] + 1], first[at], last[at], anchor[at]


def _levels(ctx: Contexts, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray):
    """(side, level, segments, names): contexts that reach level * STEP bytes beyond the anchor's K on one side, where the text does."""
    for level in range(1, (SPAN - K) // STEP + 1):
        left = np.flatnonzero(anchor - level * STEP >= lo)
        yield 0, level, left, ctx.names(anchor[left] - level * STEP, K + level * STEP)
        right = np.flatnonzero(anchor + K + level * STEP <= hi)
        yield 1, level, right, ctx.names(anchor[right], K + level * STEP)


def _context_rows(docs: DataFrame, still_open: tk.BitTable) -> DataFrame:
    def rows(batches):
        for _, _, ctx, lo, hi, _, _, anchor in _open_segments(batches, still_open):
            names = np.concatenate([names for *_, names in _levels(ctx, lo, hi, anchor)])
            yield pa.record_batch([pa.array(names.view(np.int64))], names=["name"])

    return docs.mapInArrow(rows, "name long")


def _window_rows(docs: DataFrame, still_open: tk.BitTable, twice: tk.BitTable) -> DataFrame:
    """(uid, s, name): contexts of SPAN bytes at each window of the open segments that can repeat."""

    def rows(batches):
        for uid, base, ctx, lo, hi, first, last, anchor in _open_segments(batches, still_open):
            agreed = np.zeros((2, len(anchor)), np.int64)
            alive = np.ones((2, len(anchor)), bool)
            for side, level, some, names in _levels(ctx, lo, hi, anchor):
                reached = np.zeros(len(anchor), bool)
                reached[some] = twice(names)
                alive[side] &= reached
                agreed[side][alive[side]] = level
            # a window d bytes before the anchor needs d bytes on its left and SPAN - K - d on its right
            far = (agreed + 1) * STEP - 1
            a = np.maximum(first, anchor - far[0])
            b = np.minimum(last, anchor - (SPAN - K) + far[1])
            n = np.maximum(0, b - a + 1)
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.record_batch([pa.array(np.repeat(uid, n)), pa.array((at + np.repeat(base, n)).astype(np.int32)), pa.array(ctx.names(at, SPAN).view(np.int64))], names=["uid", "s", "name"])

    return docs.mapInArrow(rows, "uid long, s int, name long")


def _covered(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching [start, end) ranges."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > reach[:-1])
    return np.stack([ranges[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(ranges)) - 1]], axis=1)


def _cut(docs: DataFrame) -> DataFrame:
    """Of documents (doc_id, data, starts, spans): starts of repeated windows, and repeated ranges as start * 2^32 + end."""

    def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(kind)

    def rows(batches):
        for batch in batches:
            sizes, gone, runs, left = [], [], [], []
            (at_s, starts), (at_p, spans) = (flat(batch.column(k), np.int64) for k in (2, 3))
            for i, doc in enumerate(batch.column(1)):
                data = memoryview(doc.as_buffer() if doc.is_valid else b"")
                single, wide = starts[at_s[i] : at_s[i + 1]], spans[at_p[i] : at_p[i + 1]]
                ranges = np.concatenate([np.stack([single, single + SPAN], axis=1), np.stack([wide >> 32, wide & 0xFFFFFFFF], axis=1)])
                ranges = _covered(ranges)
                digest, at = hashlib.sha256(), 0
                for s, e in ranges.tolist():
                    digest.update(data[at:s])
                    at = e
                digest.update(data[at:])
                sizes.append(len(data))
                gone.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
                runs.append(len(ranges))
                left.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(left, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _uid() -> Column:
    return F.xxhash64("doc_id", "text")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(uid, s, e): byte ranges [s, e) of the texts that repeat, those of single windows without e; uid names a (doc_id, text)."""
    keyed = docs.select(_uid().alias("uid"), "text")
    by_near, by_whole = W.partitionBy("near"), W.partitionBy("near", "whole")
    filed = _segment_rows(keyed).withColumn("n1", F.count("*").over(by_near)).where("n1 > 1").withColumn("n2", F.count("*").over(by_whole))
    filed = staged(filed.select("uid", "first", "last", "near", "n1", "n2"), "segments")
    equal = filed.where("n2 > 1").select("uid", F.col("first").alias("s"), (F.col("last") + SPAN).alias("e"))
    still_open = tk.BitTable.of(filed.where("n2 = 1").select("near"), OPEN_BITS)
    contexts = _context_rows(keyed, still_open).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    twice = tk.BitTable.of(contexts, NEAR_BITS)
    windows = _window_rows(keyed, still_open, twice)
    again = windows.withColumn("n", F.count("*").over(W.partitionBy("name"))).where("n > 1")
    return equal.unionByName(again.select("uid", "s", F.lit(None).cast("int").alias("e")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    tk.small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # sets, for equal rows share a uid: a text's places are held once, however often it stands there
    starts = F.collect_set(F.when(F.col("e").isNull(), F.col("s"))).alias("starts")
    spans = F.collect_set(F.when(F.col("e").isNotNull(), F.shiftleft(F.col("s").cast("long"), 32) + F.col("e"))).alias("spans")
    found = staged(repeated_ranges(plain).groupBy("uid").agg(starts, spans), "ranges")
    keyed = plain.select("doc_id", F.encode("text", "utf-8").alias("data"), _uid().alias("uid"))
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    return _cut(keyed.join(found, "uid", "left").select("doc_id", "data", none("starts", "int"), none("spans", "long")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
