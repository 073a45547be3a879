"""Vectorised splitting and hashing of the words in an Arrow string column.

Everything works on the UTF-8 bytes of a bounded slice of rows, so that no Python
object is made for a word. A word is a maximal run of bytes other than space and
\\x09-\\x0D; UTF-8 never uses those bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Fixed odd multipliers of the hashes below.
BASE, MIX1, MIX2, GOLD = U(0x9E3779B97F4A7C55), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch, so that a batch of documents stays a few MB.
BATCH_ROWS = 500
_POWERS: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to BATCH_ROWS: documents are wide rows, and every copy of a batch counts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES) + 1
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of runs of rows of about ``limit`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the total) of the words of a slice."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    ink = ~SPACE[data]
    starts = ink.copy()
    starts[1:] &= ~ink[:-1]
    edge = rows[:-1][rows[:-1] < len(data)]
    starts[edge] = ink[edge]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    edge = rows[1:][rows[1:] > 0] - 1
    ends[edge] = ink[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, rows)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end); equal bytes give equal hashes wherever they stand.

    Spans must be in order of their start. Worked off in runs of about SLICE_BYTES
    of data, so that the tables of powers stay bounded for very long texts.
    """
    out, at = np.empty(len(start), U), 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + SLICE_BYTES, "right")))
        top = int(end[at:to].max())
        up, down = _powers(top - base)
        sums = np.zeros(top - base + 1, U)
        np.cumsum((data[base:top].astype(U) + U(1)) * up[: top - base], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * GOLD)
        at = to
    return out


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row and the total)."""
    start, end, first = words(data, rows)
    return span_hashes(data, start, end), first


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions whose n words leave the row are the caller's to skip."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for k in range(n):
        out = (out ^ hashes[k : k + m]) * MIX1 + U(int(GOLD) * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        out ^= out >> U(29)
    return mix(out)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class BitTable:
    """Names that are surely absent, or else perhaps present; two bits a name, of a fixed number."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def places(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return names >> U(64 - bits), (names * MIX2) >> U(64 - bits)

    @classmethod
    def of(cls, names: DataFrame, bits: int) -> BitTable:
        """Of a table of one column of names; partial tables are joined by bitwise or."""

        def partial(batches):
            for batch in batches:
                own = batch.column(0).to_numpy().view(np.uint64)
                at = np.concatenate(cls.places(own, bits))
                word, back = np.unique(at >> U(6), return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, back, U(1) << (at & U(63)))
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        found = names.mapInArrow(partial, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        return cls(bits, words)

    def __call__(self, names: np.ndarray) -> np.ndarray:
        a, b = self.places(names, self.bits)
        has = lambda x: (self.words[(x >> U(6)).astype(np.int64)] >> (x & U(63)) & U(1)).astype(bool)
        return has(a) & has(b)
