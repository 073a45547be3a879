"""Packing of documents into sequences of tokens: bin completion with best-fit solutions as incumbents.

Method. Documents become token ids, ended by END; longer ones are cut into pieces of
``capacity`` tokens, of which the first may be shorter. All that matters for packing is how
many pieces there are of each length, a table of at most ``capacity`` counts. A branch-and-bound
search runs on that table: best-fit decreasing gives the first incumbent; each step takes the
largest length left and enumerates the fillings of the room beside it that no other length
dominates (none fits in addition, or in the place of one or two of its members), by waste
and number. A filling is used for as many sequences as the counts allow at once, so the depth does not
grow with the table. A branch is cut when its waste exceeds what an incumbent less one sequence may
waste. The search ends when a solution meets the lower bound, or after STEPS steps for each of
FREE (how much waste the order of fillings forgives); the incumbent stands then, which is valid at any time.

The result is a list of runs: so many pieces of one length, from this rank among their equals
on, go to these sequences at this place. Pieces are ranked without gathering equals: each task
counts its own, and the counts of the tasks before are added. So neither a common length nor a
long document meets in one task, and what reaches the driver are ``capacity`` counts.

Tokens. With byte-level BPE, tokens end wherever white space follows ink and where ASCII letters, digits
and marks meet (not after an apostrophe, nor where a special token stands), so a slice of texts is cut there, each distinct segment is encoded once by the tokenizer (a bounded cache keeps
segments between slices), and the ids are gathered back by numpy. A text is worked off whole.

Defined cases. A null or empty text has END alone. Null and repeated doc_id: each row's pieces
are its own. The tokenizer's special tokens count as such inside a text. Equal lengths: any of them may stand
for another, so sequence numbers may differ between runs, but not their number. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.llm.textkernel import SPACE, slices, small_batches
from genomeloom.sources.shared import staged, table

CAPACITY = 1024
#: Id after each document.
END = 2
#: Steps of each search, and fillings tried at each step.
STEPS, WIDTH = 1500, 24
#: A branch is closed by best fit after each so many fillings.
CLOSE = 100
#: A search for each: waste of a filling that counts as none when fillings are ordered.
FREE = (8, 16, 4)
#: Bytes of texts that are cut at once, distinct segments that a worker keeps, and segments encoded at once.
CUT_BYTES, KEPT, TOGETHER = 8 << 20, 1 << 20, 4096
#: A segment without white space, but perhaps a space before it.
PLAIN = r"^ ?[^\p{Z}\x00-\x20\x7F\x{85}]+$"
#: Kinds of ASCII characters between which tokens always end; an apostrophe may belong to the letters after it.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
APOSTROPHE = 39
PIECES = "doc_id long, piece int, start long, length long, ids binary, nth long"


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library; one a worker."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.break_id = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, number of ids of each in this order, the ids): of segments. Plain ones are encoded together, line by line: a line break between them is a token of its own."""
        texts = segments.cast(pa.string())
        plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False) & (len(self.break_id) == 1)
        order = np.argsort(~plain, kind="stable")
        lines, single = texts.filter(pa.array(plain)).to_pylist(), texts.filter(pa.array(~plain)).to_pylist()
        found = self.tokenizer.encode_batch_fast(["\n".join(lines[k : k + TOGETHER]) for k in range(0, len(lines), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids + self.break_id, np.uint32) for x in found)])
        breaks = np.flatnonzero(ids == self.break_id[0]) if len(lines) else np.zeros(0, np.int64)
        size = np.diff(breaks, prepend=-1) - 1
        ids = np.delete(ids, breaks)
        alone = [x.ids for x in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)]
        return order, np.append(size, np.array([len(x) for x in alone], np.int64)), np.concatenate([ids, *(np.array(x, np.uint32) for x in alone)])

    def _places(self, names: pa.Array) -> np.ndarray:
        """Where each of ``names`` is kept; new ones are encoded first."""
        place = pc.index_in(names, value_set=self.known)
        if place.null_count and len(self.known) + place.null_count > KEPT:
            self.forget()
            place = pc.index_in(names, value_set=self.known)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        where = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        if new.any():
            fresh = names.filter(pa.array(new))
            order, size, ids = self._encoded(fresh)
            slot = np.empty(len(order), np.int64)
            slot[order] = np.arange(len(order))
            where[new] = len(self.known) + slot
            self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
            self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(order))])
        return where

    def __call__(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of a slice, one after the other; number of ids of each row)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(rows) - 1, np.int64)
        start = np.flatnonzero(self._cuts(data, rows))
        bounds = np.append(start, len(data)).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        where = self._places(segments.dictionary)[segments.indices.to_numpy()]
        size = self.size[where]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[where] - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(start, rows)])

    def _cuts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether a segment begins at each byte: at rows, white space after ink, and where letters, digits and marks of ASCII meet."""
        back = lambda k: np.concatenate([np.zeros(min(k, len(data)), np.uint8), data[:-k]])
        one = back(1)
        # a character of two or three bytes that may be white space itself is not cut after
        cuts = SPACE[data] & (one > 32) & (back(2) != 0xC2) & ((back(3) < 0xE1) | (back(3) > 0xE3))
        if not any(mark in (raw := data.tobytes()) for mark in self.special):
            before, here = KIND[one], KIND[data]
            cuts |= (before > 0) & (here > 0) & (before != here) & (one != APOSTROPHE)
        cuts[rows[:-1][rows[:-1] < len(data)]] = True
        return cuts


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of rows of so many tokens."""
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = sizes - capacity * (n - 1)
    start = np.where(piece > 0, first[row] + capacity * (piece - 1), 0)
    return row, piece, start, np.where(piece > 0, capacity, first[row])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every row of (doc_id, text): ids are little-endian unsigned 32-bit numbers, nth counts the pieces of equal length of a task.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = Encoder.of(tokenizer), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, data, rows in slices(pc.fill_null(batch.column(1), ""), CUT_BYTES):
                ids, size = encode(data, rows)
                ends = np.cumsum(size)
                whole = np.insert(ids, ends, END).astype("<u4")
                row, piece, start, length = cut(size + 1, capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                offsets = np.append(0, np.cumsum(length) * 4).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary, pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: (lengths with their numbers, sequences filled so); sequences of equal content move together."""
    open_: dict[int, Counter[Pattern]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            fits = room // size
            for pattern in list(open_[room]):
                for many, each in ((min(left // fits, open_[room][pattern]), fits), (1, left % fits if left < fits else 0)):
                    if not many or not each or not open_[room][pattern] or not left:
                        continue
                    open_[room][pattern] -= many
                    left -= many * each
                    open_.setdefault(room - each * size, Counter())[(*pattern, (size, each))] += many
                if not open_[room][pattern]:
                    del open_[room][pattern]
            if not left:
                break
        fits = capacity // size
        for many, each in ((left // fits, fits), (1, left % fits)):
            if many and each:
                open_.setdefault(capacity - each * size, Counter())[((size, each),)] += many
    return [(pattern, n) for found in open_.values() for pattern, n in found.items() if n]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by total length, and by what cannot stand beside lengths above half of the room."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for small in [0, *(s for s in counts if 2 * s <= capacity)]:
        alone = sum(n for s, n in counts.items() if s > capacity - small)
        large = [(s, n) for s, n in counts.items() if capacity - small >= s > capacity / 2]
        rest = sum(s * n for s, n in counts.items() if small <= s <= capacity / 2)
        room = sum((capacity - s) * n for s, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(left: dict[int, int], room: int, free: int = 0, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated choices of lengths that fit into ``room``, at most ``width``: by waste beyond ``free``, then few and large ones first, for small ones close later gaps."""
    usable = sorted(s for s, n in left.items() if n and s <= room)
    found: list[tuple[tuple[int, int, int, list[int]], tuple[int, ...]]] = []
    tried = 0

    def spare(size: int, chosen: tuple[int, ...]) -> bool:
        return left.get(size, 0) > chosen.count(size)

    def fits(low: int, high: int, chosen: tuple[int, ...]) -> bool:
        """Whether a length in (low, high] is to be had beside ``chosen``."""
        for k in range(bisect_right(usable, low), bisect_right(usable, high)):
            if spare(usable[k], chosen):
                return True
        return False

    def grow(chosen: tuple[int, ...], slack: int) -> None:
        nonlocal tried
        for k in range(bisect_right(usable, min(slack, chosen[-1] if chosen else slack)) - 1, -1, -1):
            size = usable[k]
            # one length in the place of two as long leaves more to choose from later
            if not spare(size, chosen) or any(spare(other + size, chosen) for other in set(chosen)):
                continue
            if tried >= 4 * width:
                return
            tried += 1
            grow((*chosen, size), slack - size)
        key = (max(0, slack - free), len(chosen), slack, [-size for size in chosen])
        if len(found) < width or key < found[-1][0]:
            subsets = {0, *chosen, *(x + y for i, x in enumerate(chosen) for y in chosen[i + 1 :])}
            if not any(fits(t, t + slack, chosen) for t in subsets):
                insort(found, (key, chosen))
                del found[width:]

    grow((), room)
    return [chosen for _, chosen in found] or [()]


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Fillings and how often each is used, as few sequences as the search finds in ``steps`` for each of FREE; see the module's text."""
    counts = {s: n for s, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    used = lambda plan: sum(n for _, n in plan)
    bound, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    for free in FREE:
        path: list[tuple[Pattern, int]] = []
        # each frame: (counts left, waste so far, fillings not tried yet)
        stack: list[tuple[dict[int, int], int, Iterator[tuple[int, ...]]]] = []
        rest, spent = counts, 0
        for _ in range(steps):
            if used(incumbent) <= bound:
                return incumbent
            if rest:  # a frame for what is left beside the largest length
                largest = max(rest)
                stack.append((rest, spent, iter(fillings({**rest, largest: rest[largest] - 1}, capacity - largest, free))))
            while stack and (chosen := next(stack[-1][2], None)) is None:
                stack.pop()
            if not stack:
                break
            left, waste, _ = stack[-1]
            del path[len(stack) - 1 :]
            largest = max(left)
            need = Counter(chosen) + Counter([largest])
            many = min(left[s] // n for s, n in need.items())
            spent = waste + many * (capacity - largest - sum(chosen))
            rest = {}
            if spent <= (used(incumbent) - 1) * capacity - total:
                path.append((tuple(sorted(need.items(), reverse=True)), many))
                rest = {s: n - many * need.get(s, 0) for s, n in left.items() if n > many * need.get(s, 0)}
                if not rest or len(path) % CLOSE == 0:  # the branch's own best-fit end may be an incumbent
                    closing = best_fit(rest, capacity)
                    if used(path) + used(closing) < used(incumbent):
                        incumbent = [*path, *closing]
    return incumbent


def runs(plan: list[tuple[Pattern, int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, place of the first), by length and rank; bounded by ``capacity`` and STEPS."""
    taken: Counter[int] = Counter()
    out, sequence = [], 0
    for pattern, many in plan:
        at = 0
        for size, each in pattern:
            out.append((size, taken[size], sequence, each, at))
            taken[size] += many * each
            at += size * each
        sequence += many
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def place(held: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``held`` (staged pieces with nth and the number of their task in ``task``) with sequence_id and offset instead."""
    by_task = held.groupBy("task", "length").agg(F.count("*").alias("n"))
    by_task = staged(by_task, "packing")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_ = runs(complete(counts, capacity), capacity)
    key = (table_[:, 0] << 44) + table_[:, 1]
    before = by_task.select(F.col("task").alias("_task"), F.col("length").alias("_length"), (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("_before"))
    ranked = held.join(before, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).withColumn("nth", F.col("nth") + F.col("_before")).drop("task", "_task", "_length", "_before")
    names = [c for c in ranked.columns if c != "nth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            run = table_[np.searchsorted(key, (length << 44) + nth, "right") - 1]
            rank = nth - run[:, 1]
            sequence, place_ = run[:, 2] + rank // run[:, 3], run[:, 4] + rank % run[:, 3] * length
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(place_)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long") if len(table_) else ranked.drop("nth").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of every document."""
    return place(staged(pieces(docs, tokenizer, capacity).withColumn("task", F.spark_partition_id()), "packing"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, each of at most ``capacity`` tokens as little-endian unsigned 32-bit ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    # what the query returns of the ids is their checksum, so only that is written
    found = found.withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumn("task", F.spark_partition_id())
    return place(staged(found, "packing")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
