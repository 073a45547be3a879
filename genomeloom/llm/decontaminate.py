"""Benchmark decontamination by latent semantic retrieval.

Method. Benchmark items and corpus passages (windows of WINDOW words every STRIDE)
are TF-IDF vectors over the items' words; document frequencies are counted over all
passages of all documents. A distributed randomised SVD of the matrix of all passages of all
documents and of the items, the passages together as heavy as the items, gives a latent space
of at most RANK dimensions. Every passage is folded into it and compared
by cosine with every item and, for items longer than a passage, with every piece of them
(windows of WINDOW words every STRIDE, as passages are); pairs at MIN_COSINE or more, and
with MIN_COVER of the weight of the item or piece in the passage, are candidates. A candidate is
confirmed on words: the longest common subsequence of the whole item and the passage's
surroundings covers COPY_SHARE of the item, or PARAPHRASE_SHARE of it and
ANSWER_SHARE of its answer, the item's closing words. The surroundings of a piece reach
as far as the item does before and after it, and somewhat further.

Items are the stated query set, taken in blocks of about BLOCK_VECTORS items and pieces; only a
block's index (its words, their latent vectors, its items) goes to the tasks, so that neither the
benchmark nor the corpus ever has to fit in a task. Items are few against documents;
each block reads the corpus again. Words that no item has are left out of the vectors, for they cannot be common.

Words are compared in lower case and without the ASCII marks at their edges, on both sides.

Defined cases. Null or wordless texts on either side match nothing. Words in more than
STOP_SHARE of the passages weigh nothing, unless an item has fewer than LEAST_WORDS
others: its own then keep small equal weights, so that it can still be found. Repeated documents or items
each give their own pairs; equal (doc_id, item_id) pairs become one row with the best
figures. Empty tables give an empty result. Extra columns are ignored by the search
and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.llm import textkernel as tk
from genomeloom.sources.shared import staged, table

WINDOW, STRIDE = 32, 16
RANK, SPARE_RANK, SEED = 64, 32, 20_011
GRAM_SLICES, GRAM_SALTS = 8, 64
STOP_SHARE, LEAST_WORDS = 0.05, 4
MIN_COSINE = 0.45
#: Of the weight of an item or piece, the least share that a passage must hold; half an item over two passages still passes.
MIN_COVER = 0.2
COPY_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.8, 0.5, 0.8
BLOCK_VECTORS = 10_000


@dataclass
class Index:
    """One block of items: their word lists, and the latent space they span."""

    ids: np.ndarray
    items: list[np.ndarray]
    words: np.ndarray
    weight: np.ndarray
    latent: np.ndarray | None = None
    vectors: np.ndarray | None = None
    sizes: np.ndarray | None = None
    #: For each vector: its item, and how many words around a like passage belong to its surroundings.
    owner: np.ndarray | None = None
    before: np.ndarray | None = None
    after: np.ndarray | None = None


MARKS = np.zeros(256, bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice without the ASCII marks at their edges, and the first of each row; words of marks alone are none."""
    start, end, first = tk.words(data, rows)
    lead, trail = np.flatnonzero(MARKS[data[start]]), np.flatnonzero(MARKS[data[end - 1]])
    ink = np.append(np.flatnonzero(~MARKS[data]), len(data))
    start[lead] = ink[np.searchsorted(ink, start[lead])]
    end[trail] = np.append(-1, ink)[np.searchsorted(ink, end[trail])] + 1
    kept = start < end
    return tk.span_hashes(data, start[kept], end[kept]), np.append(0, np.cumsum(kept))[first]


def _hashed(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for lo, hi, data, rows in tk.slices(texts):
        hashes, first = _word_hashes(data, rows)
        out += [hashes[first[r] : first[r + 1]] for r in range(hi - lo)]
    return out


def _known(words: np.ndarray):
    """A function from word hashes to (positions of those in ``words``, their numbers)."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(words >> tk.U(48)).astype(np.int64)] = True

    def find(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(maybe[(hashes >> tk.U(48)).astype(np.int64)])
        number = np.minimum(np.searchsorted(words, hashes[at]), max(0, len(words) - 1))
        same = words[number] == hashes[at] if len(words) else np.zeros(0, bool)
        return at[same], number[same]

    return find


def _weights(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each word over all passages of all documents."""

    def count(batches):
        df, passages, find = np.zeros(len(words), np.int64), 0, _known(words)
        for batch in batches:
            for _, _, data, rows in tk.slices(batch.column(0)):
                hashes, first = _word_hashes(data, rows)
                at, number = find(hashes)
                per_row = -(-np.diff(first) // WINDOW)
                row = np.searchsorted(first, at, "right") - 1
                passage = (np.cumsum(per_row) - per_row)[row] + (at - first[row]) // WINDOW
                pairs = np.unique(passage * len(words) + number)
                df += np.bincount(pairs % len(words), minlength=len(words))
                passages += int(per_row.sum())
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], passages))], names=["word", "n"])

    df, passages = np.zeros(len(words)), 0
    for row in docs.select(F.lower("text").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        if row["word"] < 0:
            passages = row["n"]
        else:
            df[row["word"]] = row["n"]
    idf = np.log((passages + 1) / (df + 1))
    return np.where(df > STOP_SHARE * max(1, passages), 0.0, np.maximum(idf, 0.05))


def _indexed(index: Index) -> Index:
    """Without stop words, but for those of items that hold hardly anything else."""
    stop = index.weight == 0
    at = [np.searchsorted(index.words, np.unique(x)) for x in index.items]
    poor = [x for x in at if (~stop[x]).sum() < LEAST_WORDS]
    needed = ~stop
    for x in poor:
        needed[x] = True
    weight = np.where(stop, 0.05, index.weight)
    return Index(index.ids, index.items, index.words[needed], weight[needed])


def _halves(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(half of each word at ``at``, first half of each passage, number of halves): a passage is two runs of STRIDE words, the second also the next one's first."""
    n = np.diff(first)
    per_row = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    base = np.append(0, np.cumsum(per_row + 1))
    row = np.searchsorted(first, at, "right") - 1
    passage = np.repeat(base[:-1] - np.append(0, np.cumsum(per_row)[:-1]), per_row) + np.arange(per_row.sum())
    return base[row] + (at - first[row]) // STRIDE, passage, int(base[-1])


def _summed(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their ascending group."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(groups):
        start = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        out[groups[start]] = np.add.reduceat(values, start, axis=0)
    return out


def _gram_part(number: np.ndarray, half: np.ndarray, passage: np.ndarray, halves: int, index: Index, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """(A'A basis, rows) for the rows A that ``_halves`` names: the weights of a passage's words over the root of the sum of their squares."""
    weighted = (basis * index.weight[:, None]).astype(np.float32)
    part = _summed(weighted[number], half, halves)
    square = np.bincount(half, index.weight[number] ** 2, halves)
    norm = square[passage] + square[passage + 1]
    full = norm > 0
    rows = (part[passage[full]] + part[passage[full] + 1]) / norm[full][:, None].astype(np.float32)
    back = np.zeros_like(part)
    back[passage[full]] += rows
    back[passage[full] + 1] += rows
    order = np.argsort(number, kind="stable")
    return _summed(back[half[order]], number[order], len(basis)) * index.weight[:, None], int(full.sum())


def _corpus_gram(docs: DataFrame, index: Index, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """(A'A basis, rows) for the passages of all documents, added up in tasks."""
    cuts = np.array_split(np.arange(len(basis)), GRAM_SLICES)

    def multiply(batches):
        total, rows, find = np.zeros(basis.shape), 0, _known(index.words)
        for batch in batches:
            for _, _, data, bounds in tk.slices(batch.column(0)):
                hashes, first = _word_hashes(data, bounds)
                at, number = find(hashes)
                some, n = _gram_part(number, *_halves(first, at), index, basis)
                total += some
                rows += n
        yield pa.record_batch([pa.array(range(GRAM_SLICES), pa.int32()), pa.array([rows if i == 0 else 0 for i in range(GRAM_SLICES)], pa.int64()), pa.array([total[c].tobytes() for c in cuts], pa.binary())], names=["slice", "rows", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in parts.column("sums"))
        return pa.table({"slice": pa.array([parts.column("slice")[0].as_py()], pa.int32()), "rows": pa.array([sum(parts.column("rows").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, rows long, sums binary"
    found = docs.select(F.lower("text").alias("text")).mapInArrow(multiply, schema).withColumn("salt", F.spark_partition_id() % GRAM_SALTS)
    sums = found.groupBy("slice", "salt").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    out, rows = np.zeros(basis.shape), 0
    for r in sums.toLocalIterator():
        out[cuts[r["slice"]]] = np.frombuffer(r["sums"], np.float64).reshape(-1, basis.shape[1])
        rows += r["rows"]
    return out, rows


def _fit(docs: DataFrame, index: Index) -> None:
    """Randomised SVD of all passages and items, both sides equally heavy: the Gram matrix times a random basis in one pass, and from both its leading vectors (Nystroem)."""
    words = len(index.words)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((words, min(RANK + SPARE_RANK, words))))[0]
    own = np.concatenate(index.items)
    at = np.minimum(np.searchsorted(index.words, own), words - 1)
    known = np.flatnonzero(index.words[at] == own)
    # an item is one row: two halves, of which the second is empty
    half = 2 * np.repeat(np.arange(len(index.items)), [len(x) for x in index.items])[known]
    items, n_items = _gram_part(at[known], half, 2 * np.arange(len(index.items)), 2 * len(index.items), index, basis)
    passages, n_passages = _corpus_gram(docs, index, basis)
    wide = items + passages * (n_items / max(1, n_passages))
    power, turn = np.linalg.eigh((basis.T @ wide + wide.T @ basis) / 2)
    sure = power > 1e-9 * max(power[-1], 1e-300)
    space = np.linalg.svd(wide @ (turn[:, sure] / np.sqrt(power[sure])), full_matrices=False)[0][:, :RANK]
    index.latent = (space * index.weight[:, None]).astype(np.float32)
    _place(index)


def _place(index: Index) -> None:
    """Latent vectors, sizes and surroundings of all items, and of all pieces of those longer than a passage."""
    n = np.array([len(x) for x in index.items])
    long = np.flatnonzero(n > WINDOW)
    first = np.append(0, np.cumsum(n))
    row, start, end = _windows(np.append(0, np.cumsum(n[long])))
    shift = (first[long] - np.append(0, np.cumsum(n[long]))[:-1])[row]
    lo, hi = np.append(first[:-1], start + shift), np.append(first[1:], end + shift)
    index.owner = np.append(np.arange(len(n)), long[row])
    spare = STRIDE + n[long[row]] // 4
    index.before = np.append(n // 2 + STRIDE, lo[len(n) :] - first[long[row]] + spare)
    index.after = np.append(n // 2 + STRIDE, first[long[row] + 1] - hi[len(n) :] + spare)
    own = np.concatenate(index.items)
    at = np.minimum(np.searchsorted(index.words, own), len(index.words) - 1)
    known = index.words[at] == own
    vectors = np.zeros((len(lo), index.latent.shape[1]), np.float32)
    for k, (i, j) in enumerate(zip(lo, hi, strict=True)):
        vectors[k] = index.latent[at[i:j][known[i:j]]].sum(axis=0)
    index.sizes = np.linalg.norm(vectors, axis=1).astype(np.float32)
    index.vectors = vectors / np.where(index.sizes > 0, index.sizes, 1)[:, None]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine integer holding a row of the table."""
    mask: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = row & mask.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def confirmed(item: np.ndarray, region: np.ndarray) -> tuple[float, float, bool]:
    """(share of the item, share of its answer, verdict) found in order in ``region``; nothing more is looked at if too few words are there in any order."""
    present = set(region.tolist())
    if sum(word in present for word in item.tolist()) < PARAPHRASE_SHARE * len(item):
        return 0.0, 0.0, False
    answer = item[-max(3, len(item) // 5) :]
    share = common_subsequence(item, region) / len(item)
    closing = common_subsequence(answer, region) / len(answer)
    return share, closing, share >= COPY_SHARE or (share >= PARAPHRASE_SHARE and closing >= ANSWER_SHARE)


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the passages; the last of a row reaches its end."""
    n = np.diff(first)
    per_row = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), per_row)
    k = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = first[row] + k * STRIDE
    return row, start, np.minimum(start + WINDOW, first[row + 1])


def _passage_vectors(latent: np.ndarray, at: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Latent sums of passages that begin STRIDE apart in a row: sums of half passages, each with the next one's."""
    cut = np.searchsorted(at, np.stack([start, np.minimum(start + STRIDE, end), end], axis=1))
    out = np.zeros((len(start), latent.shape[1]), np.float32)
    for k in range(2):
        full = np.flatnonzero(cut[:, k + 1] > cut[:, k])
        if len(full):
            lo, hi = cut[full, k], cut[full, k + 1]
            n = hi - lo
            ends = np.cumsum(n)
            own = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
            out[full] += np.add.reduceat(latent[number[own]], ends - n, axis=0)
    return out


def _search(docs: DataFrame, index: Index) -> DataFrame:
    def hits(batches):
        find = _known(index.words)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for lo, _, data, rows in tk.slices(batch.column(1)):
                hashes, first = _word_hashes(data, rows)
                at, number = find(hashes)
                row, start, end = _windows(first)
                for some in np.array_split(np.arange(len(row)), 1 + len(row) // 1024):
                    vectors = _passage_vectors(index.latent, at, number, start[some], end[some])
                    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                    for base in range(0, len(index.vectors), BLOCK_VECTORS):
                        likeness = vectors @ index.vectors[base : base + BLOCK_VECTORS].T
                        like = np.stack(np.nonzero(likeness >= (MIN_COSINE * np.maximum(norm, 1e-3))[:, None]))
                        for w, v in like[:, likeness[like[0], like[1]] >= MIN_COVER * index.sizes[base + like[1]]].T:
                            i, p = index.owner[base + v], some[w]
                            region = hashes[max(first[row[p]], start[p] - index.before[base + v]) : min(first[row[p] + 1], end[p] + index.after[base + v])]
                            share, closing, sure = confirmed(index.items[i], region)
                            if sure:
                                out.append((ids[lo + row[p]], index.ids[i], float(likeness[w, v] / norm[w]), share, closing))
            names = ["doc_id", "item_id", "cosine", "item_share", "answer_share"]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).where(F.col("doc_id").isNotNull()).mapInArrow(hits, "doc_id long, item_id long, cosine double, item_share double, answer_share double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, item_share, answer_share) of every document passage confirmed to hold an item."""
    spark = docs.sparkSession
    tk.small_batches(spark)
    items = staged(benchmark.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL"), "items")
    vectors = items.agg(F.sum(F.lit(1) + F.size(F.split("text", r"\s+")) / STRIDE)).first()[0] or 0
    blocks = -int(-vectors // BLOCK_VECTORS)
    found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, item_share double, answer_share double")
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        held = own.toArrow()
        lists = _hashed(held.column("text"))
        full = [i for i, x in enumerate(lists) if len(x)]
        if not full:
            continue
        words = np.unique(np.concatenate([lists[i] for i in full]))
        index = _indexed(Index(held.column("item_id").to_numpy()[full], [lists[i] for i in full], words, _weights(docs, words)))
        _fit(docs, index)
        found = found.unionByName(_search(docs, index))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("item_share").alias("item_share"), F.max("answer_share").alias("answer_share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("_bad_id"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
