"""Near-duplicate documents: exact Jaccard join on word shingles.

Method. Documents become sets of shingle hashes; equal sets are one class from there on.
Two sets of Jaccard >= t share at least one element within their prefixes of
n - ceil(t n) + 1 elements, under any order common to all; the order here puts shingles
that a corpus-wide count table shows to be frequent last, so that prefixes hold rare
ones. Sets meet in tiles (one prefix element, one band of sizes). There, sizes, the places
of the shared element in both orders, and the popcount of the differing bits of hashed
parity bitmaps bound the overlap from above (an element that only one set has flips one
bit, so bits that differ never outnumber such elements), and only pairs that pass are
verified by intersecting their sorted arrays.

Within a tile pairs are not all emitted. In a few rounds each document gets a pivot, the
first of its tiles' centres in a random order that is like it. The documents of a pivot
are named by what they differ in from it (the symmetric difference of two documents'
differences is that of their sets), and after a correction by what most of them differ
in, the links of a pivot's documents follow from sums over short lists, see
``_pivot_links``. Links are contracted to components, and tiles whose members are all of
one component drop out; tiles of few members take part in the first round only. The rounds only save work: afterwards the pairs of *different*
components and pivots in what is left are compared inside the join of a tile with itself,
whose condition holds the bounds, and there the members of a tile's largest component
meet only the others. A link inside a component would change nothing. So groups of copies
cost a few comparisons a member, and no link between components is lost.

What groups by a prefix element is a partial sum or a join, never a window, so a frequent
element is summed map-side and its rows can be split between tasks.

Defined cases. Null text, empty text, or text without words: empty set, linked with
nothing, not even with its like. Fewer words than a shingle: the whole sequence is
the one shingle. Rows that repeat a doc_id: one row each; the id links with what any
of them links with. Rows of null doc_id are dropped, since they cannot be named. An empty table gives
an empty result. Extra columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.llm import textkernel as tk
from genomeloom.operators.components import connected_components
from genomeloom.sources.shared import staged, table

SKETCH_BITS, SKETCH_SLICES, SKETCH_SALTS = 22, 16, 64
MIN_BITS, MAX_BITS = 64, 8192
#: Rounds of pivots at most, and bits of 64 that a pivot's signature may differ in.
ROUNDS, NEAR_BITS = 2, 20
#: Tiles of at most so many members take part in the first round only: comparing all of their pairs takes less than another round.
SMALL_TILE = 4
NAMED_BITS = 22


def shingle_sets(texts: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text."""
    for lo, hi, data, rows in tk.slices(texts):
        hashes, first = tk.word_hashes(tk.LOWER[data], rows)
        grams = tk.gram_hashes(hashes, k)
        for r in range(hi - lo):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield tk.gram_hashes(hashes[a:b], b - a) ^ tk.U(b - a)
            else:
                yield np.zeros(0, tk.U)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each hash bucket occur in all documents: 2^SKETCH_BITS counters, whatever the input's size."""

    def pack(total: np.ndarray) -> bytes:
        return zlib.compress(total.tobytes(), 1)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                total[(s >> tk.U(64 - SKETCH_BITS)).astype(np.int64)] += 1  # a set's elements of one bucket count once
        yield pa.record_batch([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([pack(p) for p in np.split(total, SKETCH_SLICES)], pa.binary())], names=["slice", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, np.uint32)
        for x in parts.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
        return pa.table({"slice": pa.array([parts.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([pack(total)], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "slice int, counts binary").withColumn("salt", F.spark_partition_id() % SKETCH_SALTS)
    sums = rows.groupBy("slice", "salt").applyInArrow(add, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    parts = {r["slice"]: np.frombuffer(zlib.decompress(r["counts"]), np.uint32) for r in sums.toLocalIterator()}
    return np.concatenate([parts.get(i, np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, np.uint32)) for i in range(SKETCH_SLICES)])


def _signature(s: np.ndarray) -> int:
    """64 bits that agree the more, the more alike two sets are: of the least element in each 64th of the hash range, one bit."""
    edges = np.arange(64, dtype=np.uint64) << tk.U(58)
    at = np.searchsorted(s, edges)
    least = s[np.minimum(at, len(s) - 1)]
    own = (at < len(s)) & (least >> tk.U(58) == np.arange(64, dtype=np.uint64))
    bit = np.where(own, tk.mix(least) & tk.U(1), tk.U(0))
    return int(np.bitwise_or.reduce(bit << np.arange(64, dtype=np.uint64)))


def set_rows(docs: DataFrame, k: int, least: Fraction, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n, band, up, f1, f2, sig, bits, prefix): size and its band, how much of the prefix counts towards larger partners, 128-bit fingerprint, signature, parity bitmap and prefix elements of each document's set."""
    rank = np.minimum(sketch, 65535).astype(np.uint16)
    p, q = least.numerator, least.denominator
    step = float(np.log(q / p))

    def rows(batches):
        for batch in batches:
            n, bands, ups, prints, bitmaps, prefixes = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                m = len(s)
                band = int(np.log(m) / step) if m else 0
                n.append(m)
                bands.append(band)
                larger = max(m, int(np.exp(step * (band + 1))) - 1)
                ups.append(max(0, m - (-(-p * (m + larger) // (p + q))) + 1))
                prints.append((int(np.bitwise_xor.reduce(tk.mix(s))), int(np.add.reduce(tk.mix(s ^ tk.GOLD))), _signature(s)) if m else (0, 0, 0))
                width = _width(band, step)
                odd = np.bincount((s & tk.U(width - 1)).astype(np.int64), minlength=width) & 1
                bitmaps.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                keep = m - -(-p * m // q) + 1 if m else 0
                # s is sorted, so a stable sort by count orders by (count, hash)
                prefixes.append(s[np.argsort(rank[(s >> tk.U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:keep]])
            flat = np.concatenate([*prefixes, np.zeros(0, tk.U)]).view(np.int64)
            f = np.array(prints, tk.U).reshape(-1, 3).view(np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(bands, pa.int32()), pa.array(ups, pa.int32()), *(pa.array(f[:, i]) for i in range(3)), tk.list_array(np.concatenate([*bitmaps, np.zeros(0, np.int64)]), [len(x) for x in bitmaps], pa.int64()), tk.list_array(flat, [len(x) for x in prefixes], pa.int64())],
                names=["doc_id", "n", "band", "up", "f1", "f2", "sig", "bits", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull()).mapInArrow(rows, "doc_id long, n long, band int, up int, f1 long, f2 long, sig long, bits array<long>, prefix array<long>")


def _width(band: int, step: float) -> int:
    """Bits of the bitmaps of a band: one for each element that its largest set has, as a power of two."""
    return int(min(MAX_BITS, max(MIN_BITS, 1 << int(np.ceil(np.log2(np.exp(step * (band + 1))))))))


def _folded(bits: Column, longs: Column) -> Column:
    """A parity bitmap at half its width if it is wider than ``longs``; neighbouring bands are at most one doubling apart."""
    return F.when(F.size(bits) > longs, F.zip_with(F.slice(bits, 1, longs), F.slice(bits, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def _sizes_fit(na: Column, nb: Column, least: Fraction) -> Column:
    return F.least(na, nb) * least.denominator >= F.greatest(na, nb) * least.numerator


def _room(na: Column, nb: Column, both: Column, least: Fraction) -> Column:
    """Whether an overlap of ``both`` at most can reach the similarity."""
    return both * least.denominator >= (na + nb - both) * least.numerator


def _bits_fit(na: Column, nb: Column, bits_a: Column, bits_b: Column, least: Fraction) -> Column:
    """Whether the bitmaps leave room: elements of one set only are at least the bits that differ, so half of what is left bounds the overlap."""
    longs = F.least(F.size(bits_a), F.size(bits_b))
    differ = F.aggregate(F.zip_with(_folded(bits_a, longs), _folded(bits_b, longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return _room(na, nb, F.floor((na + nb - differ) / 2), least)


def _verified(least: Fraction):
    p, q = least.numerator, least.denominator

    def keep(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            sides = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column("set_a"), batch.column("set_b"))]
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for o, v in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = both * q >= p * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return keep


def _whole_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, set) of the documents of ``ids`` (doc_id), and of a few others.

    Texts stay where they are: a bit table of fixed size tells the tasks which documents
    may be asked for, and only the sets of those are shuffled.
    """
    wanted = tk.BitTable.of(ids.select(F.xxhash64("doc_id")), NAMED_BITS)

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch.column(2).to_numpy().view(np.uint64))))
            s = list(shingle_sets(batch.column(1), k))
            yield pa.record_batch([batch.column(0), tk.list_array(np.concatenate([*s, np.zeros(0, tk.U)]).view(np.int64), [len(x) for x in s], pa.int64())], names=["doc_id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    return staged(texts.mapInArrow(sets, "doc_id long, set array<long>").where(F.size("set") > 0), "sets")


def _both(pairs: DataFrame, a: str, b: str, docs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (a, b) with set_a and set_b."""
    arrays = _whole_sets(pairs.select(F.col(a).alias("doc_id")).union(pairs.select(b)).distinct(), docs, k)
    return pairs.join(arrays.select(F.col("doc_id").alias(a), F.col("set").alias("set_a")), a).join(arrays.select(F.col("doc_id").alias(b), F.col("set").alias("set_b")), b)


def _links(pairs: DataFrame, docs: DataFrame, k: int, least: Fraction) -> DataFrame:
    """Those of the candidate ``pairs`` (a, b) that link, by intersecting whole sets."""
    full = _both(staged(pairs, "pairs"), "a", "b", docs, k)
    return staged(full.select("a", "b", "set_a", "set_b").mapInArrow(_verified(least), "a long, b long").distinct(), "links")


def _differences(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(pivot, doc_id, n, diff) of ``pairs`` (doc_id, pivot): what is in one of both sets only; a pivot has a row of its own."""

    def differ(batches):
        for batch in batches:
            sides = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column("set_a"), batch.column("set_b"))]
            rows = [[v[o[i] : o[i + 1]] for o, v in sides] for i in range(batch.num_rows)]
            diffs = [np.setxor1d(x, y, assume_unique=True) for x, y in rows]
            yield pa.record_batch([batch.column("pivot"), batch.column("doc_id"), pa.array([len(x) for x, _ in rows], pa.int64()), tk.list_array(np.concatenate([*diffs, np.zeros(0, np.int64)]), [len(x) for x in diffs], pa.int64())], names=["pivot", "doc_id", "n", "diff"])

    own = pairs.select(F.col("pivot").alias("doc_id"), "pivot").distinct()
    full = _both(pairs.unionByName(own), "doc_id", "pivot", docs, k)
    return staged(full.select("pivot", "doc_id", "set_a", "set_b").mapInArrow(differ, "pivot long, doc_id long, n long, diff array<long>"), "differences")


def _pivot_links(rows: DataFrame, least: Fraction) -> DataFrame:
    """(a, b): links that connect all documents of a pivot that links connect; ``rows`` as ``_differences`` gives them.

    With similarity p / q, two sets link if (q - p)(na + nb) >= (q + p) * (elements in one of them only).
    The latter number is |Da| + |Db| - 2 |Da & Db|, for differences D to whatever third set; it is the pivot, changed by
    all that more than half of its documents differ in. With slack S = (q - p) n - (q + p) |D|, documents link if
    Sa + Sb + 2 (q + p) |Da & Db| >= 0. So those that link without a common element both link with the document of most
    slack; those that link by one common element both link with the document of most slack that has it; and those that need more
    are compared where they share one of the rarest elements of each.
    """
    p, q = least.numerator, least.denominator
    two = 2 * (q + p)
    c = F.col
    sizes = rows.groupBy("pivot").agg(F.count("*").alias("m"))
    common = rows.select("pivot", F.explode("diff").alias("e")).groupBy("pivot", "e").agg(F.count("*").alias("k")).join(sizes, "pivot").where("2 * k > m")
    common = common.groupBy("pivot").agg(F.collect_list("e").alias("c"))
    third = F.coalesce("c", F.array().cast("array<long>"))
    placed = rows.join(common, "pivot", "left").withColumn("d", F.concat(F.array_except("diff", third), F.array_except(third, "diff")))
    placed = staged(placed.select("pivot", "doc_id", F.size("d").alias("size"), "d", ((q - p) * c("n") - (q + p) * F.size("d")).alias("s")), "placed")
    top = lambda: F.max(F.struct("s", "doc_id"))
    linked = lambda rows, room: rows.where((c("s") + c("best.s") + room >= 0) & (c("doc_id") != c("best.doc_id"))).select(F.least("doc_id", "best.doc_id").alias("a"), F.greatest("doc_id", "best.doc_id").alias("b"))
    rooted = placed.join(placed.groupBy("pivot").agg(top().alias("best")), "pivot")
    first = linked(rooted, 0)
    parts = placed.select("pivot", "doc_id", "s", "size", F.explode("d").alias("e"))
    held = parts.groupBy("pivot", "e").agg(top().alias("best"), F.count("*").alias("k")).where("k > 1")
    parts = staged(parts.join(held, ["pivot", "e"]), "parts")
    found = first.unionByName(linked(parts, two))

    # what needs two common elements or more: each list by rarity, of which the last need - 1 elements cannot be the first common one
    root = rooted.select("pivot", "doc_id", F.when(c("s") + c("best.s") >= 0, c("best.doc_id")).alias("root"))
    towards = parts.groupBy("pivot", "doc_id").agg(F.count("*").alias("held"), F.min(F.when(c("s") + c("best.s") + two >= 0, c("best.doc_id"))).alias("next"))
    named = towards.join(root, ["pivot", "doc_id"]).join(root.select("pivot", c("doc_id").alias("next"), c("root").alias("far")), ["pivot", "next"], "left")
    named = named.select("pivot", "doc_id", "held", F.coalesce("root", "far", "next", "doc_id").alias("label"))  # equal labels: linked so far
    order = F.row_number().over(W.partitionBy("pivot", "doc_id").orderBy("k", "e"))  # no longer than one list
    ranked = parts.join(named, ["pivot", "doc_id"]).select("pivot", "e", "doc_id", "s", (order + c("size") - c("held")).alias("place"), "size", "label")
    x, y = ranked.alias("x"), ranked.alias("y")
    room = c("x.s") + c("y.s")
    need = F.ceil(-room / two)
    fits = (need <= F.least("x.size", "y.size")) & (c("x.place") <= c("x.size") - need + 1) & (c("y.place") <= c("y.size") - need + 1)
    met = x.join(y, (c("x.pivot") == c("y.pivot")) & (c("x.e") == c("y.e")) & (c("x.doc_id") < c("y.doc_id")) & (c("x.label") != c("y.label")) & (room + two < 0) & fits)
    pairs = met.select("x.pivot", c("x.doc_id").alias("a"), c("y.doc_id").alias("b")).distinct()
    side = lambda name: placed.select("pivot", c("doc_id").alias(name), c("s").alias("s" + name), c("d").alias("d" + name))
    both = pairs.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"])
    more = both.where(c("sa") + c("sb") + two * F.size(F.array_intersect("da", "db")) >= 0).select("a", "b")
    return staged(found.unionByName(more).distinct(), "links")


def _tiles(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, tile, doc_id, n, sig, place, own) of the prefix elements that several classes share; own: whether the tile is of the set's own band."""
    reps = sets.where("n > 0").join(classes.select(F.col("rep").alias("doc_id"), "n", "f1", "f2"), ["doc_id", "n", "f1", "f2"], "left_semi")
    postings = reps.select("doc_id", F.posexplode("prefix").alias("place", "key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    meta = reps.select("doc_id", "n", "band", "up", "sig")
    met = postings.join(shared, "key", "left_semi").join(meta, "doc_id")
    tile = F.explode(F.when(F.col("place") < F.col("up"), F.array("band", F.col("band") + 1)).otherwise(F.array("band")))
    rows = met.select("key", tile.alias("tile"), "doc_id", "n", "sig", "place", "band")
    return rows.select("key", "tile", "doc_id", "n", "sig", "place", (F.col("tile") == F.col("band")).alias("own"))


def _pivots(tiles: DataFrame, turn: int, least: Fraction) -> DataFrame:
    """(doc_id, pivot): of the centres of a document's tiles that are like it, the first in the turn's order."""
    centres = tiles.groupBy("key", "tile").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "n", "sig")).alias("c"))
    apart = F.bit_count(F.col("sig").bitwiseXOR(F.col("c.sig")))
    near = tiles.join(centres, ["key", "tile"]).where((F.col("doc_id") != F.col("c.doc_id")) & (apart <= NEAR_BITS) & _sizes_fit(F.col("n"), F.col("c.n"), least))
    return staged(near.groupBy("doc_id").agg(F.min(F.struct("c.h", "c.doc_id")).alias("m")).select("doc_id", F.col("m.doc_id").alias("pivot")), "pivots")


def _placed(tiles: DataFrame, components: DataFrame) -> DataFrame:
    """``tiles`` with the component of each member; ``components`` has (node, component)."""
    return tiles.drop("component").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _mixed(tiles: DataFrame, components: DataFrame) -> DataFrame:
    """Tiles whose members stand in several components, with component and number of members; ``components`` as for ``_placed``."""
    rows = _placed(tiles.drop("members"), components)
    several = rows.groupBy("key", "tile").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members")).where("c0 < c1").select("key", "tile", "members")
    return rows.join(several, ["key", "tile"])


def _rest(tiles: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of different components in a tile, without a pivot in common, that the bounds leave."""
    parts = tiles.groupBy("key", "tile", "component").agg(F.count("*").alias("m"))
    largest = parts.groupBy("key", "tile").agg(F.max(F.struct("m", "component")).alias("top")).select("key", "tile", F.col("top.component").alias("top"))
    bits = sets.where("n > 0").select("doc_id", "bits").join(tiles.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = tiles.drop("sig").join(largest, ["key", "tile"]).withColumn("big", F.col("component") == F.col("top")).drop("top").join(bits, "doc_id")
    x, y = rows.alias("x"), rows.where("NOT big").alias("y")
    c = F.col
    same = (c("x.key") == c("y.key")) & (c("x.tile") == c("y.tile"))
    once = (c("x.component") != c("y.component")) & (c("x.big") | (c("x.doc_id") < c("y.doc_id"))) & (c("x.own") | c("y.own"))
    known = [F.coalesce((c(f"x.p{i}") == c(f"y.p{i}")) | (c(f"x.p{i}") == c("y.doc_id")) | (c(f"y.p{i}") == c("x.doc_id")), F.lit(False)) for i in range(ROUNDS)]
    # at the first element that two sets share, nothing before it is common
    placed = _room(c("x.n"), c("y.n"), F.least(c("x.n") - c("x.place"), c("y.n") - c("y.place")), least)
    met = x.join(y, same & once & ~reduce(Column.__or__, known) & _sizes_fit(c("x.n"), c("y.n"), least) & placed & _bits_fit(c("x.n"), c("y.n"), c("x.bits"), c("y.bits"), least))
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, similarity: str = "0.8") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id reachable by links.

    ``similarity`` is a decimal text and taken exactly.
    """
    tk.small_batches(docs.sparkSession)
    least = Fraction(similarity)
    sets = staged(set_rows(docs, k, least, _sketch(docs, k)), "sets")
    # equal sets are one class from here on, named by its smallest doc_id
    classes = staged(sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    repeated = sets.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id")
    of_id = sets.where("n > 0").select("doc_id", "n", "f1", "f2").join(repeated, "doc_id", "left_semi").join(classes, ["n", "f1", "f2"])
    links = staged(of_id.where("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct(), "links")
    tiles = _tiles(sets, classes).withColumn("component", F.col("doc_id"))
    tiles = staged(tiles.withColumns({f"p{turn}": F.lit(None).cast("long") for turn in range(ROUNDS)}), "tiles")
    small = []
    for turn in range(ROUNDS):
        pivots = _pivots(tiles, turn, least)
        # what is linked so far enters the next contraction as stars, not as links
        stars = connected_components(links.unionByName(_pivot_links(_differences(pivots, docs, k), least)), "a", "b")
        links = stars.toDF("a", "b")
        placed = tiles.drop(f"p{turn}").join(pivots.withColumnRenamed("pivot", f"p{turn}"), "doc_id", "left")
        mixed = staged(_mixed(placed, stars), "tiles")
        small.append(mixed.where(F.col("members") <= SMALL_TILE))
        tiles = mixed.where(F.col("members") > SMALL_TILE)
    left = reduce(DataFrame.unionByName, small, tiles).drop("members")
    links = links.unionByName(_links(_rest(_placed(left, links.toDF("node", "component")), sets, least), docs, k, least))
    final = staged(connected_components(links, "a", "b"), "components")
    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    return sets.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, similarity: str = "0.8") -> DataFrame:
    """``docs`` without the members of each component but its smallest doc_id; rows of null doc_id stay."""
    gone = jaccard_components(docs, k, similarity).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, similarity="0.85")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
p AS (SELECT rep, n, unnest(sh) AS g FROM c),
i AS (SELECT a.rep AS u, b.rep AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT u, v FROM i WHERE 100 * k >= 85 * (nu + nv - k)),
bi AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT rep AS node, rep AS low FROM c UNION SELECT bi.v, reach.low FROM reach JOIN bi ON bi.u = reach.node),
lab AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(coalesce(lab.low, s.doc_id) AS BIGINT) AS component_id
FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN lab ON lab.node = c.rep
"""
