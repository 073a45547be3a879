"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

Method. Trusted documents give trigram counts; continuation counts, context totals and
the numbers of continuations seen once, twice or more often follow from them by grouped
counts and joins, all sharded by the hash of the n-gram. Discounts come from the counts
of counts of each order. The result is one table of (n-gram, share) and (context, weight)
for each order; a word's probability is the interpolation over the three orders, and a
document's perplexity takes in all of its words. A document is kept if its perplexity is
at most that quantile of its language which HELD_OUT trusted documents (a fifth, not
trained on) set, with some slack for what few of them can tell.

The model is trained on all trusted documents that aren't held out and is never collected:
blocks of documents send their distinct n-grams, packed, to shards by the hash of the n-gram, which sum up
what all blocks have learnt and tell each block the counts of what it asked for; see ``perplexities``. Thresholds take in every held-out
trusted document, perplexities every document. Words and pairs of words are told apart by 64-bit hashes, the words next to one pair by 36 bits.

Defined cases. Null or wordless text, or fewer than MIN_WORDS words: kept is true, for
nothing can be said (perplexity null without words). Null language: a language of its
own. A language with fewer than MIN_HELD_OUT held-out documents takes the quantile of all
of them together; without any, all documents are kept. Repeated rows each give their own
result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.llm import textkernel as tk
from genomeloom.sources.shared import emptied, staged, table

FOLDS = 5
QUANTILE, SLACK = 0.99, 1.25
MIN_WORDS, MIN_HELD_OUT = 10, 20
#: Hash of the place before the first word.
BEGIN = tk.U(0x51ED270B6A1F39C7)


def _grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names of (uvw, uv, vw, v, w) at each word w, u and v being the words before it in its row."""
    n = len(hashes)
    back1, back2 = np.full(n, BEGIN), np.full(n, BEGIN)
    back1[1:], back2[2:] = hashes[:-1], hashes[:-2]
    begin = first[:-1][np.diff(first) > 0]
    second = begin[begin + 1 < n] + 1
    back1[begin] = BEGIN
    back2[begin] = back2[second] = BEGIN
    pair = lambda a, b: tk.mix((a ^ (b * tk.MIX2)) * tk.MIX1 + tk.GOLD)
    uv, vw = pair(back2, back1), pair(back1, hashes)
    return pair(uv, hashes ^ tk.BASE), uv, vw, back1, hashes


class Lookup:
    """Values by 64-bit name; 0 or ``missing`` for names that aren't there."""

    def __init__(self, names: np.ndarray, values: np.ndarray, missing: float) -> None:
        order = np.argsort(names)
        self.names, self.values, self.missing = names[order], values[order].astype(np.float32), missing
        self.shift = tk.U(64 - min(24, max(10, int(len(names) * 8).bit_length())))

    def ready(self) -> None:
        """The table of first bits, made in each task rather than sent there."""
        self.maybe = np.zeros(1 << int(tk.U(64) - self.shift), bool)
        self.maybe[(self.names >> self.shift).astype(np.int64)] = True

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        out = np.full(len(asked), self.missing, np.float32)
        at = np.flatnonzero(self.maybe[(asked >> self.shift).astype(np.int64)])
        if len(self.names):
            k = np.minimum(np.searchsorted(self.names, asked[at]), len(self.names) - 1)
            same = self.names[k] == asked[at]
            out[at[same]] = self.values[k[same]]
        return out


@dataclass
class Model:
    tables: dict[str, Lookup]

    def log_shares(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability after the two before it."""
        uvw, uv, vw, v, w = _grams(hashes, first)
        t = self.tables
        low = t["w"](w)
        return np.log(t["uvw"](uvw) + t["uv"](uv) * (t["vw"](vw) + t["v"](v) * low).astype(np.float64))


def _discounts(counts: DataFrame, n: str) -> tuple[float, float, float]:
    """Discounts of counts of one, two, and three or more."""
    return _discount_values({r[n]: r["k"] for r in counts.where(F.col(n) <= 4).groupBy(n).agg(F.count("*").alias("k")).collect()})


def _discount_values(seen: dict[int, int]) -> tuple[float, float, float]:
    """The same from how many counts are one, two, three and four."""
    n1, n2, n3, n4 = (max(1, seen.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(i - 0.05, max(0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _gram_rows(texts: DataFrame) -> DataFrame:
    """(key, uvw, uv, vw, v, w) at each word of ``texts`` (key, text)."""

    def grams(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, data, rows in tk.slices(batch.column(1)):
                hashes, first = tk.word_hashes(tk.LOWER[data], rows)
                names = [np.repeat(keys[lo:hi], np.diff(first)), *(x.view(np.int64) for x in _grams(hashes, first))]
                yield pa.record_batch([pa.array(x) for x in names], names=["key", "uvw", "uv", "vw", "v", "w"])

    return texts.mapInArrow(grams, "key long, uvw long, uv long, vw long, v long, w long")


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text); equal texts have equal keys and equal perplexities."""
    return docs.select(F.xxhash64("text").alias("key"), "text")


def shares(trusted: DataFrame) -> tuple[dict[str, DataFrame], float]:
    """The model of ``trusted`` (text): tables (name, x) of the shares of uvw, vw, w and of the weights of the contexts uv, v; and the share of an unknown word."""
    grams = _gram_rows(_keyed(trusted))
    tri = staged(grams.groupBy("uvw", "uv", "vw", "v", "w").agg(F.count("*").alias("n")), "trigrams")
    bi = staged(tri.groupBy("vw", "v", "w").agg(F.count("*").alias("n")), "bigrams")
    uni = staged(bi.groupBy("w").agg(F.count("*").alias("n")), "unigrams")

    def of_order(counts: DataFrame, gram: str, context: str) -> tuple[DataFrame, DataFrame]:
        d = _discounts(counts, "n")
        of = counts.groupBy(context).agg(F.sum("n").alias("all"), F.sum(_discount(F.col("n"), d)).alias("freed"))
        joined = counts.join(of, context)
        return joined.select(F.col(gram).alias("name"), ((F.col("n") - _discount(F.col("n"), d)) / F.col("all")).alias("x")), of.select(F.col(context).alias("name"), (F.col("freed") / F.col("all")).alias("x"))

    total = uni.agg(F.sum("n").alias("all"), F.count("*").alias("words")).first()
    d1 = _discounts(uni, "n")
    freed = uni.agg(F.sum(_discount(F.col("n"), d1))).first()[0] or 0.0
    spread = max(freed / max(1, total["all"] or 1), 1e-6) / (total["words"] + 1) if total["words"] else 1.0
    t3, g2 = of_order(tri, "uvw", "uv")
    t2, g1 = of_order(bi, "vw", "v")
    t1 = uni.select(F.col("w").alias("name"), ((F.col("n") - _discount(F.col("n"), d1)) / (total["all"] or 1) + spread).alias("x"))
    return {"uvw": t3, "uv": g2, "vw": t2, "v": g1, "w": t1}, spread


def _missing(spread: float) -> dict[str, float]:
    """What names that aren't in a table stand for."""
    return {"uvw": 0.0, "uv": 1.0, "vw": 0.0, "v": 1.0, "w": spread}


def train(trusted: DataFrame) -> Model:
    """The model of ``trusted`` (text) in memory: for small tables and as the exact form of the joins."""
    frames, spread = shares(trusted)
    tables = {}
    for key, missing in _missing(spread).items():
        held = frames[key].select("name", F.col("x").cast("float").alias("x")).toArrow()
        tables[key] = Lookup(held.column("name").to_numpy().view(np.uint64), held.column("x").to_numpy(), missing)
    return Model(tables)


#: Characters of text in a block of documents, and text that a task holds while it deals documents out.
BLOCK_CHARS, DEAL_BYTES = 6_000_000, 32_000_000
#: Parts of the names that are asked for one after another, so that only one part's shuffle is on disk.
PARTS = 5
#: Bits that tell apart the words next to one pair of words.
NEXT_BITS = tk.U(36)


def _packed(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, so that planes of zeros and small numbers take little room."""
    planes = np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).reshape(n)


def _steps(names: np.ndarray) -> np.ndarray:
    """Differences of sorted names, which need fewer bytes."""
    return np.diff(names, prepend=tk.U(0))


def _firsts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths.astype(np.int64))])


def _shard(names: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each name; sorted names have sorted shards."""
    return ((names >> tk.U(32)) * tk.U(shards)) >> tk.U(32)


#: Name of the two places before the first word.
FIRST = _grams(np.zeros(1, tk.U), np.array([0, 1]))[1]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


class _Block:
    """The words of a block of documents: its pairs of words and what follows them, each in sorted order.

    With ``part`` (shards, part), only the pairs of that part; without ``follows``, no followers.
    """

    low = (tk.U(1) << NEXT_BITS) - tk.U(1)

    def __init__(self, texts: pa.Table, trained: pa.Table, part: tuple[int, int] | None = None, follows: bool = True) -> None:
        hashes, lengths, self.ids, self.langs = [np.zeros(0, tk.U)], [np.zeros(0, np.int64)], [], []
        for data in texts.column("data"):
            for batch in pa.ipc.open_stream(data.as_buffer()):
                self.ids += batch.column(0).to_pylist()
                self.langs += batch.column(1).to_pylist()
                for _, _, text, rows in tk.slices(batch.column(2)):
                    found, first = tk.word_hashes(tk.LOWER[text], rows)
                    hashes.append(found)
                    lengths.append(np.diff(first))
        self.hashes, self.n_words = np.concatenate(hashes), np.concatenate(lengths)
        first = _firsts(self.n_words)
        begin = first[:-1][self.n_words > 0]
        _, _, vw, v, _ = _grams(self.hashes, first)
        mine = lambda names: np.ones(len(names), bool) if part is None else _shard(names, part[0]) % tk.U(PARTS) == tk.U(part[1])
        here, start = mine(vw), FIRST[mine(FIRST)]
        names = np.concatenate([vw[here], start])
        if part:
            self.pairs, at = np.unique(names, return_inverse=True)
        else:
            self.pairs, some, at = np.unique(names, return_index=True, return_inverse=True)
            # the two words of each pair; the pair of two places before a text has none
            some = np.minimum(some, max(0, len(vw) - 1))
            self.left, self.right = (v[some], self.hashes[some]) if len(vw) else (np.zeros(1, tk.U), np.zeros(1, tk.U))
        self.pair = np.zeros(len(vw), np.int64)
        self.pair[here] = at[: len(at) - len(start)]
        if not follows:
            return
        shifted = lambda x, head: np.concatenate([np.full(1, head, x.dtype), x[:-1]])[: len(x)]
        self.before, after, back2 = shifted(self.pair, 0), shifted(here, False), shifted(v, BEGIN)
        self.before[begin], after[begin], back2[begin] = at[-1] if len(start) else 0, len(start) > 0, BEGIN
        known = np.array([i is not None for i in self.ids], bool)
        learns = np.isin(np.array([i or 0 for i in self.ids], np.int64), trained.column("doc_id").to_numpy()) & known
        learns = np.repeat(learns, self.n_words)
        self.follows, self.follow = np.unique(self.before[after].astype(np.uint64) << NEXT_BITS | self.hashes[after] & self.low, return_inverse=True)
        self.learnt = np.bincount(self.follow, learns[after], len(self.follows)).astype(np.int64)
        learns &= here
        self.leads = _distinct(self.pair[learns].astype(np.uint64) << NEXT_BITS | back2[learns] & self.low)

    def words(self) -> np.ndarray:
        return _distinct(np.concatenate([self.hashes, np.full(1, BEGIN)]))


def _dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, data) of the documents (doc_id, lang, text): streams of record batches."""
    kind = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])

    def streams(held: pa.Table):
        order = held.sort_by("block")
        block = order.column("block").to_numpy()
        for lo, hi in zip(edges := np.flatnonzero(np.diff(block, prepend=-1)), [*edges[1:], len(block)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(order.slice(lo, hi - lo).select([1, 2, 3]).cast(kind).combine_chunks())
            yield pa.record_batch([pa.array([block[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    def deal(batches):
        held, room = [], 0
        for batch in batches:
            held.append(batch)
            room += batch.nbytes
            if room >= DEAL_BYTES:
                yield from streams(pa.Table.from_batches(held))
                held, room = [], 0
        if held:
            yield from streams(pa.Table.from_batches(held))

    i = F.col("doc_id").cast("long")
    block = F.pmod(F.xxhash64(F.coalesce(i, F.xxhash64("text"))), F.lit(blocks)).cast("int").alias("block")
    return docs.select(block, i.alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text").mapInArrow(deal, "block int, data binary")


HELD = "block int, data array<binary>, trained array<long>"
ASKED = "shard int, block int, names binary, n_follows binary, follows binary, learnt binary, n_leads binary, leads binary"
TOLD = "block int, shard int, kinds binary, rest binary, once binary, twice binary, more binary, owned binary, seen binary, " + ", ".join(f"{o}{n} long" for o in "tp" for n in range(1, 5))
WORDS = "shard int, block int, names binary, rest binary, once binary, twice binary, more binary, kinds binary"
WORTH = "block int, shard int, rest binary, once binary, twice binary, more binary, kinds binary, total long, words long, " + ", ".join(f"w{n} long" for n in range(1, 5))


def _rows(rows: list[list], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))


def _gathered(texts: pa.Table, trained: pa.Table) -> pa.Table:
    """A block's documents and which of them are learnt, as one row."""
    fields = pa.schema([("block", pa.int32()), ("data", pa.list_(pa.binary())), ("trained", pa.list_(pa.int64()))])
    rows = [[texts.column("block")[0].as_py()], [texts.column("data").to_pylist()], [trained.column("doc_id").to_pylist()]] if texts.num_rows else [[], [], []]
    return pa.table([pa.array(x, f.type) for x, f in zip(rows, fields)], schema=fields)


def _ask(shards: int, part: int):
    """What a block asks of the shards of one part: its pairs with what follows and, where they are learnt, comes before them."""

    def ask(block: int, data: pa.Array, trained: pa.Array) -> pa.Table:
        b = _Block(pa.table({"data": data}), pa.table({"doc_id": trained}), (shards, part))
        shard = _shard(b.pairs, shards)
        edges = np.searchsorted(shard, np.arange(shards + 1))
        at = lambda codes: np.searchsorted(codes >> NEXT_BITS, np.arange(len(b.pairs) + 1, dtype=np.uint64))
        f, p = at(b.follows), at(b.leads)
        rows = []
        for s in range(part, shards, PARTS):
            lo, hi = edges[s], edges[s + 1]
            if lo < hi:
                follows, leads = slice(f[lo], f[hi]), slice(p[lo], p[hi])
                parts = _steps(b.pairs[lo:hi]), np.diff(f[lo : hi + 1]), b.follows[follows] & b.low, b.learnt[follows], np.diff(p[lo : hi + 1]), b.leads[leads] & b.low
                rows.append([s, block, *map(_packed, parts)])
        return _rows(rows, ASKED)

    def asks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(batch.column("block")[i].as_py(), batch.column("data")[i].values, batch.column("trained")[i].values).to_batches()

    return asks


def _tell(asked: pa.Table) -> pa.Table:
    """Counts of all blocks for each block's pairs: words before it, words after it met once, twice and more often, and how often the last ones beyond three times; of each follower, how often."""
    asked = asked.sort_by("block")
    names, n_follows, follows, learnt, n_leads, leads = ([_unpacked(x.as_buffer().to_pybytes()) for x in asked.column(k)] for k in range(2, 8))
    cut, cuts = _firsts(np.array([len(x) for x in names])), _firsts(np.array([len(x) for x in follows]))
    names, name = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in names]), return_inverse=True)
    n = len(names)
    code = lambda counts, rest: np.repeat(name, np.concatenate(counts).astype(np.int64)).astype(np.uint64) << NEXT_BITS | np.concatenate(rest)
    trigram, of = np.unique(code(n_follows, follows), return_inverse=True)
    seen = np.bincount(of, np.concatenate(learnt), len(trigram)).astype(np.int64)
    context = (trigram >> NEXT_BITS).astype(np.int64)
    once, twice, more = (np.bincount(context[w], minlength=n) for w in (seen == 1, seen == 2, seen > 2))
    # what the three leave of the sum of all is mostly nought
    rest = np.bincount(context, np.maximum(seen - 3, 0), n).astype(np.int64)
    kinds = np.bincount((_distinct(code(n_leads, leads)) >> NEXT_BITS).astype(np.int64), minlength=n)
    # the first block that learns a pair speaks for it
    holds = np.flatnonzero(np.concatenate(n_leads) > 0)
    owned = np.zeros(len(name), np.int64)
    owned[holds[np.unique(name[holds], return_index=True)[1]]] = 1
    rows = []
    for i in range(asked.num_rows):
        own = name[cut[i] : cut[i + 1]]
        parts = kinds[own], rest[own], once[own], twice[own], more[own], owned[cut[i] : cut[i + 1]], seen[of[cuts[i] : cuts[i + 1]]]
        stats = [int((x == k).sum()) for x in (seen, kinds) for k in range(1, 5)] if i == 0 else [0] * 8
        rows.append([asked.column("block")[i].as_py(), asked.column("shard")[i].as_py(), *map(_packed, parts), *stats])
    return _rows(rows, TOLD)


def _joined(rows: pa.Table, columns: list[str]) -> list[np.ndarray]:
    """Each column's parts, in the order of their shards."""
    rows = rows.sort_by("shard")
    return [np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x.as_buffer().to_pybytes()) for x in rows.column(c))]).astype(np.int64) for c in columns]


def _answers(rows: pa.Table, what: int) -> pa.Table:
    return rows.filter(pa.array(rows.column("what").to_numpy() == what))


def _ask_words(shards: int):
    """What a block asks of the words' shards, with what it adds to them for the pairs that it speaks for."""

    def ask(rows: pa.Table, trained: pa.Table) -> pa.Table:
        texts = _answers(rows, 0)
        if not texts.num_rows:
            return _rows([], WORDS)
        b = _Block(texts, trained, follows=False)
        kinds, owned = _joined(_answers(rows, 1), ["kinds", "owned"])
        words = b.words()
        own = np.flatnonzero(owned)
        left, right = np.searchsorted(words, b.left[own]), np.searchsorted(words, b.right[own])
        k = kinds[own]
        sums = [np.bincount(left, np.maximum(k - 3, 0), len(words)).astype(np.int64), *(np.bincount(left[w], minlength=len(words)) for w in (k == 1, k == 2, k > 2)), np.bincount(right, minlength=len(words))]
        edges = np.searchsorted(_shard(words, shards), np.arange(shards + 1))
        block = texts.column("block")[0].as_py()
        return _rows([[s, block, _packed(_steps(words[lo:hi])), *(_packed(x[lo:hi]) for x in sums)] for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi], WORDS)

    return ask


def _tell_words(asked: pa.Table) -> pa.Table:
    """Sums over all blocks for each block's words."""
    names = [np.cumsum(_unpacked(x.as_buffer().to_pybytes()), dtype=np.uint64) for x in asked.column("names")]
    cut = _firsts(np.array([len(x) for x in names]))
    words, word = np.unique(np.concatenate(names), return_inverse=True)
    sums = [np.bincount(word, np.concatenate([_unpacked(x.as_buffer().to_pybytes()) for x in asked.column(c)]), len(words)).astype(np.int64) for c in ("rest", "once", "twice", "more", "kinds")]
    kinds, rows = sums[-1], []
    for i in range(asked.num_rows):
        own = word[cut[i] : cut[i + 1]]
        stats = [int(kinds.sum()), int((kinds > 0).sum()), *(int((kinds == k).sum()) for k in range(1, 5))] if i == 0 else [0] * 6
        rows.append([asked.column("block")[i].as_py(), asked.column("shard")[i].as_py(), *(_packed(x[own]) for x in sums), *stats])
    return _rows(rows, WORTH)


def _off(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _score(d3: tuple, d2: tuple, d1: tuple, total: int, spread: float):
    """(doc_id, lang, n_words, perplexity) of a block's documents, from the counts that the shards told it."""

    def score(rows: pa.Table, trained: pa.Table) -> pa.Table:
        b = _Block(_answers(rows, 0), trained)
        kinds, all3, once, twice, more, seen = _joined(_answers(rows, 1), ["kinds", "rest", "once", "twice", "more", "seen"])
        all2, once2, twice2, more2, ends = _joined(_answers(rows, 2), ["rest", "once", "twice", "more", "kinds"])
        all3, all2 = all3 + once + 2 * twice + 3 * more, all2 + once2 + 2 * twice2 + 3 * more2
        mean = np.full(len(b.ids), np.nan)
        if len(b.hashes):
            words = b.words()
            left, right = np.searchsorted(words, b.left), np.searchsorted(words, b.right)
            left[b.pairs == FIRST[0]] = right[b.pairs == FIRST[0]] = 0  # never the last word's pair
            share = lambda n, d, of: np.divide(n - _off(n, d), of, out=np.zeros(len(n)), where=n > 0)
            weight = lambda a, x, y, z, d: np.divide(d[0] * x + d[1] * y + d[2] * z, a, out=np.ones(len(a)), where=a > 0)
            low = share(ends, d1, max(1, total)) + spread
            pair = share(kinds, d2, all2[left]) + weight(all2, once2, twice2, more2, d2)[left] * low[right]
            third = share(seen, d3, all3[(b.follows >> NEXT_BITS).astype(np.int64)])
            logs = np.log(third[b.follow] + weight(all3, once, twice, more, d3)[b.before] * pair[b.pair])
            mean = np.divide(np.bincount(np.repeat(np.arange(len(b.ids)), b.n_words), logs, len(b.ids)), b.n_words, out=mean, where=b.n_words > 0)
        found = pa.array(np.exp(-mean), mask=b.n_words == 0)
        return pa.table([pa.array(b.ids, pa.int64()), pa.array(b.langs, pa.string()), pa.array(b.n_words, pa.int64()), found], names=["doc_id", "lang", "n_words", "perplexity"])

    return score


def perplexities(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, perplexity) of every document, under the model of those that ``training`` (doc_id) names.

    Documents are dealt into blocks, n-grams into shards, both as many as the texts need. Each block asks the shards for
    its distinct pairs of words and what follows them, along with what it has learnt; each shard sums up all blocks
    and tells each one the counts of what it asked for, in the order asked; then the same for words.
    """
    spark = docs.sparkSession
    tk.small_batches(spark)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = shards = max(PARTS, -(-size // BLOCK_CHARS))
    texts = _dealt(docs, blocks)
    ids = training.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id").groupBy("block")
    held = staged(texts.groupBy("block").cogroup(ids).applyInArrow(_gathered, HELD), "blocks", tidy=True)
    told = [staged(held.mapInArrow(_ask(shards, part), ASKED).groupBy("shard").applyInArrow(_tell, TOLD), "pairs", tidy=True) for part in range(PARTS)]
    told = reduce(DataFrame.unionByName, told)
    emptied(held)
    base = texts.withColumn("what", F.lit(0))
    both = base.unionByName(told.select("block", "shard", "kinds", "owned", F.lit(1).alias("what")), allowMissingColumns=True)
    worth = staged(both.groupBy("block").cogroup(ids).applyInArrow(_ask_words(shards), WORDS).groupBy("shard").applyInArrow(_tell_words, WORTH), "words", tidy=True)
    sums = lambda rows, *names: [x or 0 for x in rows.agg(*(F.sum(n) for n in names)).first()]
    stats = sums(told, *(f"{o}{n}" for o in "tp" for n in range(1, 5)))
    total, words, *ones = sums(worth, "total", "words", *(f"w{n}" for n in range(1, 5)))
    d3, d2, d1 = (_discount_values(dict(enumerate(x, 1))) for x in (stats[:4], stats[4:], ones))
    freed = ones[0] * d1[0] + ones[1] * d1[1] + (words - ones[0] - ones[1]) * d1[2]
    spread = max(freed / max(1, total), 1e-6) / (words + 1) if words else 1.0
    known = told.select("block", "shard", "kinds", "rest", "once", "twice", "more", "seen", F.lit(1).alias("what"))
    known = known.unionByName(worth.select("block", "shard", "kinds", "rest", "once", "twice", "more", F.lit(2).alias("what")), allowMissingColumns=True)
    rows = base.unionByName(known, allowMissingColumns=True)
    return rows.groupBy("block").cogroup(ids).applyInArrow(_score(d3, d2, d1, total, spread), "doc_id long, lang string, n_words long, perplexity double")


def quality_by_perplexity(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept); ``trusted_ids`` (doc_id) names the trusted documents."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS))
    trusted = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    scored = staged(perplexities(docs, trusted.where(fold != 0)), "perplexities", tidy=True)
    back = scored.where("n_words >= " + str(MIN_WORDS)).join(trusted.where(fold == 0), "doc_id", "left_semi")
    cut = (F.percentile_approx("perplexity", QUANTILE, 10_000) * SLACK).alias("own")
    by_lang = back.groupBy("lang").agg(cut, F.count("*").alias("k")).where(F.col("k") >= MIN_HELD_OUT).select("lang", "own")
    whole = back.agg(cut).first()[0]
    limit = F.coalesce("own", F.lit(whole).cast("double"))
    out = scored.join(F.broadcast(by_lang), "lang", "left").withColumn("threshold", limit)
    kept = (F.col("n_words") < MIN_WORDS) | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", kept.alias("kept"))


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality_by_perplexity(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"))
