"""Toxicity by a convolutional text classifier.

Method. Words are hashed to BUCKETS embeddings; filters of several widths slide over
them, their maxima over the text are the features of a logistic output. Training is
numpy inside tasks: Adam on logistic loss with balanced classes, gradients flowing through the
maxima, so a step touches one window a filter and text. A filter's response is a sum
of one table entry for each of its words, so scoring needs no embeddings: for each
offset a row of the table product is looked up and added, and maxima are taken per
text. The raw output is calibrated on training folds (Platt), so that a score is a
probability; for each language a threshold is then chosen on the same held-back part
of the training rows. ``predicted`` uses the fixed limit of the contract and
``flagged`` the language's threshold.

Learns from all labelled rows and the whole of their texts: these are dealt into shards of
about SHARD_ROWS by a hash of doc_id, each shard's task moves a copy of the network on, and
the copies are averaged after each epoch. The curve and the thresholds are fitted over all
held-back rows by sums and ranks that Spark makes. The driver holds the network only. Scores
cover every word of every text. Labels, language, source and doc_id are no input of a score.

Defined cases. Null or wordless text: the score of no evidence (all maxima 0). Texts
shorter than a filter are padded with an empty word of zero embedding. Repeated rows
score alike; rows of null label train nothing; without both labels the score is the
share of label 1, or 0. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.llm import textkernel as tk
from genomeloom.operators.presence import numbered
from genomeloom.sources.shared import staged, table

BUCKETS, SIZE, WIDTHS, FILTERS, SEED = 1 << 15, 16, (1, 2, 3), 8, 41
EPOCHS, BATCH, RATE, DECAY, WORD_DROPOUT = 8, 32, 0.01, 2e-3, 0.4
#: Words in fewer of the training texts have no embedding; they could only be learnt by heart.
LEAST_SHARE = 0.002
#: Rows of a shard; bytes of its texts that a task holds at a time; values of the network that are averaged in one group.
SHARD_ROWS, HELD_BYTES, PIECE = 8_000, 48 << 20, 1 << 13
#: Place of each filter's offset in the filters of all widths.
SLOTS = [(k, offset) for k, width in enumerate(WIDTHS) for offset in range(width)]
#: Steps that a shard takes between two averages if it can: few rows are gone over more than once, at most PASSES times.
LEAST_STEPS, PASSES = 100, 4
BINS = 1 << 10
CUT = 0.3
MIN_LANGUAGE_ROWS = 20


def _ids(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (letters lower-cased, marks at the edges dropped where a word is left), first word of each row."""
    start, end, first = tk.words(data, rows)
    low = tk.LOWER[data]
    bare = np.isin(low, np.frombuffer(b".,;:!?*#%&$|\"'()", np.uint8))
    left, right = start.copy(), end.copy()
    for _ in range(4):
        move = (right - left > 1) & bare[np.minimum(right - 1, len(data) - 1)] if len(start) else np.zeros(0, bool)
        right[move] -= 1
        move = (right - left > 1) & bare[np.minimum(left, len(data) - 1)] if len(start) else np.zeros(0, bool)
        left[move] += 1
    return (tk.span_hashes(low, left, right) % tk.U(BUCKETS)).astype(np.int64), first


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    cuts: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def tables(self) -> list[np.ndarray]:
        """For each width, the response that each bucket adds at each offset; a last row of zeros for padding."""
        padded = np.vstack([self.embedding, np.zeros(SIZE, np.float32)])
        return [np.einsum("bs,wsf->wbf", padded, f).astype(np.float32) for f in self.filters]

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        n = len(first) - 1
        features = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        for k, width in enumerate(WIDTHS):
            for at in range(0, len(full), 256):
                some = full[at : at + 256]
                lo, hi = first[some[0]], first[some[-1] + 1]
                own = np.concatenate([ids[lo:hi], np.full(width - 1, BUCKETS)])
                row_end = np.repeat(first[some + 1] - lo, counts[some])
                place = np.arange(hi - lo)
                total = tables[k][0][own[: hi - lo]]
                for offset in range(1, width):
                    inside = place + offset < row_end
                    total = total + np.where(inside[:, None], tables[k][offset][own[offset : offset + hi - lo]], 0)
                best = np.maximum.reduceat(total, first[some] - lo, axis=0)
                features[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(0, best + self.bias[k * FILTERS : (k + 1) * FILTERS])
        return features @ self.output + self.shift

    def scores(self, ids: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(ids, first, tables).astype(np.float64) + b, -30, 30)))


def _fresh(rng: np.random.Generator, known: int) -> list[np.ndarray]:
    """Embeddings of the known words and of all others (a last row of zeros), filters of each offset, bias, output and shift, as they are before learning."""
    embedding = np.vstack([rng.normal(0, 0.05, (known, SIZE)), np.zeros(SIZE)])
    width = len(WIDTHS) * FILTERS
    return [x.astype(np.float32) for x in (embedding, rng.normal(0, 0.3, (len(SLOTS), SIZE, FILTERS)), np.zeros(width), rng.normal(0, 0.3, width), np.zeros(1))]


def _flat(state: list[list[np.ndarray]], step: float) -> np.ndarray:
    return np.concatenate([*(x.ravel() for held in state for x in held), [step]]).astype(np.float32)


def _unflat(flat: np.ndarray, known: int) -> tuple[list[list[np.ndarray]], float]:
    """(values, first moments and second moments of Adam; its steps)."""
    shapes = [x.shape for x in _fresh(np.random.default_rng(SEED), known)]
    ends = np.cumsum([0, *[int(np.prod(x)) for x in shapes] * 3])
    parts = [flat[lo:hi].reshape(x).copy() for lo, hi, x in zip(ends, ends[1:], shapes * 3, strict=False)]
    return [parts[k : k + len(shapes)] for k in range(0, len(parts), len(shapes))], float(flat[-1])


def _learn(state: list[list[np.ndarray]], step: float, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> float:
    """One pass of Adam over texts given as rows of the embedding, in random order; windows outside the maxima get no gradient. ``state`` changes; the steps so far are returned."""
    values, first, second = state
    embedding, filters, bias, output, shift = values
    order = rng.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        kept = [texts[i][rng.random(len(texts[i])) >= WORD_DROPOUT] for i in some]
        some, kept = some[[len(x) > 0 for x in kept]], [x for x in kept if len(x)]
        grads = [np.zeros_like(x) for x in values[1:]]
        touched, pull = np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)
        if kept:
            ids, sizes = np.concatenate(kept), np.array([len(x) for x in kept])
            ends = np.cumsum(sizes)
            starts, end_of = ends - sizes, np.repeat(ends, sizes)
            place, vectors = np.arange(len(ids)), embedding[ids]
            total = np.zeros((len(ids), len(bias)), np.float32)
            for s, (k, offset) in enumerate(SLOTS):
                inside = (place[: len(ids) - offset] + offset < end_of[: len(ids) - offset])[:, None]
                total[: len(ids) - offset, k * FILTERS : (k + 1) * FILTERS] += np.where(inside, vectors[offset:] @ filters[s], 0)
            best = np.maximum.reduceat(total, starts, axis=0)
            where = np.minimum.reduceat(np.where(total == np.repeat(best, sizes, axis=0), place[:, None], len(ids)), starts, axis=0)
            hidden = np.maximum(0, best + bias)
            p = 1 / (1 + np.exp(-np.clip(hidden @ output + shift[0], -30, 30)))
            error = (weights[labels[some]] * (p - labels[some]) / BATCH).astype(np.float32)
            back = error[:, None] * output * (hidden > 0)
            grads[1], grads[2], grads[3] = back.sum(axis=0), error @ hidden, error.sum(keepdims=True)
            found, pulls = [], []
            for s, (k, offset) in enumerate(SLOTS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                to = where[:, k * FILTERS : (k + 1) * FILTERS] + offset
                own = np.where(to < ends[:, None], own, 0)
                to = np.minimum(to, len(ids) - 1)
                grads[0][s] = np.einsum("bf,bfs->sf", own, vectors[to])
                live = own != 0
                found.append(ids[to[live]])
                pulls.append((own[..., None] * filters[s].T)[live])
            touched, inverse = np.unique(np.concatenate(found), return_inverse=True)
            pull = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(pull, inverse, np.concatenate(pulls))
            pull = (pull + DECAY * embedding[touched]) * (touched < len(embedding) - 1)[:, None]
        step += 1
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        for n, g in enumerate(grads, 1):
            g = g if n == 4 else g + DECAY * values[n]
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.001 * (g * g - second[n])
            values[n] -= RATE * (first[n] / fix1) / (np.sqrt(second[n] / fix2) + 1e-8)
        if len(touched):
            first[0][touched] += 0.1 * (pull - first[0][touched])
            second[0][touched] += 0.001 * (pull * pull - second[0][touched])
            embedding[touched] -= RATE * (first[0][touched] / fix1) / (np.sqrt(second[0][touched] / fix2) + 1e-8)
    return step


def train(rows: DataFrame, weights: np.ndarray) -> Network:
    """A network from all ``rows`` (shard, toxic, ids): in each epoch every shard moves its own copy on, text by text, and the copies are averaged, each by its rows.

    A task holds the sum of its copies, one copy and HELD_BYTES of texts; what a shard has beyond that is learnt after them.
    """

    def holders(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen[np.unique(np.frombuffer(x.as_py(), np.uint16))] += 1
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found), pa.array(seen[found])], names=["bucket", "n"])

    n_rows, shards = rows.agg(F.count("*"), F.countDistinct("shard")).first()
    passes = min(PASSES, -(-LEAST_STEPS * BATCH * shards // n_rows))
    least = max(3, LEAST_SHARE * n_rows)
    seen = rows.select("ids").mapInArrow(holders, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    known = np.sort(np.array([r["bucket"] for r in seen.collect()], np.int64))
    place = np.full(BUCKETS, len(known))
    place[known] = np.arange(len(known))
    values = _fresh(np.random.default_rng(SEED), len(known))
    flat = _flat([values, *([np.zeros_like(x) for x in values] for _ in range(2))], 0)

    def copies(epoch, flat):
        def run(batches):
            shard, state, step, texts, labels, size, n = None, None, 0.0, [], [], 0, 0
            total, rows = np.zeros(len(flat)), 0

            def learnt():
                rng, at = np.random.default_rng([SEED, epoch, shard, n]), step
                for _ in range(passes):
                    at = _learn(state, at, texts, np.array(labels), weights, rng)
                return at

            for batch in batches:
                for own, toxic, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if own != shard or size >= HELD_BYTES:
                        if texts:
                            step = learnt()
                        texts, labels, size = [], [], 0
                        if own != shard:
                            if shard is not None:
                                total += n * _flat(state, step).astype(np.float64)
                            (state, step), shard, n = _unflat(flat, len(known)), own, 0
                    texts.append(place[np.frombuffer(ids.as_py(), np.uint16)])
                    labels.append(toxic)
                    size += texts[-1].nbytes
                    n, rows = n + 1, rows + 1
            if texts:
                step = learnt()
                total += n * _flat(state, step).astype(np.float64)
                cut = [total[k : k + PIECE].tobytes() for k in range(0, len(total), PIECE)]
                yield pa.record_batch([pa.array(range(len(cut)), pa.int32()), pa.array([rows] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["piece", "n", "held"])

        return run

    def mean(table):
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("held"))
        held = (total / table.column("n").to_numpy().sum()).astype(np.float32)
        return pa.table([table.column("piece").slice(0, 1), pa.array([held.tobytes()], pa.binary())], names=["piece", "held"])

    for epoch in range(EPOCHS):
        told = rows.select("shard", "toxic", "ids").mapInArrow(copies(epoch, flat), "piece int, n long, held binary")
        pieces = staged(told.groupBy("piece").applyInArrow(mean, "piece int, held binary"), "copies", tidy=True).collect()
        flat = np.concatenate([np.frombuffer(r["held"], np.float32) for r in sorted(pieces, key=lambda r: r["piece"])])
    (embedding, filters, bias, output, shift), *_ = _unflat(flat, len(known))[0]
    whole = np.zeros((BUCKETS, SIZE), np.float32)
    whole[known] = embedding[:-1]
    return Network(whole, [filters[[s for s, (k, _) in enumerate(SLOTS) if k == own]] for own in range(len(WIDTHS))], bias, output, float(shift[0]))


def _platt(rows: DataFrame) -> tuple[float, float]:
    """Scale and shift of the logistic curve that fit ``rows`` (logit, toxic) best, by Newton steps on smoothed targets; each step is summed over all rows."""
    n, n1 = rows.agg(F.count("*"), F.sum("toxic")).first()
    x, target = F.col("logit"), F.when(F.col("toxic") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2))
    w = np.array([1.0, np.log((n1 + 1) / (n - n1 + 1))])
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * float(w[0]) + float(w[1])))))
        steep = p * (1 - p) + 1e-6
        a, b, c, d, e = rows.agg(F.sum(steep * x * x), F.sum(steep * x), F.sum(steep), F.sum((p - target) * x), F.sum(p - target)).first()
        move = 0.7 * np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-6 * np.eye(2), np.array([d, e]))
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _cuts(rows: DataFrame) -> dict[str, float]:
    """For each language of ``rows`` (lang, score, toxic), and for all under the empty one, the middle between two neighbouring scores that gives the best F1; CUT where there are few rows or one label.

    Equal scores are counted together; a language's scores are ranked bin by bin, so no task ranks them all.
    """
    each = rows.select(F.explode(F.array_distinct(F.array(F.lit(""), "lang"))).alias("lang"), "score", "toxic")
    runs = staged(each.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).withColumn("bin", F.floor(F.col("score") * BINS)), "scores")
    bins = runs.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    lang = W.partitionBy("lang")
    above = lang.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    before = bins.select("lang", "bin", *((F.sum(c).over(above) - F.col(c)).alias(f"{c}_before") for c in ("n", "hits")), *(F.sum(c).over(lang).alias(f"{c}_all") for c in ("n", "hits")))
    so_far = W.partitionBy("lang", "bin").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    ranked = runs.join(before, ["lang", "bin"]).withColumns({c: F.sum(c).over(so_far) + F.col(f"{c}_before") for c in ("n", "hits")})
    fit = ranked.where((F.col("n_all") >= MIN_LANGUAGE_ROWS) & (F.col("hits_all") > 0) & (F.col("hits_all") < F.col("n_all")))
    best = fit.groupBy("lang").agg(F.max(F.struct((2 * F.col("hits") / (F.col("n") + F.col("hits_all"))).alias("f1"), "score")).alias("m")).select("lang", F.col("m.score").alias("top"))
    cuts = runs.join(best, "lang", "left").groupBy("lang").agg(F.first("top").alias("top"), F.max(F.when(F.col("score") < F.col("top"), F.col("score"))).alias("next"))
    return {r["lang"]: CUT if r["top"] is None else (r["top"] + (r["top"] if r["next"] is None else r["next"])) / 2 for r in cuts.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from all rows of ``labels`` (doc_id, toxic) whose document there is; of unequal labels of a document, 1 counts."""
    asked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    numbers = numbered(asked.join(own, "doc_id", "left_semi"), "n", F.xxhash64("doc_id"), F.col("doc_id"))
    back = F.col("n") % 5 == 4
    kinds = {(r["back"], r["toxic"]): r["k"] for r in numbers.groupBy(back.alias("back"), "toxic").agg(F.count("*").alias("k")).collect()}
    total, ones = sum(kinds.values()), sum(k for (_, toxic), k in kinds.items() if toxic)
    if not 0 < ones < total or total < 10:
        return Network(np.zeros((BUCKETS, SIZE), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=ones / total if total else 0.0)
    apart = len(kinds) == 4
    n = [sum(k for (x, toxic), k in kinds.items() if toxic == t and not (apart and x)) for t in (0, 1)]
    shards = -(-sum(n) // SHARD_ROWS)

    def buckets(batches):
        for batch in batches:
            found = []
            for lo, hi, data, rows in tk.slices(batch.column(2)):
                ids, first = _ids(data, rows)
                found += [ids[first[r] : first[r + 1]].astype(np.uint16).tobytes() for r in range(hi - lo)]
            yield pa.record_batch([*batch.columns[:2], pa.array(found, pa.binary())], names=["doc_id", "lang", "ids"])

    # buckets are moved to the labels, not texts
    rows = own.mapInArrow(buckets, "doc_id long, lang string, ids binary").join(numbers, "doc_id").select("n", "lang", "toxic", "ids")
    dealt = rows.withColumn("shard", F.floor(F.col("n") * shards / total)).repartition(shards, "shard").sortWithinPartitions("shard", "n", F.xxhash64("ids"))
    rows = staged(dealt, "labelled", tidy=True)
    net = train(rows.where(~back) if apart else rows, np.array([sum(n) / 2 / k for k in n]))

    def logits(batches):
        tables = net.tables()
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(2)]
            found = net.logits(np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int64), np.cumsum([0, *map(len, ids)]), tables)
            yield pa.record_batch([*batch.columns[:2], pa.array(found.astype(np.float64))], names=["lang", "toxic", "logit"])

    held = (rows.where(back) if apart else rows).select("lang", "toxic", "ids").mapInArrow(logits, "lang string, toxic int, logit double")
    held = staged(held, "logits")
    net.scale = a, b = _platt(held)
    net.cuts = _cuts(held.select("lang", "toxic", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") * a + b))))).alias("score")))
    return net


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, flagged) of every document; flagged by its language's threshold."""

    def rows(batches):
        tables = net.tables() if net.constant is None else []
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, data, at in tk.slices(batch.column(2)):
                found.append(net.scores(*_ids(data, at), tables))
            score = np.concatenate(found)
            cuts = np.array([net.cuts.get(x or "", net.cuts.get("", CUT)) for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(score >= cuts)], names=["doc_id", "score", "flagged"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(rows, "doc_id long, score double, flagged boolean")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "flagged")
