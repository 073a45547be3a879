"""Mixing to target weights with soft membership.

Method. A naive Bayes classifier over hashed words, fitted on a labelled table, gives
every document posterior shares p over the domains. Rates r >= 0 are then fitted by
projected gradient least squares, so that the expected tokens of each domain, the sum
of r * tokens * p, meet its target. The gradient of a rate depends on the documents
only through one residual a domain; every round is one distributed sum of K residuals
and of the K x K curvature of the documents whose rate is not at zero, which scales
the step. Rates are not stored between rounds: a document's rate follows from its p
and the rounds' steps, a list of K-vectors that goes to the tasks.

Targets. ``weights`` gives the wanted shares (scaled to sum to 1; a domain not named
keeps its present share of what remains). Unless ``total`` is set, documents are repeated
and never lost: rates are 1 at least, and the total is HEADROOM times the smallest at
which no domain has to be thinned, which leaves room for documents of several domains. With
``total`` set, rates may fall to 0. No rate passes MAX_RATE. Rates begin at the mean rate
that a document's domains need, and the steps are damped (RIDGE), so that directions in which
the documents hardly differ move no rate far. Targets that these bounds put out of reach are
met as nearly as they allow, and ``mixture_report`` names them.
``copies`` rounds the rate up or down by a hash of doc_id, with the rate as its mean.

Bounds. The classifier is fitted on at most LABELLED_ROWS labelled documents, the first
by a hash of doc_id, whole texts. Posteriors, totals and rates cover every document.

Defined cases. Null or wordless texts: 0 tokens, posterior equal to the classes' shares.
Unlabelled or null-labelled rows train nothing; without any labels there is one domain
named "all". Repeated rows each get the same rate. Empty table: empty result. Existing
columns named like the new ones are replaced by them; others pass through ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomeloom.llm import textkernel as tk
from genomeloom.sources.shared import staged, table

BUCKETS = 1 << 15
LABELLED_ROWS = 20_000
#: Mean log-likelihoods count as those of a text of at most so many words, so that long texts keep some doubt.
NOMINAL_WORDS = 12
ROUNDS, TOLERANCE, RIDGE = 40, 1e-6, 1e-3
HEADROOM, MAX_RATE = 1.25, 50.0
#: A target counts as reached within this share of all tokens asked for.
REACHED = 1e-3
#: The mixture of the registered query and of the pipeline.
WEIGHTS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


@dataclass
class Mixer:
    """A fitted classifier and, once solved, the steps that make up each rate."""

    domains: list[str]
    prior: np.ndarray
    loglik: np.ndarray
    #: The rate of each domain alone, the least rate of a document, and the rounds' steps.
    means: np.ndarray | None = None
    least: float = 0.0
    steps: list[np.ndarray] = field(default_factory=list)
    #: For each domain: its tokens, what is asked for, what the rates give.
    report: list[tuple[str, float, float, float]] = field(default_factory=list)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, posterior shares) of each text."""
        sizes, shares = [np.zeros(0, np.int64)], [np.zeros((0, len(self.domains)))]
        for _, _, data, rows in tk.slices(texts):
            hashes, first = tk.word_hashes(tk.LOWER[data], rows)
            sums = np.zeros((len(hashes) + 1, len(self.domains)))
            np.cumsum(self.loglik[(hashes % tk.U(BUCKETS)).astype(np.int64)], axis=0, out=sums[1:])
            n = np.diff(first)
            score = np.log(self.prior) + (sums[first[1:]] - sums[first[:-1]]) * (np.minimum(n, NOMINAL_WORDS) / np.maximum(n, 1))[:, None]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            sizes.append(n)
            shares.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(sizes), np.concatenate(shares)

    def rates(self, p: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.ones(len(p))
        r = np.clip(p @ self.means, self.least, MAX_RATE)
        for step in self.steps:
            r = np.clip(r - p @ step, self.least, MAX_RATE)
        return r

    def free(self, r: np.ndarray) -> np.ndarray:
        """Rates that a small step can change in both directions."""
        return (r > self.least) & (r < MAX_RATE)


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Mixer:
    """Counts of hashed words by domain over the labelled documents (labels: doc_id, domain)."""
    tk.small_batches(docs.sparkSession)
    asked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    some = asked.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("domain", "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, rows in tk.slices(batch.column(1)):
                hashes, first = tk.word_hashes(tk.LOWER[data], rows)
                cells = (hashes % tk.U(BUCKETS)).astype(np.int64)
                for r in range(hi - lo):
                    mine = held.setdefault(names[lo + r], np.zeros(BUCKETS + 1, np.int64))
                    np.add.at(mine, cells[first[r] : first[r + 1]], 1)
                    mine[BUCKETS] += 1
        for name, n in held.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["domain", "bucket", "n"])

    found: dict[str, np.ndarray] = {}
    for row in own.mapInArrow(count, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        found.setdefault(row["domain"], np.zeros(BUCKETS + 1))[row["bucket"]] = row["n"]
    domains = sorted(found) or ["all"]
    counts = np.array([found.get(d, np.ones(BUCKETS + 1)) for d in domains])
    words = counts[:, :BUCKETS] + 0.1
    return Mixer(domains, counts[:, BUCKETS] / counts[:, BUCKETS].sum(), np.log(words / words.sum(axis=1, keepdims=True)).T.copy())


def _totals(posts: DataFrame, mixer: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """Over all documents: rate * tokens * p, and the sum of tokens * p p' where the rate is within its bounds."""
    k = len(mixer.domains)

    def add(batches):
        sums = np.zeros(k + k * k)
        for batch in batches:
            t = batch.column(0).to_numpy()
            p = batch.column(1).values.to_numpy().reshape(-1, k) if len(t) else np.zeros((0, k))
            r = mixer.rates(p)
            sums[:k] += (r * t) @ p
            sums[k:] += ((t * mixer.free(r))[:, None] * p).T.dot(p).ravel()
        yield pa.record_batch([pa.array(np.arange(len(sums))), pa.array(sums)], names=["cell", "x"])

    out = np.zeros(k + k * k)
    for row in posts.select("n_tokens", "posteriors").mapInArrow(add, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toLocalIterator():
        out[row["cell"]] = row["x"]
    return out[:k], out[k:].reshape(k, k)


def solve(posts: DataFrame, mixer: Mixer, weights: dict[str, float] | None, total: float | None = None) -> np.ndarray:
    """Set the mixer's rates by projected gradient steps; returns the targets."""
    mixer.steps, mixer.means = [], None
    held, curve = _totals(posts, mixer)
    all_tokens = held.sum()
    if not all_tokens:
        return held
    share = held / all_tokens
    asked = np.array([(weights or {}).get(d, np.nan) for d in mixer.domains])
    rest = np.isnan(asked)
    left = max(0.0, 1 - asked[~rest].sum()) if (~rest).any() else 1.0
    want = np.where(rest, share / max(share[rest].sum(), 1e-12) * left, np.nan_to_num(asked)) if rest.any() else asked
    want = want / want.sum()
    mixer.least = 1.0 if total is None else 0.0
    if total is None:
        total = HEADROOM * float(np.max(held[want > 0] / want[want > 0]))
    target = want * total
    mixer.means = target / np.maximum(held, 1e-9)
    now, curve = _totals(posts, mixer)
    scale = 1.0
    for _ in range(ROUNDS):
        residual = now - target
        if np.abs(residual).max() <= TOLERANCE * total or scale < 1e-3:
            break
        damped = curve + RIDGE * max(np.trace(curve) / len(held), 1e-6 * all_tokens) * np.eye(len(held))
        mixer.steps.append(scale * np.linalg.solve(damped, residual))
        new, bend = _totals(posts, mixer)
        if np.linalg.norm(new - target) < np.linalg.norm(residual):
            now, curve, scale = new, bend, min(1.0, 2 * scale)
        else:  # too far: try a shorter step
            mixer.steps.pop()
            scale /= 4
    mixer.report = list(zip(mixer.domains, held.tolist(), target.tolist(), now.tolist(), strict=True))
    return target


def mixture_report(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None, total: float | None = None) -> DataFrame:
    """(domain, tokens, target_tokens, expected_tokens, reached) of every domain; reached is false where the bounds on rates keep a target out of reach."""
    mixer = fit_classifier(docs, labels)
    solve(_posts(docs, mixer), mixer, weights, total)
    asked = sum(x[2] for x in mixer.report)
    rows = [(*x, abs(x[3] - x[2]) <= REACHED * asked) for x in mixer.report]
    return docs.sparkSession.createDataFrame(rows, "domain string, tokens double, target_tokens double, expected_tokens double, reached boolean")


def _copies(rate: Column, doc_id: Column) -> Column:
    """The rate rounded down or up, by a hash of doc_id."""
    part = F.pmod(F.xxhash64(doc_id, F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _posts(docs: DataFrame, mixer: Mixer) -> DataFrame:
    def rows(batches):
        for batch in batches:
            n, p = mixer.posteriors(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(n), tk.list_array(p.ravel(), [p.shape[1]] * len(n), pa.float64())], names=["doc_id", "n_tokens", "posteriors"])

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_tokens long, posteriors array<double>"), "posteriors")


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None, total: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, domain, posteriors, rate, copies) of every document."""
    mixer = fit_classifier(docs, labels)
    posts = _posts(docs, mixer)
    solve(posts, mixer, weights, total)
    k = len(mixer.domains)

    def rate(batches):
        for batch in batches:
            p = batch.column(2).values.to_numpy().reshape(-1, k) if batch.num_rows else np.zeros((0, k))
            best = pa.array([mixer.domains[i] for i in p.argmax(axis=1)], pa.string())
            yield pa.record_batch([*batch.columns[:2], best, batch.column(2), pa.array(mixer.rates(p))], names=["doc_id", "n_tokens", "domain", "posteriors", "rate"])

    out = posts.mapInArrow(rate, "doc_id long, n_tokens long, domain string, posteriors array<double>, rate double")
    return out.withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None, total: float | None = None) -> DataFrame:
    """``docs`` with mix_rate and mix_copies; rows that get no copy go."""
    mixer = fit_classifier(docs, labels)
    solve(_posts(docs, mixer), mixer, weights, total)
    plain = docs.drop("mix_rate", "mix_copies")
    at = plain.columns.index("text")

    def rate(batches):
        for batch in batches:
            yield batch.append_column("mix_rate", pa.array(mixer.rates(mixer.posteriors(batch.column(at))[1])))

    out = plain.mapInArrow(rate, T.StructType([*plain.schema.fields, T.StructField("mix_rate", T.DoubleType())]))
    return out.withColumn("mix_copies", _copies(F.col("mix_rate"), F.col("doc_id"))).where("mix_copies > 0")


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labelled table covers."""
    named = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("domain"))
    return named.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return document_rates(docs, language_labels(docs, table(spark, sf_dir, "labels")), WEIGHTS)
