"""Quality rules: repetition counts, and how far a document's profile lies from its language's.

Method. Each language has two reference histograms over all of its documents: shares
of character classes, and shares of its common words (those making up at least
COMMON_SHARE of its words) with one bin for the rest. A document is compared with
both by the Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1),
but only if it has enough words for its own histogram to mean something. It is
rejected if a distance passes its limit, or by the base rules on length and repeats.

Common words are found exactly: first words are counted by hash bucket, and only words
of buckets with that share of the language, which each common word's bucket has, are
then counted by themselves. References go to the tasks: a few hundred numbers for
each language.

Defined cases. Null or wordless text: all counts 0, rejected for length. Null language:
a language of its own. A language with fewer than MIN_REFERENCE_WORDS words overall,
or a document shorter than the guards: no distance (null), base rules alone decide.
Repeated rows each give their own result; an empty table gives an empty result; extra
columns pass through ``keep_good`` and are otherwise ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.llm import textkernel as tk
from genomeloom.sources.shared import table

COMMON_SHARE = 0.002
MIN_WORDS, CHAR_GUARD_WORDS, WORD_GUARD_WORDS = 50, 50, 100
MIN_REFERENCE_WORDS = 1000
BUCKETS = 4096
#: A text of n words drawn from the reference itself lies some sqrt(bins / (8 ln 2 n)) from it; the limit never goes below NOISE times that.
CHAR_LIMIT, WORD_LIMIT, NOISE = 0.30, 0.38, 1.1
#: Character classes; bytes that continue a UTF-8 character have none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "bracket", "symbol", "control", "latin", "other")
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class number of every byte; len(CLASSES) for continuation bytes."""
    of = np.full(256, CLASSES.index("symbol"), np.uint8)
    of[:32] = of[127] = CLASSES.index("control")
    for name, span in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 10, 11, 12, 13, 32)), ("stop", b".,;:!?'\"-"), ("bracket", b"()[]{}"), ("latin", range(0xC2, 0xC6)), ("other", range(0xC6, 256))):
        of[list(span)] = CLASSES.index(name)
    of[128:192] = len(CLASSES)
    return of


CLASS_OF = _class_table()
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def _class_counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = len(CLASSES) + 1
    cell = np.repeat(np.arange(len(rows) - 1) * n, np.diff(rows)) + CLASS_OF[data]
    return np.bincount(cell, minlength=(len(rows) - 1) * n).reshape(-1, n)[:, :-1]


def _dup_lines(data: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    breaks = np.flatnonzero(data == 10)
    # a line begins at each row's start and after each break; it ends at the next break or at the row's end
    begin = np.concatenate([rows[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(rows) - 1), np.searchsorted(rows, breaks, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], rows[row + 1])
    full = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, row = begin[full], stop[full], row[full]
    name = tk.span_hashes(data, begin, stop)
    order = np.lexsort((name, row))
    same = (row[order][1:] == row[order][:-1]) & (name[order][1:] == name[order][:-1])
    return np.bincount(row[order][1:][same], minlength=len(rows) - 1)


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words standing in a 3-word window that its row holds twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    grams = tk.gram_hashes(hashes, 3)
    for r in range(len(out)):
        a, b = int(first[r]), int(first[r + 1])
        if b - a < 4:
            continue
        own = grams[a : b - 2]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            many = np.isin(own, twice)
            cover = np.zeros(b - a, bool)
            for k in range(3):
                cover[k : k + len(many)] |= many
            out[r] = cover.sum()
    return out


def _languages(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("lang").to_pylist()]


def _profile(docs: DataFrame) -> dict[str, np.ndarray]:
    """language: counts of classes, then of word-hash buckets, over all of its documents."""
    width = len(CLASSES) + BUCKETS

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = _languages(batch)
            for lo, hi, data, rows in tk.slices(batch.column("text")):
                classes = _class_counts(data, rows)
                hashes, first = tk.word_hashes(tk.LOWER[data], rows)
                of = np.repeat(np.array(langs[lo:hi], object), np.diff(first))
                for lang in set(langs[lo:hi]):
                    sums = total.setdefault(lang, np.zeros(width, np.int64))
                    sums[: len(CLASSES)] += classes[np.array([x == lang for x in langs[lo:hi]])].sum(axis=0)
                    sums[len(CLASSES) :] += np.bincount((hashes[of == lang] % tk.U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        for lang, sums in total.items():
            yield pa.record_batch([pa.array([lang] * width, pa.string()), pa.array(np.arange(width), pa.int32()), pa.array(sums)], names=["lang", "slot", "n"])

    out: dict[str, np.ndarray] = {}
    for row in docs.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out.setdefault(row["lang"], np.zeros(width, np.int64))[row["slot"]] = row["n"]
    return out


def _common_words(docs: DataFrame, profile: dict[str, np.ndarray]) -> DataFrame:
    """(lang, word hash, n) of each word with COMMON_SHARE of its language."""
    heavy = {lang: x[len(CLASSES) :] >= COMMON_SHARE * max(1, x[len(CLASSES) :].sum()) for lang, x in profile.items()}

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs = _languages(batch)
            for lo, hi, data, rows in tk.slices(batch.column("text")):
                hashes, first = tk.word_hashes(tk.LOWER[data], rows)
                of = np.repeat(np.array(langs[lo:hi], object), np.diff(first))
                for lang in set(langs[lo:hi]):
                    own = hashes[of == lang]
                    held.setdefault(lang, []).append(np.unique(own[heavy[lang][(own % tk.U(BUCKETS)).astype(np.int64)]], return_counts=True))
                    if len(held[lang]) == 32:
                        held[lang] = [_summed(held[lang])]
        for lang, parts in held.items():
            words, n = _summed(parts)
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words.view(np.int64)), pa.array(n)], names=["lang", "word", "n"])

    least = docs.sparkSession.createDataFrame([(lang, float(COMMON_SHARE * x[len(CLASSES) :].sum())) for lang, x in profile.items()] or [("", 1.0)], "lang string, least double")
    sums = docs.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return sums.join(F.broadcast(least), "lang").where("n >= least").select("lang", "word", "n")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (words, counts) table out of several."""
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    n = np.zeros(len(words), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return words, n


def language_references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """language: (shares of classes, hashes of its common words, their shares and the rest's), from all ``docs`` (lang, text)."""
    plain = docs.select(F.col("lang").cast("string"), "text")
    profile = _profile(plain)
    words: dict[str, dict[int, int]] = {}
    for row in _common_words(plain, profile).toLocalIterator():
        words.setdefault(row["lang"], {})[row["word"] % (1 << 64)] = row["n"]
    out = {}
    for lang, counts in profile.items():
        chars, total = counts[: len(CLASSES)], int(counts[len(CLASSES) :].sum())
        if total >= MIN_REFERENCE_WORDS:
            own = words.get(lang, {})
            known = np.array(sorted(own), np.uint64)
            n = np.array([own[int(w)] for w in known], np.float64)
            out[lang] = (chars / chars.sum(), known, np.append(n, total - n.sum()) / total)
    return out


def _word_counts(own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How often each known word occurs, and then how many words are none of them."""
    if not len(known):
        return np.array([len(own)])
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    at[known[at] != own] = len(known)
    return np.bincount(at, minlength=len(known) + 1)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    p = counts / counts.sum()
    m = (p + reference) / 2
    entropy = lambda x: -float(np.sum(x[x > 0] * np.log2(x[x > 0])))
    return float(np.sqrt(max(0.0, entropy(m) - (entropy(p) + entropy(reference)) / 2)))


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


def _measure(texts: pa.Array, langs: list[str], references: dict) -> list[pa.Array]:
    found: list[list[np.ndarray]] = []
    for lo, hi, data, rows in tk.slices(texts):
        start, end, first = tk.words(data, rows)
        hashes = tk.span_hashes(tk.LOWER[data], start, end)
        plain = tk.span_hashes(data, start, end)
        classes = _class_counts(data, rows)
        n = np.diff(first)
        chars = classes.sum(axis=1) - classes[:, CLASSES.index("space")]
        repeats = _repeat_words(plain, first)
        far, noise = np.full((hi - lo, 2), np.nan), np.zeros(hi - lo)
        for r in range(hi - lo):
            if (ref := references.get(langs[lo + r])) is not None:
                if n[r] >= CHAR_GUARD_WORDS:
                    far[r, 0] = js_distance(classes[r], ref[0])
                if n[r] >= WORD_GUARD_WORDS:
                    far[r, 1] = js_distance(_word_counts(hashes[first[r] : first[r + 1]], ref[1]), ref[2])
                    noise[r] = np.sqrt(len(ref[2]) / (8 * np.log(2) * n[r]))
        failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
        kept = ~failed & ~(far[:, 0] > CHAR_LIMIT) & ~(far[:, 1] > np.maximum(WORD_LIMIT, NOISE * noise))
        found.append([n, chars, _per_row(IS_SYMBOL[data], rows), _dup_lines(data, rows, start), repeats, far[:, 0], far[:, 1], failed, kept])
    types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
    return [pa.array(np.concatenate(c), t, from_pandas=True) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], t) for t in types]


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of each document of ``docs`` (doc_id, text, lang)."""
    tk.small_batches(docs.sparkSession)
    references = language_references(docs)

    def rows(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), *_measure(batch.column("text"), _languages(batch), references)], names=["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).mapInArrow(rows, f"doc_id long, {FIELDS}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, all their columns unchanged."""
    tk.small_batches(docs.sparkSession)
    references = language_references(docs)
    at = {name: docs.columns.index(name) for name in ("text", "lang")}

    def rows(batches):
        for batch in batches:
            langs = [x or "" for x in batch.column(at["lang"]).to_pylist()]
            yield batch.filter(_measure(batch.column(at["text"]), langs, references)[-1])

    return docs.mapInArrow(rows, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
