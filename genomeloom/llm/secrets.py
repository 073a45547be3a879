"""Secrets: patterns propose findings, a random forest removes the false ones.

Method. Runs of MIN_CHARS or more key-like characters are candidates; signs such as = and :
end a run, so ``KEY=value`` gives its value. Features of each: length, transitions between
character classes, shares of digits and capitals, distinct characters, how much of its
letters dictionary words cover, whether it stands in or looks like a path, and the words
and signs next to it. A random forest trained on labelled findings scores every
candidate; those at THRESHOLD or more are secrets.

Labelled findings come as a table from the caller. The registered query has none, so
``label_findings`` labels what is certain: issued key formats, and values assigned to a
name like token or secret, are true; plain long words, fillers, paths without digits, and
digests and identifiers called so by the word before are false. The formats themselves are
no features, so the forest has to learn from the shape and the surroundings.

The dictionary is counted over all documents: the words that take the largest share of
the words of any language, by partial counts; only DICTIONARY_WORDS of them are collected.
All of it is SQL functions and the built-in forest; there is no Python on the executors.
Bounds: the forest is trained on at most LABELLED_ROWS findings, the first by a hash;
candidates come from every whole text.

Defined cases. Null text has no findings, null language is a language of its own. Without
both labels, only issued formats are secrets and the score is 1 or 0. Repeated rows give
repeated findings. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.sources.shared import staged, table

MIN_CHARS = 20
LABELLED_ROWS, DICTIONARY_WORDS = 20_000, 1_000
TREES, DEPTH, SEED, THRESHOLD = 24, 6, 17, 0.5
KEYLIKE = "A-Za-z0-9+/_.-"
CANDIDATE = rf"(?<![{KEYLIKE}])[{KEYLIKE}]{{{MIN_CHARS},}}+(?:={{1,2}}(?![{KEYLIKE}=]))?"
# Key formats as their issuers publish them.
FORMATS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35})$"
NAMED = r"(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|credential)[\"']?\s*[=:]\s*[\"']?$"
DIGEST = r"(?i)(sha[0-9]*|md5|commit|digest|checksum|etag|revision|uuid|guid)\W*$"
TRANSITIONS = {"lower_upper": "[a-z](?=[A-Z])", "upper_lower": "[A-Z](?=[a-z])", "letter_digit": "[A-Za-z](?=[0-9])", "digit_letter": "[0-9](?=[A-Za-z])", "signs": "[+/_.-]", "consonants": "(?i)[bcdfghjklmnpqrstvwxz](?=[bcdfghjklmnpqrstvwxz]{2})"}
FEATURES = (*TRANSITIONS, "size", "digits", "capitals", "distinct", "covered", "pathlike", "named", "assigned", "quoted", "digest")
FOUND = "array<struct<start:int,end:int,value:string,before:string>>"


def _found(text: Column) -> Column:
    """Candidates of a text with their place in code points and what stands before them."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(40)).alias("before"))
        return F.struct(F.coalesce(end, start).alias("pos"), F.when(x["value"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    pieces = F.arrays_zip(F.split(text, CANDIDATE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("value"))
    first = F.struct(F.lit(0).alias("pos"), F.array().cast(FOUND).alias("out"))
    folded = F.aggregate(pieces, first, step, lambda acc: acc["out"])
    return F.when(text.rlike(f"[{KEYLIKE}]{{{MIN_CHARS}}}"), folded).otherwise(F.array().cast(FOUND))


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, value, before, after) of every candidate."""
    found = docs.select("doc_id", "text", F.explode(_found(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.*", F.substring(F.col("text"), F.col("f.end") + 1, F.lit(10)).alias("after"))


def dictionary(docs: DataFrame) -> list[str]:
    """The DICTIONARY_WORDS words of four to twelve letters a-z with the largest share of a language's words, counted over all documents."""
    words = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    counts = staged(words.where(F.length("w").between(4, 12)).groupBy("lang", "w").agg(F.count("*").alias("n")), "words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counts.join(total, "lang").groupBy("w").agg(F.max(F.col("n") / F.col("all")).alias("share"))
    return [r["w"] for r in shares.orderBy(F.desc("share"), "w").limit(DICTIONARY_WORDS).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    v, before = F.col("value"), F.col("before")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / F.length(v)
    letters = lambda c: F.length(F.regexp_replace(c, "[^a-z]", ""))
    # at every offset, the longest word that stands there covers its letters
    bare = F.regexp_replace(F.lower(v), "|".join(sorted(words, key=lambda w: (-len(w), w))), " ") if words else F.lower(v)
    covered = F.when(letters(F.lower(v)) > 0, 1 - letters(bare) / letters(F.lower(v))).otherwise(0.0)
    return found.withColumns(
        {
            **{name: share(pattern) for name, pattern in TRANSITIONS.items()},
            "size": F.length(v).cast("double"),
            "digits": share("[0-9]"),
            "capitals": share("[A-Z]"),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
            "covered": covered.cast("double"),
            "pathlike": F.when(v.rlike("[/.].*[/.]") | before.rlike(r"(://|/|\\)\S*$"), 1.0).otherwise(0.0),
            "named": F.when(before.rlike("(?i)(token|secret|passw|key|auth|credential)"), 1.0).otherwise(0.0),
            "assigned": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1.0).otherwise(0.0),
            "quoted": F.when(before.rlike(r"[\"'`]$") & F.col("after").rlike("^[\"'`]"), 1.0).otherwise(0.0),
            "digest": F.when(before.rlike(DIGEST), 1.0).otherwise(0.0),
        }
    )


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` with label 1.0 or 0.0 where that is certain; other rows go."""
    v = F.col("value")
    true = v.rlike(FORMATS) | (F.col("before").rlike(NAMED) & v.rlike("[0-9].*[0-9].*[0-9]"))
    false = v.rlike(r"^[A-Za-z._-]+$") | v.rlike(r"^(.)\1+$") | v.rlike("^[^0-9]*/[^0-9]*$") | (F.col("before").rlike(DIGEST) & v.rlike("^[0-9A-Fa-f-]+$"))
    return found.withColumn("label", F.when(true, 1.0).when(false, 0.0)).where("label IS NOT NULL")


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, value, score, secret) of every candidate.

    ``labelled`` has rows as ``propose`` gives them and a label (1.0 true, 0.0 false).
    """
    words = dictionary(docs)
    found = staged(with_features(propose(docs), words), "candidates")
    truth = label_findings(found) if labelled is None else with_features(labelled, words)
    plain = truth.select("label", *FEATURES, F.xxhash64("value", "before").alias("h"))
    half = LABELLED_ROWS // 2
    some = staged(plain.where("label = 1").orderBy("h").limit(half).unionByName(plain.where("label = 0").orderBy("h").limit(half)).drop("h"), "labelled")
    if some.select("label").distinct().count() < 2:
        score = F.when(F.col("value").rlike(FORMATS), 1.0).otherwise(0.0)
        return found.select("doc_id", "start", "end", "value", score.alias("score"), (score >= THRESHOLD).alias("secret"))
    into = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, rawPredictionCol="_raw", probabilityCol="_share", predictionCol="_side")
    model = forest.fit(into.transform(some))
    scored = model.transform(into.transform(found)).withColumn("score", vector_to_array("_share")[1])
    return scored.select("doc_id", "start", "end", "value", "score", (F.col("score") >= THRESHOLD).alias("secret"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
