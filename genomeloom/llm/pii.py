"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is one expression of the text column, built from SQL functions, so there
is no shuffle and no Python on the executors. A pattern's matches and the pieces
between them give positions by summing lengths. Patterns are written so that the
regular-expression engine neither recurses nor rescans on long runs; two of them
first rewrite single separators to \\x01, code point for code point, so that positions stay
(a \\x01 of the text itself becomes \\x02, which stands in no pattern).

Kinds. email, ip (parts up to 255), card (14 to 19 digits, Luhn) and phone (10 to 15
digits) stand once their pattern and check pass; context, read on both sides, only raises their score.
iban (mod 97) and ssn are added: an ssn has no checksum, so it stands only where no digit
touches it and a context word lifts its score to the threshold.

Defined cases. Null text is empty: no spans, and masking leaves it null. Ties in start
are ordered by kind as listed in KINDS. Repeated rows each give their own result.
Empty tables give empty results. Extra columns pass through mask_pii and are ignored
by the query; no helper columns are added, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.sources.shared import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
CONTEXT_CHARS = 40
#: kind: (score of a confirmed span, what a context word adds, context words)
SCORES = {
    "email": (0.8, 0.2, "mail|contact"),
    "ip": (0.6, 0.3, "host|server|address"),
    "card": (0.7, 0.3, "card|visa|mastercard|payment"),
    "phone": (0.7, 0.3, "phone|call|mobile|fax"),
    "iban": (0.8, 0.2, "iban|bank|account"),
    "ssn": (0.3, 0.4, "ssn|social security|tax id"),
}
LOCAL = r"[A-Za-z0-9._%+\x01-]"
#: Of the texts as rewritten by _prepared.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def _prepared(text: Column, kind: str) -> tuple[Column, Column]:
    """(whether a match is possible at all, text to search; same length in code points)."""
    plain = F.translate(text, "\x01", "\x02")
    if kind == "email":  # dots that no label follows become \x01, so a domain is a run of one class
        return F.contains(text, F.lit("@")), F.regexp_replace(plain, r"\.(?![A-Za-z0-9-])", "\x01")
    if kind == "card":  # separators that don't stand between digits become \x01, so a number is a run of one class
        return text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), F.regexp_replace(plain, r"(?<![0-9])[ -]|[ -](?![0-9])", "\x01")
    quick = {"ip": r"[0-9]\.[0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
    return (F.contains(text, F.lit("+")) if kind == "phone" else text.rlike(quick[kind])), text


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(a: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), (a * 10 + F.ascii(ch) - 48) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(add(a, ch))) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        short = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(found, r"\."), lambda part: (F.length(short(part)) <= 3) & (F.coalesce(F.substring(short(part), 1, 4).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(found, " ", "")
        return F.when(F.length(plain).between(15, 34), _mod97(plain)).otherwise(False)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _kind_spans(text: Column, kind: str) -> Column:
    possible, searched = _prepared(text, kind)
    pattern = F.lit(PATTERNS[kind])
    base, extra, words = SCORES[kind]

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(F.coalesce(end, start).alias("pos"), F.when(x["found"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    pieces = F.arrays_zip(F.split(searched, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(searched, pattern, F.lit(0)).alias("found"))
    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))
    found = F.filter(F.aggregate(pieces, first, step, lambda acc: acc["out"]), lambda s: _confirmed(kind, s["found"]))

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS)))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS))
        score = F.lit(base) + F.when(before.rlike(f"(?i){words}") | after.rlike(f"(?i){words}"), F.lit(extra)).otherwise(F.lit(0.0))
        if kind == "ssn":
            score = F.when(before.rlike("[0-9]$") | after.rlike("^[0-9]"), F.lit(0.0)).otherwise(score)
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.when(possible, F.transform(found, scored)).otherwise(F.array().cast(SPAN))


def pii_spans(text: Column) -> Column:
    """All spans standing in ``text``, by start and kind: start and end in code points (end exclusive), kind, score."""
    whole = F.coalesce(text, F.lit(""))
    every = F.array_sort(F.concat(*(_kind_spans(whole, k) for k in KINDS)).cast(SPAN))
    return F.filter(every, lambda s: s["score"] >= THRESHOLD)


def mask_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every span becomes its kind in angle brackets; spans that overlap become one, named by the first."""
    text = F.col(column)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["pos"]
        new = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(apart, new).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))
    return docs.withColumn(column, F.aggregate(pii_spans(text), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, rest))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii_spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The same by the plain patterns, on another engine's regular expressions."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": PATTERNS["iban"],
        "ssn": PATTERNS["ssn"],
    }
    digits = "regexp_replace(m[i], '[^0-9]', '', 'g')"
    double = f"CAST({digits}[len({digits}) - j] AS INT)"
    luhn = f"list_sum(list_transform(range(0, len({digits})), lambda j: CASE WHEN j % 2 = 0 THEN {double} WHEN {double} > 4 THEN 2 * {double} - 9 ELSE 2 * {double} END)) % 10 = 0"
    iban = "replace(m[i], ' ', '')"
    turned = f"list_reduce(list_prepend(0, list_transform(string_split({iban}[5:] || {iban}[:4], ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: CASE WHEN b < 58 THEN (a * 10 + b - 48) % 97 ELSE (a * 100 + b - 55) % 97 END) = 1"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m[i], '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(left(ltrim(p, '0'), 4) AS INT), 0) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": f"len({iban}) BETWEEN 15 AND 34 AND {turned}",
        "ssn": f"(regexp_matches(t[greatest(s[i] - {CONTEXT_CHARS}, 0) + 1 : s[i]], '(?i){SCORES['ssn'][2]}') OR regexp_matches(t[s[i] + len(m[i]) + 1 : s[i] + len(m[i]) + {CONTEXT_CHARS}], '(?i){SCORES['ssn'][2]}')) AND NOT regexp_matches(t[greatest(s[i], 1) : s[i]], '[0-9]') AND NOT regexp_matches(t[s[i] + len(m[i]) + 1 : s[i] + len(m[i]) + 1], '[0-9]')",
    }
    parts = "\nUNION ALL\n".join(
        f"""SELECT doc_id, t, '{k}' AS kind, {r} AS rank, m, s FROM (SELECT doc_id, t, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0)) AS s
 FROM (SELECT doc_id, t, regexp_extract_all(t, '{plain[k]}') AS m, regexp_split_to_array(t, '{plain[k]}') AS g FROM d))"""
        for r, k in enumerate(KINDS)
    )
    ok = " ".join(f"WHEN kind = '{k}' THEN {c}" for k, c in checks.items())
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({parts}),
x AS (SELECT doc_id, kind, rank, m, s, t, unnest(range(1, len(m) + 1)) AS i FROM p),
f AS (SELECT doc_id, kind, rank, s[i] AS start, len(m[i]) AS size FROM x WHERE CASE {ok} END)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)},
 sha256(coalesce(string_agg({text}, ',' ORDER BY start, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
 coalesce(string_agg({text}, ',' ORDER BY start, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
