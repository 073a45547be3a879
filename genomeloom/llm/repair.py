"""Repair of conversation structure: scalar big-integer weights in an integer-minimum search over a graph without cycles.

Method. A conversation's rows are worked off in order by Keep, Rerole, Delete and Insert. The
graph's nodes are (row, state): nothing, system, user or assistant seen last; its edges are
edits. A way's weight is one integer: the high digits are its cost, the low ones, BITS bits
each, the edits' letters in order, the first in the highest place, and zeros after the last. So
the plain minimum of integers is the cheapest way, and of equally cheap ones that with the ASCII-least
letters, for letters have rising digits and the end of a word the least. Weights are of the ways from
a node to the end: an edit put before a way adds its cost and its letter and moves the other letters
one place on. The letters of the least weight tell the edits; nothing else is kept.

Spark's part. Rows become a few bits (role's initial, fault) and a digest; a window over
(conversation, role, text's digest) finds texts seen before; the search takes one pass over the bits,
sorted by conversation, and a second pass over the texts, sorted alike behind their
conversation's letters, gives repaired rows as they come. So a task holds a few bytes for each row of
one conversation, never its texts, and common texts, roles and first turns meet nowhere.

Defined cases. Null roles, texts, turns and ids are one space where they are text; nulls of turn come
first, equal turns are in order of role, then of the text's SHA-256. A null conv_id is a conversation of its own.
Repeated rows are duplicates. Empty texts are blank. A role counts by its first character. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.llm.sqltext import crc32_sql
from genomeloom.sources.shared import staged, table

#: Letters of the edits; their digits follow the order of ASCII, and zero ends a word.
LETTERS = "DIKR"
BITS = 3
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
INK = r"[^\x20\x09-\x0D]"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits lead from a state (start, system, user, assistant seen last) to the state of the row that they leave.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state that a rerole or an insert leads to, and its role.
TURN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ROWS = "conv_id long, turn long, role string, text string"


def cheapest_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, letters) for rows of (role's initial, fault)."""
    n = len(rows)
    # a way of least weight costs at most all deletions and two inserts, so it has fewer letters than this
    width = BITS * (n + (2 * n + 10) // 5 + 4)
    low = (1 << width) - 1
    digit = {letter: (k + 1) << (width - BITS) for k, letter in enumerate(LETTERS)}

    def put(letter: str, way: int, more: int = 0) -> int:
        return ((way >> width) + COST[letter] + more << width) | digit[letter] | (way & low) >> BITS

    never = 8 * (n + 4) << width
    ways = [0, never, never, 0]  # nothing and a reply may stand at the end
    for at in range(n, -1, -1):
        if at < n:
            initial, fault = rows[at]
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            choices = [[put("D", way)] for way in ways]
            if fault not in (BLANK, DUPLICATE):
                for state in range(4):
                    choices[state].append(put("R", ways[TURN[state]], more))
                    if initial in NEXT[state]:
                        choices[state].append(put("K", ways[NEXT[state][initial]], more))
            ways = [min(weights) for weights in choices]
        for _ in range(2):  # inserts lead on at the same row; more than two in a row end where they began
            ways = [min(way, put("I", ways[TURN[state]])) for state, way in enumerate(ways)]
    best = ways[START]
    digits = best & low
    letters = ""
    for k in range(0, width, BITS):
        d = digits >> (width - BITS - k) & ((1 << BITS) - 1)
        if not d:
            break
        letters += LETTERS[d - 1]
    return best >> width, letters


def damaged(conversations: DataFrame) -> DataFrame:
    """ROWS of a copy with rows dropped, emptied, cut short, repeated or given to the user, by the remainder of a checksum by 20."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("_fate"))
    fate = F.col("_fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).select("conv_id", "turn", "role", "text")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault, nth) of each of ROWS; ``nth`` tells equal rows of a turn apart."""
    blank = ~F.col("text").rlike(INK)
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    bits = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), F.substring("role", 1, 1).alias("initial"), F.when(blank, BLANK).when(truncated, TRUNCATED).otherwise(SOUND).alias("_own"))
    nth = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    return bits.withColumn("nth", nth).withColumn("fault", F.when((F.col("_own") != BLANK) & (F.col("nth") > 1), DUPLICATE).otherwise(F.col("_own"))).drop("_own")


ORDER = ("_conv", "turn", "role", "digest", "nth")
FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(marked: DataFrame) -> DataFrame:
    """FOUND of each conversation of ``marked`` (the result of ``faults``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = work  # no conversation yet
        rows: list[tuple[str, int]] = []
        low = high = last = None
        distinct = 0
        pairs: dict[tuple[str, int], tuple[str, int]] = {}  # equal pairs are one object

        def row() -> tuple:
            kinds = np.bincount([fault for _, fault in rows], minlength=4)
            illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
            gaps = 0 if low is None else high - low + 1 - distinct
            return (conv, gaps, int(kinds[BLANK]), int(kinds[DUPLICATE]), int(kinds[TRUNCATED]), illegal, *cheapest_edits(rows))

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for batch in batches:
            out = []
            for c, t, initial, fault in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "initial", "fault"))):
                if c != conv:
                    if conv is not work:
                        out.append(row())
                    conv, rows, low, high, last, distinct = c, [], None, None, None, 0
                rows.append(pairs.setdefault((initial, fault), (initial, fault)))
                if t is not None:
                    low, high = t if low is None else low, t
                    distinct += t != last
                    last = t
            if out:
                yield batch_of(out)
        if conv is not work:
            yield batch_of([row()])

    return _sorted(marked).select("conv_id", "turn", "initial", "fault").mapInArrow(work, FOUND)


def _sorted(rows: DataFrame) -> DataFrame:
    """Whole conversations in a task, null ids among them, in order."""
    return rows.withColumn("_conv", F.struct("conv_id")).repartition("conv_id").sortWithinPartitions(*ORDER)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text) of every repaired row in order of ``at``, by the letters of ``found``; inserted rows have no turn."""
    head = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("audit").alias("letters"), F.lit(None).cast("binary").alias("digest"))
    own = rows.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("letters"), _digest(F.col("text")).alias("digest"))
    both = own.unionByName(head).withColumn("nth", F.col("letters").isNull())  # false first: a head stands before all rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, k, state, at, conv = "", 0, START, 0, None

        def inserted(out: list[tuple]) -> None:
            nonlocal k, state, at
            while k < len(letters) and letters[k] == "I":
                state = TURN[state]
                out.append((conv, at, None, ROLES[state], ""))
                k, at = k + 1, at + 1

        for batch in batches:
            out: list[tuple] = []
            for c, turn, role, text, own_letters in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "letters"))):
                if own_letters is not None:
                    letters, k, state, at, conv = own_letters, 0, START, 0, c
                    inserted(out)  # those before the first row
                    continue
                letter, k = letters[k], k + 1
                if letter != "D":
                    state = NEXT[state][role[0]] if letter == "K" else TURN[state]
                    out.append((c, at, turn, role if letter == "K" else ROLES[state], text))
                    at += 1
                inserted(out)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=["conv_id", "at", "turn", "role", "text"])

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "nth", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv_id", "turn", "role", "text", "letters").mapInArrow(work, "conv_id long, at long, turn long, role string, text string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(FOUND of every conversation that has rows, repaired rows) of a table of (conv_id, turn, role, text)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    found = staged(audits(faults(rows)), "repair")
    return found, repaired_rows(rows, found)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired ``role:text`` of each conversation, joined by line breaks; hashed as they come, in the order that ``repaired`` already has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for c, at, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "at", "role", "text"))):
                if at == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out])], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "at", "role", "text").mapInArrow(work, "conv_id long, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found, repaired = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    hashed = digests(repaired)
    out = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left").join(hashed.alias("h"), F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    numbers = [F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("e.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", none).alias("repaired_sha256"))


def _oracle() -> str:
    """The same search by rounds over the rows; a way is a structure of cost, letters and repaired rows, compared in this order."""
    white = r"\x20\x09-\x0D"
    turn, role = "CASE q WHEN 2 THEN 3 ELSE 2 END", "CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END"
    more = f"CASE WHEN fault = {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END"
    sound = f"fault NOT IN ({BLANK}, {DUPLICATE})"
    keeps = "(q = 0 AND ini IN ('s', 'u') OR q IN (1, 3) AND ini = 'u' OR q = 2 AND ini = 'a')"
    put = lambda letter, cost, row: f"{{'cost': s.cost + {cost}, 'audit': s.audit || '{letter}', 'out': {f'list_append(s.out, {row})' if row else 's.out'}}}"
    insert = lambda rows: f"SELECT conv, i, {turn} AS q, {put('I', COST['I'], role)} AS s FROM {rows}"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations),
dmg AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM src JOIN (VALUES (1), (2)) r(k) ON k <= CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT conv, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
 FROM dmg JOIN ids ON dmg.conv_id IS NOT DISTINCT FROM ids.conv_id),
p AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT *, lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini AS two, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN {BLANK} WHEN nth > 1 THEN {DUPLICATE} WHEN NOT regexp_matches(text, '[.!?][{white}]*$') THEN {TRUNCATED} ELSE {SOUND} END AS fault FROM p),
start AS (SELECT conv, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])}} AS s FROM ids),
start1 AS ({insert("start")}), start2 AS ({insert("start1")}),
ways AS (SELECT * FROM start UNION ALL SELECT * FROM start1 UNION ALL SELECT * FROM start2
 UNION ALL
 (WITH met AS (SELECT w.conv, w.i + 1 AS i, q, s, f.role, f.text, ini, fault FROM ways w JOIN f ON f.conv = w.conv AND f.i = w.i + 1),
 e0 AS (SELECT conv, i, q, {put('D', COST['D'], '')} AS s FROM met
  UNION ALL SELECT conv, i, {turn} AS q, {put('R', f"{COST['R']} + {more}", f"{role} || text")} AS s FROM met WHERE {sound}
  UNION ALL SELECT conv, i, CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END AS q, {put('K', more, "role || ':' || text")} AS s FROM met WHERE {sound} AND {keeps}),
 e1 AS ({insert("e0")}), e2 AS ({insert("e1")})
 SELECT conv, i, q, min(s) AS s FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY conv, i, q)),
n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {', '.join(f"count(*) FILTER (WHERE fault = {k}) AS {c}" for k, c in ((BLANK, 'blank'), (DUPLICATE, 'duplicate'), (TRUNCATED, 'truncated')))},
  count(*) FILTER (WHERE i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
best AS (SELECT w.conv, min(s) AS s FROM ways w JOIN n ON w.conv = n.conv AND w.i = n.n WHERE q IN (0, 3) GROUP BY w.conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, {', '.join(f"coalesce({c}, 0) AS {c}" for c in ('blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(s.audit, '') AS audit,
 sha256(coalesce(array_to_string(s.out, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN n USING (conv) LEFT JOIN best USING (conv)
"""


ORACLE = _oracle()
