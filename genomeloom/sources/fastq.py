"""FASTQ read by splits: every task reads a block of lines, and records that a cut divides are put together afterwards.

A quality line may begin with @ or +, so where a record begins cannot be told from one line. A block takes as its first
record the first that reads as a whole one with another header after it; the lines before it and those of its unfinished last record are
its ends. The ends around each cut must make whole records: then every block began where reading from the
top of the file would have begun a record. A file for which they do not is read again, from the top, as a stream through one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.sources.shared import staged

READ = "read_id string, description string, sequence string, score string"
ENDS = "file string, block long, started boolean, bad boolean, head array<string>, tail array<string>"
#: What a sequence line is made of; decides only where a block begins.
LETTERS = re.compile(r"[A-Za-z.*~-]*\s*\Z")


def _record(lines: list[str], at: int) -> tuple[tuple[str, str, str, str], int] | None:
    """The record whose header is line ``at`` and the line after it; None if the lines end first."""
    seq: list[str] = []
    k = at + 1
    while k < len(lines) and not lines[k].startswith("+"):
        seq.append(lines[k].strip())
        k += 1
    k += 1
    whole = "".join(seq)
    score: list[str] = []
    size = 0
    while k < len(lines):
        score.append(lines[k].strip())
        size += len(score[-1])
        k += 1
        if size > len(whole):
            raise ValueError(f"score longer than sequence: {lines[at][1:]}")
        if size == len(whole):
            name, _, description = lines[at][1:].partition(" ")
            return (name, description, whole, "".join(score)), k
    return None


def _reads_as_record(lines: list[str], at: int) -> bool | None:
    """Whether a record that begins with line ``at`` is followed by a header; None if that takes more lines."""
    k = at + 1
    while k < len(lines) and not lines[k].startswith("+"):
        if not LETTERS.match(lines[k]):
            return False
        k += 1
    if k == at + 1 and k < len(lines):
        return False
    try:
        found = _record(lines, at)
    except ValueError:
        return False
    if found is None or found[1] == len(lines):
        return None
    return lines[found[1]].startswith("@")


class _Block:
    """Lines of one block as they come: its ends and its records."""

    def __init__(self, top: bool) -> None:
        self.started, self.bad, self.head, self.rest, self.need = top, False, [], [], 0

    def add(self, lines: list[str]) -> list[tuple[str, str, str, str]]:
        self.rest += lines
        # what did not suffice is tried again once the lines have doubled
        return self._take() if len(self.rest) >= self.need else []

    def finish(self) -> list[tuple[str, str, str, str]]:
        return self._take()

    def _begin(self) -> None:
        for k, line in enumerate(self.rest):
            fits = _reads_as_record(self.rest, k) if line.startswith("@") else False
            if fits is None:
                return
            if fits:
                self.head, self.rest, self.started = self.rest[:k], self.rest[k:], True
                return

    def _take(self) -> list[tuple[str, str, str, str]]:
        if not self.started:
            self._begin()
        out: list[tuple[str, str, str, str]] = []
        at = 0
        try:
            while self.started and not self.bad and at < len(self.rest):
                if not self.rest[at].startswith("@"):
                    at += 1
                    continue
                found = _record(self.rest, at)
                if found is None:
                    break
                out.append(found[0])
                at = found[1]
        except ValueError:
            self.bad = True
        self.rest = [] if self.bad else self.rest[at:]
        self.need = 2 * len(self.rest)
        return out

    def ends(self) -> tuple[bool, bool, list[str], list[str]]:
        return (True, self.bad, self.head, self.rest) if self.started else (False, False, self.rest, [])


def _blocks(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[str, int, list[str], bool]]:
    """(file, block, lines, whether the block begins) of frames whose blocks each lie together."""
    last = None
    for frame in frames:
        runs = ((frame["file"] != frame["file"].shift()) | (frame["block"] != frame["block"].shift())).cumsum()
        for _, part in frame.groupby(runs, sort=False):
            key = part["file"].iat[0], int(part["block"].iat[0])
            yield *key, part["value"].tolist(), key != last
            last = key


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ENDS.split(", ")]
    key, block = None, None
    for file, start, lines, new in _blocks(frames):
        if new:
            if block is not None:
                block.finish()
                yield pd.DataFrame([(*key, *block.ends())], columns=names)
            key, block = (file, start), _Block(start == 0)
        block.add(lines)
    if block is not None:
        block.finish()
        yield pd.DataFrame([(*key, *block.ends())], columns=names)


def _inner(frames: Iterable[pd.DataFrame], strict: bool = False) -> Iterator[pd.DataFrame]:
    """Whole records of each block; ``strict``: what is no record is an error."""
    names = ["file", *(c.split()[0] for c in READ.split(", "))]
    file, block = "", None

    def frame(rows: list[tuple[str, str, str, str]]) -> pd.DataFrame:
        if strict and block.bad:
            raise ValueError(f"score longer than sequence in {file}")
        return pd.DataFrame([(file, *r) for r in rows], columns=names)

    for name, start, lines, new in _blocks(frames):
        if new:
            if block is not None:
                yield frame(block.finish())
            file, block = name, _Block(start == 0)
        yield frame(block.add(lines))
    if block is not None:
        yield frame(block.finish())


def _from_top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of files whose lines come in order, each file as one block."""
    return _inner((frame.assign(block=0) for frame in frames), strict=True)


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records between the ends around cuts, and whether they are whole; of the last of a file the rest may be cut short."""
    for frame in frames:
        for file, lines, last in zip(frame["file"], frame["lines"], frame["last"]):
            block = _Block(True)
            rows = block.add(list(lines)) + block.finish()
            good = not block.bad and (last or not block.rest)
            yield pd.DataFrame([(file, good, [dict(zip(("read_id", "description", "sequence", "score"), r)) for r in rows])], columns=["file", "good", "reads"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, description, sequence, score): a record ends when its score is as long as its sequence, whatever the lines begin with.

    Files are cut wherever Spark cuts them (compressed ones nowhere). Lines before a header are passed over, an unfinished last
    record is dropped, a score longer than its sequence is an error. The ends of blocks are written to the shared folder, a row a block; reads are not.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ends = staged(lines.mapInPandas(_ends, ENDS), "ends")
    along = W.partitionBy("file").orderBy("block")  # a row a block
    placed = ends.withColumn("k", F.sum(F.col("started").cast("long")).over(along))
    heads = placed.select("file", (F.col("k") - F.col("started").cast("long")).alias("k"), "block", F.col("head").alias("lines"))
    tails = placed.where("started").select("file", "k", "block", F.col("tail").alias("lines"))
    around = tails.unionByName(heads).where("k > 0").groupBy("file", "k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "lines"))), lambda x: x["lines"])).alias("lines"))
    last = placed.groupBy("file").agg(F.max("k").alias("top"))
    between = around.join(last, "file").select("file", "lines", (F.col("k") == F.col("top")).alias("last"))
    met = staged(between.mapInPandas(_joined, f"file string, good boolean, reads array<struct<{READ.replace(' string', ':string').replace(', ', ',')}>>"), "met")
    unsure = ends.where("bad").select("file").unionByName(met.where("NOT good").select("file")).distinct()
    columns = [c.split()[0] for c in READ.split(", ")]
    reads = lines.mapInPandas(_inner, f"file string, {READ}").unionByName(met.select("file", F.explode("reads").alias("r")).select("file", "r.*"))
    if unsure.isEmpty():
        return reads.select(columns)
    whole = lines.withColumn("row", F.monotonically_increasing_id()).join(unsure, "file", "left_semi")
    again = whole.repartition("file").sortWithinPartitions("file", "block", "row").select("file", "block", "value").mapInPandas(_from_top, f"file string, {READ}")
    return reads.join(unsure, "file", "left_anti").select(columns).unionByName(again.select(columns))
