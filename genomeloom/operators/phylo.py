"""Alignment tables: completeness, concatenation and support."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.functions.columns import ome_of, tree_mean_support
from genomeloom.operators.presence import lacking


def to_genome_names(seqs: DataFrame) -> DataFrame:
    """Sequences (file, seqid, sequence) with their genome."""
    return seqs.withColumn("ome", ome_of(F.col("seqid")))


def alignment_completeness(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, n_missing, missing), (file, ome, n) of genomes that a file holds twice or more)."""
    held = seqs.groupBy("file", "ome").agg(F.count("*").alias("n"))
    return lacking(held, "file", "ome", held), held.where("n > 1")


def complete_genomes(seqs: DataFrame, fail: bool = False) -> DataFrame:
    """Sequences of the genomes that every file holds; ``fail`` makes a missing one an error."""
    files = seqs.agg(F.countDistinct("file").alias("files"))
    n = seqs.groupBy("ome").agg(F.countDistinct("file").alias("k")).withColumn("_one", F.lit(1)).join(F.broadcast(files.withColumn("_one", F.lit(1))), "_one")
    if fail and (lost := n.where("k < files").head(1)):
        raise ValueError(f"genome {lost[0]['ome']} is missing from an alignment")
    return seqs.join(n.where("k = files").select("ome"), "ome", "left_semi")


def supermatrix(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ome, sequence) joined in order of file, (file, start, end) of the partitions); lengths that differ within a file are an error.

    A row holds a genome's whole alignment; where that is too much, ``supermatrix_pieces`` has it in order.
    """
    sizes = seqs.groupBy("file").agg(F.min(F.length("sequence")).alias("size"), F.max(F.length("sequence")).alias("most"))
    checked = sizes.withColumn("size", F.when(F.col("size") == F.col("most"), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("unequal lengths in "), F.col("file").cast("string")))))
    order = W.partitionBy(F.lit(0)).orderBy("file")  # one row an alignment
    parts = checked.withColumn("end", F.sum("size").over(order)).select("file", (F.col("end") - F.col("size") + 1).alias("start"), "end")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "sequence"))), lambda x: x["sequence"]), "")
    return seqs.groupBy("ome").agg(joined.alias("sequence")), parts


def supermatrix_pieces(seqs: DataFrame) -> DataFrame:
    """(ome, file, sequence): the pieces of each genome's row, together and in the order in which they are joined; they sort and spill, and are not gathered."""
    return seqs.select("ome", "file", "sequence").repartition("ome").sortWithinPartitions("ome", "file", "sequence")


def supermatrix_digests(seqs: DataFrame) -> DataFrame:
    """(ome, n, digest): length and SHA-256 of each genome's row of ``supermatrix``, read piece by piece."""

    def row(ome, n, digest):
        return pa.record_batch([pa.array([ome], pa.string()), pa.array([n], pa.int32()), pa.array([digest.hexdigest()])], names=["ome", "n", "digest"])

    def digests(batches):
        now = None
        for batch in batches:
            for ome, piece in zip(batch.column(0), batch.column(2), strict=True):
                if now is None or now[0] != ome.as_py():
                    if now is not None:
                        yield row(*now)
                    now = [ome.as_py(), 0, hashlib.sha256()]
                text = piece.as_py() or ""
                now[1] += len(text)
                now[2].update(text.encode())
        if now is not None:
            yield row(*now)

    return supermatrix_pieces(seqs).mapInArrow(digests, "ome string, n int, digest string")


def nexus_partitions(parts: DataFrame) -> str:
    """The text block that names the partitions: one line an alignment."""
    lines = [f"    charset {r['file']} = {r['start']}-{r['end']};" for r in parts.orderBy("start").toLocalIterator()]
    return "\n".join(["#nexus", "begin sets;", *lines, "end;"]) + "\n"


def filter_supported(trees: DataFrame, min_mean: float) -> DataFrame:
    """Trees (file, newick) with their mean support and whether it reaches the limit."""
    mean = tree_mean_support(F.col("newick"))
    return trees.select("file", mean.alias("support"), (mean >= min_mean).alias("passed"))


def support_rate(trees: DataFrame, min_mean: float) -> DataFrame:
    """(trees, passed, rate): how many trees reach the limit, one row."""
    return filter_supported(trees, min_mean).agg(F.count("*").alias("trees"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double")).alias("rate"))
