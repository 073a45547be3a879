"""Search tables: which hits count, and what they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.functions.columns import ome_of

#: Percentages are compared as thousandths against limits times this, as database runs do.
SCALE = 100_000


def _limits(evalue: float | None, bitscore: float, pident: float, ppos: float, scale: int):
    ok = (F.floor("bitscore") > bitscore) & (F.floor(1000 * F.col("pident")) > scale * pident)
    if evalue is not None:
        ok = ok & (F.col("evalue") <= evalue)
    return ok & (F.col("ppos").isNull() | (F.floor(1000 * F.col("ppos")) > scale * ppos))


def select_hits(hits: DataFrame, max_hits: int | None = None, evalue: float | None = None, bitscore: float = 0, pident: float = 0, ppos: float = 0, scale: int = SCALE) -> DataFrame:
    """Per genome and query the ``max_hits`` of highest identity, ties in order of ``row``; limits apply after that choice."""
    rows = hits.withColumn("ome", ome_of(F.col("sseqid")))
    if max_hits is not None:
        best = W.partitionBy("ome", "qseqid").orderBy(F.desc("pident"), "row")
        rows = rows.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= max_hits).drop("_k")
    return rows.where(_limits(evalue, bitscore, pident, ppos, scale))


def select_hits_global(hits: DataFrame, max_hits: int | None = None, evalue: float | None = None, bitscore: float = 0, pident: float = 0, ppos: float = 0, scale: int = SCALE) -> DataFrame:
    """Limits first, then per genome the ``max_hits`` of highest bit score, ties in order of ``row``."""
    rows = hits.withColumn("ome", ome_of(F.col("sseqid"))).where(_limits(evalue, bitscore, pident, ppos, scale))
    if max_hits is None:
        return rows
    best = W.partitionBy("ome").orderBy(F.desc("bitscore"), "row")
    return rows.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= max_hits).drop("_k")


def select_hmm_hits(hits: DataFrame, domains: DataFrame, coverage: float = 0.0, evalue: float | None = None, bitscore: float | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, domains): sequences with a domain over the share ``coverage`` of the model, E below, score at or above the limits; the best ``top`` of each query."""
    covered = domains.join(hits.select("query", "seq", "model_len"), ["query", "seq"]).where(F.col("hmm_to") - F.col("hmm_from") + 1 >= coverage * F.col("model_len")).select("query", "seq").distinct()
    kept = hits.join(covered, ["query", "seq"], "left_semi")
    if evalue is not None:
        kept = kept.where(F.col("seq_e") < evalue)
    if bitscore is not None:
        kept = kept.where(F.col("seq_score") >= bitscore)
    if top is not None:
        kept = kept.withColumn("_k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("seq_score"), "seq"))).where(F.col("_k") <= top).drop("_k")
    return kept, domains.join(kept.select("query", "seq"), ["query", "seq"], "left_semi")


def hits_to_accessions(hits: DataFrame, coordinates: bool = False) -> DataFrame:
    """(qseqid, accession): subjects of each query once, with the alignment's place if asked."""
    place = F.concat(F.col("sseqid"), F.lit("["), F.col("sstart").cast("string"), F.lit("-"), F.col("send").cast("string"), F.lit("]"))
    return hits.select("qseqid", (place if coordinates else F.col("sseqid")).alias("accession")).distinct()


def hits_in_all_queries(hits: DataFrame) -> DataFrame:
    """Subjects that every query hits."""
    queries = hits.agg(F.countDistinct("qseqid").alias("all"))
    per = hits.groupBy("sseqid").agg(F.countDistinct("qseqid").alias("n"))
    # one row on the small side
    return per.join(F.broadcast(queries), F.col("n") == F.col("all")).select("sseqid")


def route_queries(hits: DataFrame, max_size: int) -> DataFrame:
    """(qseqid, n, route): too few sequences, ready, or to be clustered first."""
    n = hits.groupBy("qseqid").agg(F.countDistinct("sseqid").alias("n"))
    return n.withColumn("route", F.when(F.col("n") > max_size, "cluster").when(F.col("n") < 3, "few").otherwise("ready"))


def queries_per_gene(hits: DataFrame) -> DataFrame:
    """(ome, gene, queries): the queries each gene answers, in order, joined by commas."""
    return hits.select(ome_of(F.col("sseqid")).alias("ome"), F.col("sseqid").alias("gene"), "qseqid").distinct().groupBy("ome", "gene").agg(F.array_join(F.sort_array(F.collect_list("qseqid")), ",").alias("queries"))


def query_combinations(hits: DataFrame) -> DataFrame:
    """Distinct combinations of more than one query on a gene."""
    return queries_per_gene(hits).where(F.col("queries").contains(",")).select("queries").distinct()
