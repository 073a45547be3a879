"""Whole jobs: from hits to the best locus of each genome, and from submitted genomes to a new catalog."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.operators import catalog as K
from genomeloom.operators.curate import curate_genomes
from genomeloom.operators.features import locus_by_bases
from genomeloom.operators.groups import INDEXES
from genomeloom.operators.hits import select_hits
from genomeloom.operators.presence import with_scalars
from genomeloom.sources.formats import upsert_ledger
from genomeloom.sources.shared import staged


def compare_loci(hits: DataFrame, positions: DataFrame, n: int = 10_000, index: str = "jaccard", tasks: int | None = None, **limits) -> DataFrame:
    """(ome, gene, pos, queries, similarity) of the locus of each genome that is most like the set of queries.

    Hits within ``limits`` (``select_hits``) open a locus each, ``n`` bases on either side. A locus with two queries
    or more counts as similar as its queries are to all that were asked, times the mean of their best identities in it (as shares of 1). Equal
    loci of a genome are merged. ``queries`` are those that a gene answers, comma-joined; null where there are none.
    Positions that are dealt by genome to ``tasks`` already are not moved.
    """
    kept = staged(select_hits(hits, **limits).select("ome", F.col("sseqid").alias("alias"), "qseqid", "pident"), "kept", tidy=True)
    answers = kept.groupBy("ome", "alias", "qseqid").agg(F.max("pident").alias("pident"))
    loci = staged(locus_by_bases(positions, kept.select("alias").distinct(), n, tasks), "loci", tidy=True)
    # sums of decimals do not depend on their order, so equal loci stay equal
    found = loci.join(answers, ["ome", "alias"]).groupBy("ome", "focus", "qseqid").agg(F.max("pident").cast("decimal(18,6)").alias("p"))
    scored = found.groupBy("ome", "focus").agg(F.count("*").alias("shared"), F.sum("p").cast("double").alias("p")).where("shared > 1")
    asked = hits.agg(F.countDistinct("qseqid").alias("n0"))
    ranked = with_scalars(scored, asked).withColumn("similarity", INDEXES[index](F.col("shared"), F.col("n0"), F.col("shared")) * (F.col("p") / F.col("shared")) / 100)
    top = ranked.withColumn("_r", F.rank().over(W.partitionBy("ome").orderBy(F.desc("similarity")))).where("_r = 1").select("ome", "focus", "similarity")
    top = staged(top, "top", tidy=True)
    genes = loci.join(top, ["ome", "focus"]).select("ome", "alias", "pos", "similarity").distinct()
    names = answers.groupBy("ome", "alias").agg(F.array_join(F.array_sort(F.collect_list("qseqid")), ",").alias("queries"))
    return genes.join(names, ["ome", "alias"], "left").select("ome", F.col("alias").alias("gene"), "pos", "queries", "similarity")


class Update(NamedTuple):
    """What ``update_catalog`` gives: tables to write, and the rows of the old catalog whose place was taken."""

    catalog: DataFrame
    gff: DataFrame
    contigs: DataFrame
    proteins: DataFrame
    failed: DataFrame
    ledger: DataFrame
    replaced: DataFrame


def update_catalog(catalog: DataFrame, new: DataFrame, retired: DataFrame, ledger: DataFrame, gff: DataFrame, contigs: DataFrame, date: str) -> Update:
    """Submitted genomes coded, curated, and put into the catalog.

    ``new`` has assembly_acc, genus, species, source, version, perhaps ome (a code that is asked for) and other columns of the
    catalog; ``gff`` and ``contigs`` belong to an assembly_acc. Rows that failed at the same or a later version (ledger) are
    passed over. A known accession becomes the next version of its genome and takes its place. What gets no code, has no assembly or
    no annotation, or is left without genes or proteins goes to ``failed`` (assembly_acc, reason) and to the ledger under ``date``.
    """
    todo = staged(K.skip_failed(new.withColumn("code", F.col("assembly_acc")), ledger).drop("code"), "todo")
    coded = staged(K.generate_codes(todo, catalog, retired), "coded")
    codes = coded.select("assembly_acc", "ome")
    named = lambda rows: rows.join(codes, "assembly_acc").drop("assembly_acc")
    models, bases = named(gff), named(contigs)
    done_gff, done_contigs, proteins, bad = curate_genomes(models, bases)
    files = models.select("ome").union(bases.select("ome")).distinct()
    bare = codes.join(files, "ome", "left_anti").select("assembly_acc", F.lit("no assembly").alias("reason"))
    uncoded = K.failed_codes(todo, catalog, retired).select("assembly_acc", F.col("failure").alias("reason"))
    failed = staged(reduce(DataFrame.unionByName, [uncoded, bare, bad.join(codes, "ome").select("assembly_acc", "reason")]), "failed")
    fine = coded.join(failed.select("assembly_acc"), "assembly_acc", "left_anti")
    full = fine.select(*(F.col(c) if c in fine.columns else F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in catalog.columns))
    merged, replaced = K.promote(catalog, staged(full, "added"))
    lost = todo.join(failed.select("assembly_acc").distinct(), "assembly_acc", "left_semi").select(F.col("assembly_acc").alias("code"), "source", "version", F.lit(date).alias("attempt_date"))
    return Update(merged, done_gff, done_contigs, proteins, failed, upsert_ledger(ledger, lost, "code"), replaced)
