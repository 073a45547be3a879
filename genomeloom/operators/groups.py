"""Homology groups, pangenomes, conserved gene pairs and locus comparison; long tables of (hg, gene, ome) throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.functions import columns as C
from genomeloom.operators.features import gene_positions
from genomeloom.operators.presence import lacking, numbered, with_scalars
from genomeloom.sources.shared import staged


def build_homology_groups(pairs: DataFrame, omes: DataFrame | None = None, min_omes: int = 1) -> DataFrame:
    """(hg, gene, ome): groups of (rep, member) pairs, numbered from 0 by falling size, then representative."""
    # a group's rows are moved once to be told apart, and written: they are read for its size and for its number
    once = pairs.select("rep", F.explode(F.when(F.col("member") == F.col("rep"), F.array("rep")).otherwise(F.array("member", "rep"))).alias("gene"))
    genes = staged(once.repartition("rep").distinct(), "members", tidy=True).withColumn("ome", C.ome_of(F.col("gene")))
    usable = genes if omes is None else genes.join(omes.select("ome").distinct(), "ome", "left_semi")
    if min_omes > 1:
        wide = usable.groupBy("rep").agg(F.countDistinct("ome").alias("n")).where(F.col("n") >= min_omes)
        genes = genes.join(wide.select("rep"), "rep", "left_semi")
    sizes = genes.groupBy("rep").agg(F.count("*").alias("size"))
    order = numbered(sizes, "hg", F.desc("size"), F.asc("rep")).select("rep", "hg")
    return genes.join(order, "rep").select("hg", "gene", "ome")


def hg_stats(hg: DataFrame, n_genomes: int) -> DataFrame:
    """Copies of each group with at least ``n_genomes`` genes: mean (genes over all genomes), median (element rint(n/2 - 0.5) from 0 of the sorted counts), sample deviation, share of genomes."""
    copies = hg.groupBy("hg", "ome").agg(F.count("*").alias("copies"))
    stats = copies.groupBy("hg").agg(F.sum("copies").alias("genes"), F.count("*").alias("omes"), F.max("copies").alias("most"), F.stddev_samp("copies").alias("deviation"), F.sort_array(F.collect_list("copies")).alias("all"))
    middle = F.get("all", F.rint(F.size("all") / 2 - 0.5).cast("int"))
    return stats.where(F.col("genes") >= n_genomes).select("hg", "genes", "omes", "most", (F.col("genes") / n_genomes).alias("mean"), middle.alias("median"), "deviation", (F.col("omes") / n_genomes).alias("share"))


def near_single_copy(stats: DataFrame, n_genomes: int, min_share: float = 1.0, max_median: float = 1, max_mean: float = 0, max_deviation: float = 0) -> DataFrame:
    """Groups in enough genomes with a verdict: single, near or neither; a limit of 0 is off."""
    near = F.col("median") <= max_median
    if max_mean:
        near = near & (F.col("genes") <= max_mean * n_genomes)
    if max_deviation:
        near = near & F.col("deviation").isNotNull() & (F.col("deviation") <= max_deviation)
    kept = stats.where(F.col("share") >= min_share)
    return kept.select("hg", F.when(F.col("most") == 1, "single").when(near, "near").otherwise("neither").alias("copy"), (F.col("share") == 1).alias("core"))


def hg_missing(hg: DataFrame, omes: DataFrame) -> DataFrame:
    """(hg, n_missing, missing): genomes that lack a group, comma-joined; groups that lack none are left out."""
    return lacking(hg, "hg", "ome", omes)


def pangenome(hg: DataFrame, stats: DataFrame, n_genomes: int, max_missing: int = 0) -> DataFrame:
    """(ome, genes, core_percent, accessory_percent): a core group misses at most ``max_missing`` genomes and has statistics."""
    core = stats.where(F.col("omes") >= n_genomes - max_missing).select("hg", F.lit(1).alias("core"))
    rows = hg.join(core, "hg", "left")
    n = F.count("*")
    return rows.groupBy("ome").agg(n.alias("genes"), F.round(100.0 * F.sum(F.coalesce("core", F.lit(0))) / n, 4).alias("core_percent"), F.round(100.0 * F.sum(F.lit(1) - F.coalesce("core", F.lit(0))) / n, 4).alias("accessory_percent"))


def accessory_matrix(hg: DataFrame, core: DataFrame) -> DataFrame:
    """(ome, hg): presence of the groups that are not core, long."""
    return hg.join(core.select("hg"), "hg", "left_anti").select("ome", "hg").distinct()


def placed_groups(gff: DataFrame, hg: DataFrame, tasks: int | None = None) -> DataFrame:
    """``gene_positions`` with the group of each gene (hg, null where there is none); groups go to their genome with its rows, in one move, to ``tasks`` if given."""
    placed = gene_positions(gff, tasks or True, hg.select("ome", F.col("gene").alias("alias"), F.col("hg").alias("mark")))
    return placed.withColumn("hg", F.explode_outer("marks")).drop("marks")


def hg_pairs(positions: DataFrame, hg: DataFrame | None, plusminus: int, focal: DataFrame | None = None) -> DataFrame:
    """(ome, hg0, hg1): pairs of different groups within w = 2 plusminus + 1 places on a contig of w genes or more; genes without a group take a place.

    With ``focal`` (hg) only pairs that touch one of these groups are made. Without ``hg`` the positions have it (``placed_groups``), and are not moved.
    """
    w = 2 * plusminus + 1
    contig = W.partitionBy("ome", "seqid")
    own = positions if hg is None else hg.select("ome", F.col("gene").alias("alias"), "hg")
    marked = own.withColumn("focal", F.lit(True)) if focal is None else own.join(focal.select("hg", F.lit(True).alias("focal")).distinct(), "hg", "left")
    placed = marked if hg is None else positions.join(marked, ["ome", "alias"], "left")
    group = F.when(F.col("hg").isNotNull(), F.struct("hg", F.coalesce("focal", F.lit(False)).alias("focal")))
    ahead = placed.withColumn("n", F.max("pos").over(contig)).withColumn("next", F.collect_list(group).over(contig.orderBy("pos").rowsBetween(1, w)))
    pairs = ahead.where((F.col("n") >= w) & F.col("hg").isNotNull()).select("ome", "hg", "focal", F.explode(F.array_distinct("next")).alias("other")).where("hg <> other.hg AND (focal OR other.focal)")
    return pairs.select("ome", F.least("hg", "other.hg").alias("hg0"), F.greatest("hg", "other.hg").alias("hg1")).distinct()


def supported(hg: DataFrame, min_omes: int) -> DataFrame:
    """Rows of the groups in more than ``min_omes`` genomes: no other group can be in a pair of so many."""
    before = F.lag("ome").over(W.partitionBy("hg").orderBy("ome"))
    new = F.when(F.col("ome").isNotNull() & (before.isNull() | (before != F.col("ome"))), 1)
    counted = hg.where("hg IS NOT NULL").withColumn("_new", new).withColumn("_n", F.count("_new").over(W.partitionBy("hg")))
    return counted.where(F.col("_n") > min_omes).drop("_new", "_n")


def frequent_pairs(positions: DataFrame, hg: DataFrame, plusminus: int, min_omes: int = 2) -> DataFrame:
    """``cooccurrence`` of the pairs of groups, of which groups in too few genomes are left out before pairs are made; their genes keep their places."""
    return cooccurrence(hg_pairs(positions, supported(hg, min_omes), plusminus), min_omes)


def cooccurrence(pairs: DataFrame, min_omes: int = 2) -> DataFrame:
    """(hg0, hg1, n_omes, omes): pairs in more than ``min_omes`` genomes; genomes are gathered only for those, where the pairs were moved to be counted."""
    kept = pairs.withColumn("_n", F.count("*").over(W.partitionBy("hg0", "hg1"))).where(F.col("_n") > min_omes)
    return kept.groupBy("hg0", "hg1").agg(F.count("*").alias("n_omes"), F.array_join(F.array_sort(F.collect_set("ome")), ",").alias("omes"))


def microsynteny_matrix(pairs: DataFrame, focal: DataFrame, n_genomes: int) -> DataFrame:
    """(ome, hg0, hg1): pairs that touch a focal group and are not in every genome, long."""
    ids = focal.select("hg").distinct()
    touching = pairs.join(ids.withColumnRenamed("hg", "hg0"), "hg0", "left_semi").unionByName(pairs.join(ids.withColumnRenamed("hg", "hg1"), "hg1", "left_semi")).distinct()
    part = touching.groupBy("hg0", "hg1").agg(F.count("*").alias("n")).where(F.col("n") < n_genomes)
    return touching.join(part.select("hg0", "hg1"), ["hg0", "hg1"], "left_semi").select("ome", "hg0", "hg1")


def choose_focal_groups(stats: DataFrame, least: int = 10) -> DataFrame:
    """Groups at the first step of loosening limits (deviation 0.2 to 2 by 0.2, then a median more) that gives ``least`` of them; single-copy ones alone if there are ten or more."""
    single = stats.where("most = 1")
    step = F.greatest(F.ceil(F.coalesce(F.col("deviation"), F.lit(0.0)) / 0.2), F.lit(1)) + (F.greatest(F.col("median"), F.lit(1)) - 1) * 10
    graded = stats.where("coalesce(deviation, 0) <= 2").withColumn("step", step)
    counts = graded.groupBy("step").agg(F.count("*").alias("k"))
    enough = counts.withColumn("sum", F.sum("k").over(W.partitionBy(F.lit(0)).orderBy("step"))).where(F.col("sum") >= least).agg(F.min("step").alias("cut"))
    loose = with_scalars(graded, enough).where(F.col("step") <= F.coalesce("cut", F.lit(1e9))).select("hg")
    flag = single.agg((F.count("*") > 9).alias("plenty"))
    return with_scalars(single.select("hg"), flag).where("plenty").select("hg").unionByName(with_scalars(loose, flag).where("NOT plenty").select("hg"))


def genes_to_groups(genes: DataFrame, hg: DataFrame) -> DataFrame:
    """Genes (gene) with their group, null where there is none."""
    return genes.join(hg.select("gene", "hg"), "gene", "left")


INDEXES = {"jaccard": C.jaccard, "sorensen": C.sorensen, "overlap": C.overlap}


def locus_similarity(loci: DataFrame, queries: DataFrame, hits: DataFrame | None = None, index: str = "jaccard") -> DataFrame:
    """(ome, locus, shared, similarity) of loci (ome, locus, gene, hg) to the query groups (hg), two shared groups at least; with ``hits`` (gene, hg, pident) times the mean over shared groups of the best identity."""
    asked = queries.select("hg").distinct()
    total = asked.agg(F.count("*").alias("n0"))
    held = staged(loci.where("hg IS NOT NULL").select("ome", "locus", "hg").distinct(), "loci")
    n1 = held.groupBy("ome", "locus").agg(F.count("*").alias("n1"))
    both = held.join(asked, "hg", "left_semi").groupBy("ome", "locus").agg(F.count("*").alias("shared")).where("shared > 1")
    out = with_scalars(both.join(n1, ["ome", "locus"]), total).withColumn("similarity", INDEXES[index](F.col("shared"), F.col("n0"), F.col("n1")))
    if hits is not None:
        best = loci.join(hits, ["gene", "hg"]).join(asked, "hg", "left_semi").groupBy("ome", "locus", "hg").agg(F.max("pident").alias("p")).groupBy("ome", "locus").agg(F.avg("p").alias("p"))
        out = out.join(best, ["ome", "locus"]).withColumn("similarity", F.col("similarity") * F.col("p") / 100)
    return out.select("ome", "locus", "shared", "similarity")


def best_loci(similarity: DataFrame, loci: DataFrame) -> DataFrame:
    """(ome, gene, hg) of the most similar locus of each genome; equals are merged."""
    top = similarity.withColumn("_r", F.rank().over(W.partitionBy("ome").orderBy(F.desc("similarity")))).where("_r = 1").select("ome", "locus")
    return loci.join(top, ["ome", "locus"], "left_semi").select("ome", "gene", "hg").distinct()


def recurrent_neighbours(loci: DataFrame, queries: DataFrame) -> DataFrame:
    """(hg, n): groups outside the query that more than one gene of the loci has."""
    return loci.where("hg IS NOT NULL").join(queries.select("hg").distinct(), "hg", "left_anti").groupBy("hg").agg(F.count("*").alias("n")).where("n > 1")
