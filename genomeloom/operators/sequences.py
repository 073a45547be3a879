"""Sequences by accession and coordinates, assembly statistics, and sequences built from annotation.

Sequence tables have (ome, seqid, sequence). Ranges of contigs are cut from tiles of fixed
length, which a contig gives in one pass, so that a long contig with many genes is read once
and no task joins the whole of it with each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.functions.columns import count_of, ome_of, reverse_complement, translate_dna
from genomeloom.operators.features import coding_cds, gene_positions

LONG = 1000


def assembly_stats(contigs: DataFrame) -> DataFrame:
    """N50 figures, contig counts, sizes, GC and masked shares of each genome, of all contigs and of those from 1000 bases.

    N50 is the first contig by falling length at which the running sum reaches half of the
    total; ``_long`` asks for half of the long contigs' total and a length of at least
    1000, and is null if there is none. Equal lengths count in order of seqid.
    """
    size = F.length("sequence").cast("long")
    rows = contigs.select("ome", "seqid", size.alias("size"), count_of(F.col("sequence"), "acgtACGT").cast("long").alias("acgt"), count_of(F.col("sequence"), "gcGC").cast("long").alias("gc"), count_of(F.col("sequence"), "acgt").cast("long").alias("masked")).where("size > 0")
    genome = W.partitionBy("ome")
    order = genome.orderBy(F.desc("size"), "seqid")
    ranked = rows.withColumns(
        {
            "run": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)),
            "rank": F.row_number().over(order),
            "total": F.sum("size").over(genome),
            "total_long": F.sum(F.when(F.col("size") >= LONG, F.col("size"))).over(genome),
        }
    )
    half = F.col("run") * 2 >= F.col("total")
    half_long = (F.col("size") >= LONG) & (F.col("run") * 2 >= F.col("total_long"))
    long_only = lambda c: F.sum(F.when(F.col("size") >= LONG, F.col(c)))
    share = lambda a, b: F.when(b > 0, F.round(100.0 * a / b, 4))
    out = ranked.groupBy("ome").agg(
        F.max(F.when(half, F.col("size"))).alias("n50"),
        F.min(F.when(half, F.col("rank"))).alias("l50"),
        F.max(F.when(half_long, F.col("size"))).alias("n50_long"),
        F.min(F.when(half_long, F.col("rank"))).alias("l50_long"),
        F.max("size").alias("largest"),
        F.min("size").alias("shortest"),
        F.count("*").alias("contigs"),
        F.count(F.when(F.col("size") >= LONG, 1)).alias("contigs_long"),
        F.sum("size").alias("length"),
        F.coalesce(long_only("size"), F.lit(0)).alias("length_long"),
        share(F.sum("gc"), F.sum("acgt")).alias("gc"),
        share(long_only("gc"), long_only("acgt")).alias("gc_long"),
        share(F.sum("masked"), F.sum("size")).alias("masked"),
        share(long_only("masked"), long_only("size")).alias("masked_long"),
    )
    return out.withColumn("l50_percent", F.round(100.0 * F.col("l50") / F.col("contigs"), 4))


def fetch_sequences(accessions: DataFrame, proteins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): sequences of the accessions (seqid), and those that no genome has."""
    asked = accessions.select("seqid").distinct().withColumn("ome", ome_of(F.col("seqid")))
    found = proteins.join(asked, ["ome", "seqid"], "left_semi")
    return found, asked.join(proteins.select("ome", "seqid"), ["ome", "seqid"], "left_anti")


def _piece(sequence: Column, a: Column, b: Column) -> Column:
    """Letters a up to b, counted from 0, b exclusive; empty if there are none."""
    return F.when(b > F.greatest(a, F.lit(0)), F.substring(sequence, F.greatest(a, F.lit(0)) + 1, b - F.greatest(a, F.lit(0)))).otherwise(F.lit(""))


def _coordinates(accessions: DataFrame) -> DataFrame:
    pattern = r"^(.*)\[(\d+)[:-](\d+)\]$"
    part = lambda k: F.regexp_extract("accession", pattern, k)
    return accessions.select("accession", F.when(part(1) != "", part(1)).otherwise(F.col("accession")).alias("seqid"), part(2).try_cast("int").alias("s"), part(3).try_cast("int").alias("e"))


def fetch_subsequences(accessions: DataFrame, proteins: DataFrame) -> DataFrame:
    """``acc[s:e]`` or ``acc[s-e]``: letters s to e from 0, both included; if s is not below e, the reverse complement of e - 1 to s; without coordinates the whole."""
    at = _coordinates(accessions).withColumn("ome", ome_of(F.col("seqid")))
    s, e, seq = F.col("s"), F.col("e"), F.col("sequence")
    cut = F.when(s.isNull(), seq).when(s < e, _piece(seq, s, e + 1)).otherwise(reverse_complement(_piece(seq, e - 1, s + 1)))
    return proteins.join(at, ["ome", "seqid"]).select("accession", "ome", "seqid", cut.alias("sequence"))


def fetch_subsequences_1based(accessions: DataFrame, sequences: DataFrame) -> DataFrame:
    """``acc[s-e]`` counted from 1, both included; reversed coordinates give the reverse complement."""
    at = _coordinates(accessions)
    s, e, seq = F.col("s"), F.col("e"), F.col("sequence")
    cut = F.when(s.isNull(), seq).when(s <= e, _piece(seq, s - 1, e)).otherwise(reverse_complement(_piece(seq, e - 1, s)))
    return sequences.join(at, "seqid").select("accession", "seqid", cut.alias("sequence"))


def extract_regions(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, sequence, overrun) of coordinate rows (ome, seqid, start, end, strand, name).

    A row is cut from 0, half open, between the smaller and the larger coordinate; end -1
    drops the last base; ``-`` is reverse complemented. Rows of one name are joined in
    order of coordinates, falling for ``-``; names that mix strands are left out.
    """
    size = F.length("sequence")
    end = F.when(F.col("end") == -1, size - 1).otherwise(F.col("end"))
    lo, hi = F.least("start", end), F.greatest("start", end)
    cut = _piece(F.col("sequence"), lo, F.least(hi, size))
    rows = regions.join(contigs.select("ome", "seqid", "sequence"), ["ome", "seqid"]).select("name", "strand", lo.alias("lo"), (hi > size).alias("over"), F.when(F.col("strand") == "-", reverse_complement(cut)).otherwise(cut).alias("piece"))
    key = F.when(F.col("strand") == "-", -F.col("lo")).otherwise(F.col("lo"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "piece"))), lambda x: x["piece"]), "")
    out = rows.groupBy("name").agg(joined.alias("sequence"), F.max("over").alias("overrun"), F.countDistinct("strand").alias("strands"))
    return out.where("strands = 1").drop("strands")


TILE = 20_000


def cut_ranges(ranges: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ome, id, sequence): the bases lo to hi, from 1 and inclusive, of the rows (ome, seqid, id, lo, hi) of each id, joined in order of lo; what lies outside a contig is left out."""
    tiles = contigs.select("ome", "seqid", F.posexplode(F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0))).alias("tile", "text"))
    lo, hi = F.greatest(F.col("lo"), F.lit(1)), F.greatest(F.col("hi"), F.lit(1))
    touched = F.sequence(F.floor((lo - 1) / TILE).cast("int"), F.greatest(F.floor((hi - 1) / TILE), F.floor((lo - 1) / TILE)).cast("int"))
    met = ranges.distinct().withColumn("tile", F.explode(touched)).join(tiles, ["ome", "seqid", "tile"], "left")
    base = F.col("tile") * TILE
    first, last = F.greatest(F.col("lo") - base, F.lit(1)).cast("int"), F.least(F.col("hi") - base, F.lit(TILE)).cast("int")
    piece = F.when(last >= first, F.substring("text", first, last - first + 1))
    pieces = met.select("ome", "id", F.struct("lo", "tile", F.coalesce(piece, F.lit("")).alias("piece")).alias("x"))
    return pieces.groupBy("ome", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("sequence"))


def _oriented(rows: DataFrame) -> Column:
    return F.when(F.col("id.strand") == "-", reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))


def cds_from_gff(gff: DataFrame, contigs: DataFrame, flank: int = 0) -> DataFrame:
    """(ome, alias, sequence): coding bases of each protein-coding gene, in reading order; ``flank`` adds so many bases before a contig's first gene and after its last one, as far as the contig goes."""
    cds = coding_cds(gff).select("ome", "seqid", F.struct("alias", "strand").alias("id"), F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"))
    if flank:
        # the contig's first and last coding base, found by partial sums
        ends = cds.groupBy("ome", "seqid").agg(F.min("lo").alias("c0"), F.max("hi").alias("c1"))
        cds = cds.join(ends, ["ome", "seqid"]).select("ome", "seqid", "id", F.when(F.col("lo") == F.col("c0"), F.col("lo") - flank).otherwise(F.col("lo")).alias("lo"), F.when(F.col("hi") == F.col("c1"), F.col("hi") + flank).otherwise(F.col("hi")).alias("hi"))
    whole = cut_ranges(cds, contigs)
    return whole.select("ome", F.col("id.alias").alias("alias"), _oriented(whole).alias("sequence"))


def proteins_from_gff(gff: DataFrame, contigs: DataFrame) -> DataFrame:
    return cds_from_gff(gff, contigs).withColumn("sequence", translate_dna(F.col("sequence")))


def translate_fasta(sequences: DataFrame) -> DataFrame:
    """Nucleotide records as protein records, all other columns kept."""
    return sequences.withColumn("sequence", translate_dna(F.col("sequence")))


def gene_spans(gff: DataFrame, contigs: DataFrame, flank: int = 0) -> DataFrame:
    """(ome, alias, sequence, before, after): bases from a gene's first to last CDS, introns included, with what ``flank`` the contig has."""
    span = coding_cds(gff).groupBy("ome", "seqid", "alias", "strand").agg(F.min(F.least("start", "end")).alias("lo"), F.max(F.greatest("start", "end")).alias("hi"))
    at = span.join(contigs.select("ome", "seqid", F.length("sequence").alias("size")), ["ome", "seqid"])
    before = F.least(F.lit(flank), F.col("lo") - 1)
    after = F.greatest(F.lit(0), F.least(F.lit(flank), F.col("size") - F.col("hi")))
    ranges = at.select("ome", "seqid", F.struct("alias", "strand", before.alias("before"), after.alias("after")).alias("id"), (F.col("lo") - before).alias("lo"), (F.col("hi") + after).alias("hi"))
    whole = cut_ranges(ranges, contigs)
    return whole.select("ome", F.col("id.alias").alias("alias"), _oriented(whole).alias("sequence"), F.col("id.before").alias("before"), F.col("id.after").alias("after"))


def region_sequences(gff: DataFrame, contigs: DataFrame, flank: int = 0) -> DataFrame:
    """(ome, seqid, sense, antisense): each contig from its first to its last gene."""
    ends = gene_positions(gff).groupBy("ome", "seqid").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    ranges = ends.join(contigs.select("ome", "seqid"), ["ome", "seqid"]).select("ome", "seqid", F.col("seqid").alias("id"), (F.col("lo") - flank).alias("lo"), (F.col("hi") + flank).alias("hi"))
    whole = cut_ranges(ranges, contigs)
    return whole.select("ome", F.col("id").alias("seqid"), F.col("sequence").alias("sense"), reverse_complement(F.col("sequence")).alias("antisense"))


def prefix_contigs(rows: DataFrame) -> DataFrame:
    """``seqid`` with the genome's code before it; an older version of the code is replaced."""
    base = F.regexp_replace("ome", r"\.\d+$", "")
    bare = F.when(F.col("seqid").startswith(F.concat("ome", F.lit("_"))), F.expr("substring(seqid, length(ome) + 2)")).when(F.regexp_extract("seqid", r"^([A-Za-z.]+\d+)(?:\.\d+)?_", 1) == base, F.regexp_replace("seqid", r"^[A-Za-z.]+\d+(?:\.\d+)?_", "")).otherwise(F.col("seqid"))
    return rows.withColumn("seqid", F.concat("ome", F.lit("_"), bare))


def proteome_qc(proteins: DataFrame) -> DataFrame:
    """(ome, n, n_empty, rejected): genomes without any non-empty protein are rejected."""
    empty = F.length(F.translate("sequence", "*", "")) == 0
    out = proteins.groupBy("ome").agg(F.count("*").alias("n"), F.count(F.when(empty | F.col("sequence").isNull(), 1)).alias("n_empty"))
    return out.withColumn("rejected", F.col("n") == F.col("n_empty"))


