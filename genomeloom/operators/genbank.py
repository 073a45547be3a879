"""Flat-file text of annotated contigs, laid out by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeloom.functions.columns import gff3_attr

# Fixed values of the format: where keys and locations begin, letters of a line of protein and of bases.
KEY, PLACE = 5, 21
FIRST_LINE, LINE, BASES = 45, 59, 60
#: Bases of a row of the sequence section: a whole number of lines.
TILE = 1000 * BASES


def _place(lo: Column, hi: Column, strand: Column) -> Column:
    span = F.concat(lo.cast("string"), F.lit(".."), hi.cast("string"))
    return F.when(strand == "-", F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)


def _note(name: str, value: Column) -> Column:
    """A qualifier's line; null if it has no value."""
    return F.concat(F.lit(" " * PLACE + f'/{name}="'), value, F.lit('"\n'))


def _feature(kind: Column, place: Column, *notes: Column) -> Column:
    return F.concat(F.lit(" " * KEY), F.rpad(kind, PLACE - KEY, " "), place, F.lit("\n"), *(F.coalesce(n, F.lit("")) for n in notes))


def _wrapped(protein: Column) -> Column:
    rest = F.regexp_extract_all(F.expr(f"substring(protein, {FIRST_LINE + 1})"), F.lit(f".{{1,{LINE}}}"), F.lit(0))
    return F.array_join(F.concat(F.array(F.substring(protein, 1, FIRST_LINE)), rest), "\n" + " " * PLACE)


def _origin(tile: Column) -> Column:
    """Numbered lines of a tile of bases, 60 each, in groups of ten; ``at`` counts the bases before it."""
    lines = F.regexp_extract_all(F.lower(tile), F.lit(f".{{1,{BASES}}}"), F.lit(0))
    spaced = F.transform(lines, lambda x, i: F.concat(F.lpad((F.col("at") + i * BASES + 1).cast("string"), 9, " "), F.lit(" "), F.rtrim(F.regexp_replace(x, "(.{10})", "$1 "))))
    return F.array_join(spaced, "\n")


def _tiles(ends: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ome, seqid, at, tile): the bases c0 to c1 of each contig in tiles of whole lines, and the bases before them; what lies outside the contig is left out."""
    lo, hi = F.greatest("c0", F.lit(1)), F.least("c1", F.length("sequence"))
    starts = F.when(hi >= lo, F.sequence(lo, hi, F.lit(TILE).cast("long")))
    tiles = F.transform(starts, lambda x: F.struct((x - lo).alias("at"), F.substring("sequence", x.cast("int"), F.least(hi - x + 1, F.lit(TILE)).cast("int")).alias("tile")))
    return contigs.join(ends, ["ome", "seqid"]).select("ome", "seqid", F.explode(tiles).alias("t")).select("ome", "seqid", "t.at", "t.tile")


def genbank_blocks(gff: DataFrame, contigs: DataFrame, proteins: DataFrame, catalog: DataFrame) -> DataFrame:
    """(ome, seqid, section, place, block): records of contigs over their features (gff) as blocks of whole lines, coordinates counted from the first feature.

    In order of genome, contig, section and place the blocks are the flat file: 0 the head, 1 the features, a block each,
    2 the bases, a block for each tile, 3 the end. No row holds a contig's record.

    Genes stand in order of start; under each its RNA, placed as its CDS where it has one, and one CDS of all its parts
    with the protein of its alias (proteins: ome, alias, sequence). The bases reach from the first feature to the last.
    """
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    kind = F.when(F.col("type").isin("gene", "pseudogene"), 0).when(F.col("type").contains("RNA"), 1).when(F.col("type") == "CDS", 2)
    rows = gff.withColumns({"alias": gff3_attr(F.col("attributes"), "Alias"), "product": gff3_attr(F.col("attributes"), "product"), "parent": gff3_attr(F.col("attributes"), "Parent"), "lo": lo, "hi": hi, "k": kind}).where("k IS NOT NULL AND alias IS NOT NULL")
    ends = rows.groupBy("ome", "seqid").agg(F.min("lo").alias("c0"), F.max("hi").alias("c1"))
    placed = rows.join(ends, ["ome", "seqid"]).withColumns({"lo": F.col("lo") - F.col("c0") + 1, "hi": F.col("hi") - F.col("c0") + 1})
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi", "strand"))), lambda x: _place(x["lo"], x["hi"], x["strand"]))
    cds = placed.where("k = 2").groupBy("ome", "seqid", "alias").agg(parts.alias("parts"), F.min("lo").alias("lo"), F.min("source").alias("source"), F.max("product").alias("product"))
    cds = cds.withColumn("place", F.when(F.size("parts") > 1, F.concat(F.lit("join("), F.array_join("parts", ","), F.lit(")"))).otherwise(F.get("parts", F.lit(0))))
    named = cds.join(proteins.select("ome", "alias", F.col("sequence").alias("protein")), ["ome", "alias"], "left")
    translation = F.when(F.col("protein").isNotNull(), F.concat(_note("protein_id", F.col("alias")), F.lit(" " * PLACE + "/transl_table=1\n"), _note("translation", _wrapped(F.col("protein")))))
    tag, product, source = _note("locus_tag", F.col("alias")), _note("product", F.col("product")), _note("source", F.col("source"))
    blocks = named.select("ome", "seqid", "alias", "lo", F.lit(2).alias("k"), _feature(F.lit("CDS"), F.col("place"), tag, product, source, translation).alias("block"))
    others = placed.where("k < 2").join(cds.select("ome", "seqid", "alias", "place"), ["ome", "seqid", "alias"], "left")
    where = F.when(F.col("k") == 1, F.coalesce("place", _place(F.col("lo"), F.col("hi"), F.col("strand")))).otherwise(_place(F.col("lo"), F.col("hi"), F.col("strand")))
    transcript = F.when(F.col("k") == 1, _note("transcript_id", F.col("parent")))
    blocks = blocks.unionByName(others.select("ome", "seqid", "alias", "lo", "k", _feature(F.col("type"), where, tag, product, source, transcript).alias("block")))
    # features of a gene stand together, genes by their first base
    first = blocks.groupBy("ome", "seqid", "alias").agg(F.min("lo").alias("g0"))
    at = lambda *parts: F.struct(*(x.cast(t).alias(n) for x, (n, t) in zip(parts, (("g0", "long"), ("alias", "string"), ("k", "int"), ("lo", "long"))))).alias("place")
    none = F.lit(None)
    features = blocks.join(first, ["ome", "seqid", "alias"]).select("ome", "seqid", F.lit(1).alias("section"), at(F.col("g0"), F.col("alias"), F.col("k"), F.col("lo")), F.rtrim("block", F.lit("\n")).alias("block"))
    sizes = contigs.select("ome", "seqid", F.length("sequence").alias("size"))
    organism = F.concat_ws("_", "genus", "species", "strain", "ome")
    whole = ends.join(sizes, ["ome", "seqid"]).join(catalog.select("ome", F.col("source").alias("archive"), organism.alias("organism")), "ome", "left")
    name = F.concat_ws("_", "ome", "seqid")
    head = F.concat(F.lit("LOCUS       "), name, F.lit("\nDEFINITION  "), name, F.lit("\nACCESSION   "), F.col("seqid"), F.lit("\nVERSION     "), name, F.lit("\nKEYWORDS    .\nSOURCE      "), F.coalesce("archive", F.lit(".")), F.lit("\n  ORGANISM  "), F.coalesce("organism", F.lit(".")), F.lit("\nCOMMENT     coordinates are relative to adjustment: "), (F.col("c0") - 1).cast("string"), F.lit("\n            .\nFEATURES             Location/Qualifiers\n"))
    edge = F.concat((F.col("c0") - 1).cast("string"), F.lit("-;"), (F.col("size") - F.col("c1")).cast("string"), F.lit("+"))
    region = F.concat(F.lit("     region          1.."), (F.col("c1") - F.col("c0") + 1).cast("string"), F.lit("\n" + " " * PLACE + "/contig_edge="), edge)
    heads = whole.select("ome", "seqid", F.lit(0).alias("section"), at(none, none, none, none), F.concat(head, region).alias("block"))
    tiled = _tiles(ends.select("ome", "seqid", F.col("c0").cast("long"), F.col("c1").cast("long")), contigs)
    # the section's own line comes before its first tile
    title = F.when(F.col("at") == 0, F.lit("ORIGIN\n")).otherwise(F.lit(""))
    sequence = tiled.select("ome", "seqid", F.lit(2).alias("section"), at(F.col("at"), none, none, none), F.concat(title, _origin(F.col("tile"))).alias("block"))
    closing = whole.select("ome", "seqid", F.lit(3).alias("section"), at(none, none, none, none), F.lit("//").alias("block"))
    held = features.join(sizes.select("ome", "seqid"), ["ome", "seqid"], "left_semi")
    return heads.unionByName(held).unionByName(sequence).unionByName(closing)


def write_genbank(blocks: DataFrame, path: str) -> None:
    """A folder a genome, in which the parts joined in order of their names are the file; genomes and long contigs are cut into ranges."""
    order = ["ome", "seqid", "section", "place"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("ome", "block").write.partitionBy("ome").text(path)
