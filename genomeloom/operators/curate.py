"""Gene-model curation: every step takes and gives annotation rows with the genome and their place in the file (row).

A step moves its rows once, to their genome's task; all that a row learns from others of its genome is then read by windows
within that task. New rows are exploded from those that call for them. Nothing is joined or moved again. Rows that are dealt by genome
to as many ``tasks`` already are not moved at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from genomeloom.functions.columns import format_og_tags, gff3_attr, gff_dialect, gtf_attr, parse_og_tags, set_attr
from genomeloom.operators.sequences import prefix_contigs, proteins_from_gff, proteome_qc
from genomeloom.sources.shared import staged

# Accepted row types.
KEPT = ("gene", "pseudogene", "mRNA", "tRNA", "rRNA", "RNA", "exon", "intron", "CDS", "five_prime_UTR", "three_prime_UTR")
NAMED = ("gene", "pseudogene")


def _id(name: str = "ID") -> Column:
    return gff3_attr(F.col("attributes"), name)


def is_rna(kind: Column | None = None) -> Column:
    kind = F.col("type") if kind is None else kind
    return kind.contains("RNA")


def normalise_types(gff: DataFrame) -> DataFrame:
    """Types by their accepted names, rows of other types or without ID dropped, proteinId as protein_id, an old Alias removed."""
    kind = F.col("type")
    named = (
        F.when(kind.isin(*KEPT), kind)
        .when(kind.isin("transcript", "ribozyme") | kind.contains("RNA"), "RNA")
        .when(F.lower("type").isin("5'utr", "5'-utr", "five_prime_utr", "5utr", "utr5"), "five_prime_UTR")
        .when(F.lower("type").isin("3'utr", "3'-utr", "three_prime_utr", "3utr", "utr3"), "three_prime_UTR")
    )
    plain = F.regexp_replace(F.regexp_replace("attributes", "(^|;)proteinId=", "$1protein_id="), "(^|;)Alias=[^;]*", "")
    return gff.withColumn("type", named).withColumn("attributes", F.regexp_replace(plain, "^;+", "")).where(F.col("type").isNotNull() & _id().isNotNull())


def _by_genome(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    return gff.repartition("ome") if tasks is None else gff


def _looked_up(rows: DataFrame, key: Column, gives: Column, values: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name in ``values``, the least such value of the rows of their genome that give ``key``; null where ``key`` is null.

    A row that gives something is copied, without its columns, under what it gives; no exchange is planned for rows that are together by genome.
    """
    names = [c for c in rows.columns if c != "ome"]
    given = F.struct(*(v.alias(k) for k, v in values.items()))
    some = gives.isNotNull() & reduce(lambda a, b: a | b, (v.isNotNull() for v in values.values()))
    own = F.struct(key.alias("key"), F.lit(False).alias("gives"), F.when(F.lit(False), given).alias("value"))
    copy = F.struct(gives.alias("key"), F.lit(True).alias("gives"), given.alias("value"))
    copies = rows.withColumn("_x", F.explode(F.when(some, F.array(own, copy)).otherwise(F.array(own))))
    thin = copies.select("ome", *(F.when(~F.col("_x.gives"), F.col(c)).alias(c) for c in names), F.col("_x.key").alias("_key"), F.col("_x.gives").alias("_gives"), F.col("_x.value").alias("_value"))
    met = W.partitionBy("ome", "_key")
    known = F.col("_key").isNotNull() & F.col("ome").isNotNull()
    return thin.withColumns({k: F.when(known, F.min(f"_value.{k}").over(met)) for k in values}).where("NOT _gives").drop("_key", "_gives", "_value")


def _resolved(rows: DataFrame) -> DataFrame:
    """``resolve_parents`` with orphans, of rows that are together by genome."""
    named = rows.withColumn("id", _id()).withColumn("parent", _id("Parent"))
    gene = F.col("type").isin(*NAMED)
    values = {"_m": F.when(is_rna(), F.struct("id", F.col("parent").alias("gene"))), "_g": F.when(gene, F.col("id"))}
    met = _looked_up(named, F.col("parent"), F.when(is_rna() | gene, F.col("id")), values)
    own_gene = F.when(gene, F.col("id")).when(is_rna(), F.col("parent")).otherwise(F.coalesce("_m.gene", "_g"))
    own_rna = F.when(is_rna(), F.col("id")).when(gene, F.lit(None)).otherwise(F.col("_m.id"))
    return met.withColumn("gene", own_gene).withColumn("rna", own_rna).drop("_m", "_g")


def resolve_parents(gff: DataFrame, keep_orphans: bool = False, tasks: int | None = None) -> DataFrame:
    """With id, rna and gene: parts follow Parent to their RNA and its gene, or straight to a gene; orphan parts go unless kept under their own id."""
    out = _resolved(_by_genome(gff, tasks))
    return _kept(out) if keep_orphans else out.where(F.col("gene").isNotNull() | is_rna())


def _kept(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gene", F.coalesce("gene", "rna", "id"))


def _models(gff: DataFrame) -> DataFrame:
    """Rows together by genome, with id, parent, gene and rna; orphans are kept."""
    return _kept(_resolved(gff))


def _gene() -> WindowSpec:
    return W.partitionBy("ome", "gene")


def _like(rows: DataFrame, gff: DataFrame) -> DataFrame:
    return rows.select(*gff.columns)


def complete_models(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """With the rows that models lack: an mRNA for genes with CDS and no RNA, a gene for RNAs without one, exons from CDS where a model has neither exons nor introns."""
    return _completed(_by_genome(gff, tasks))


def _span(of: Column) -> dict[str, Column]:
    """What a new row has from the rows ``of`` its gene: ends over all, the rest from the first."""
    top = F.min(F.when(of, F.struct("row", "seqid", "source", "strand"))).over(_gene())
    return {"row": top["row"], "seqid": top["seqid"], "source": top["source"], "strand": top["strand"], "start": F.min(F.when(of, F.col("start"))).over(_gene()), "end": F.max(F.when(of, F.col("end"))).over(_gene())}


def _completed(gff: DataFrame) -> DataFrame:
    named, cds = F.col("type").isin(*NAMED), F.col("type") == "CDS"
    has = {"_gene": named, "_rna": is_rna(), "_cds": cds, "_parted": F.col("type").isin("exon", "intron")}
    rows = _models(gff).withColumns({**{k: F.max(v).over(_gene()) for k, v in has.items()}, "_of_cds": F.struct(*(v.alias(k) for k, v in _span(cds).items())), "_of_rna": F.struct(*(v.alias(k) for k, v in _span(is_rna()).items())), "_k": F.row_number().over(_gene().orderBy("row"))})
    cols = [c for c in gff.columns if c != "ome"]
    row = lambda span=None, **new: F.struct(*(new.get(c, F.col(f"{span}.{c}") if span and c in ("row", "seqid", "source", "strand", "start", "end") else F.col(c)).alias(c) for c in cols))
    blank = {"score": F.lit("."), "phase": F.lit(".")}
    first = (F.col("_k") == 1) & F.col("gene").isNotNull()
    lacks_rna = F.col("gene").isNotNull() & F.col("_cds") & ~F.col("_rna")
    part = lacks_rna & F.col("type").isin("CDS", "exon") & F.col("rna").isNull()
    kept = row(attributes=F.when(part, set_attr(F.col("attributes"), "Parent", F.concat(F.lit("mRNA_"), "gene"))).otherwise(F.col("attributes")))
    new_rna = row("_of_cds", **blank, type=F.lit("mRNA"), attributes=F.concat(F.lit("ID=mRNA_"), "gene", F.lit(";Parent="), "gene"))
    new_gene = row("_of_rna", **blank, type=F.lit("gene"), attributes=F.concat(F.lit("ID="), "gene"))
    new_exon = row(**blank, type=F.lit("exon"), attributes=F.concat(F.lit("ID=exon_"), "id", F.lit("_"), F.col("start").cast("string"), F.lit(";Parent="), F.coalesce("rna", F.concat(F.lit("mRNA_"), "gene"))))
    made = F.array(kept, F.when(first & lacks_rna, new_rna), F.when(first & F.col("_rna") & ~F.col("_gene"), new_gene), F.when(cds & ~F.col("_parted") & F.col("gene").isNotNull(), new_exon))
    return _like(rows.select("ome", F.explode(F.array_compact(made)).alias("x")).select("ome", "x.*"), gff)


def exons_from_introns(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """Exon rows of genes that have introns and no exons: from the gene's start to the first intron, between introns, and to its end."""
    named = F.col("type").isin(*NAMED)
    rows = _models(_by_genome(gff, tasks)).withColumns({"_exon": F.max(F.col("type") == "exon").over(_gene()), "g0": F.min(F.when(named, F.col("start"))).over(_gene()), "g1": F.max(F.when(named, F.col("end"))).over(_gene())})
    introns = rows.where("type = 'intron' AND NOT _exon AND g0 IS NOT NULL AND gene IS NOT NULL")
    order = _gene().orderBy("start", "end")
    placed = introns.withColumns({"_before": F.lag("end").over(order), "_last": F.lead("end").over(order).isNull(), "_far": F.max("end").over(_gene()), "_row": F.max("row").over(_gene())})
    before = F.struct("row", F.coalesce(F.col("_before") + 1, F.col("g0")).alias("e0"), (F.col("start") - 1).alias("e1"))
    last = F.struct(F.col("_row").alias("row"), (F.col("_far") + 1).alias("e0"), F.col("g1").alias("e1"))
    pieces = placed.select("ome", "seqid", "source", "strand", "parent", "gene", F.explode(F.array_compact(F.array(before, F.when(F.col("_last"), last)))).alias("x")).select("*", "x.*").where("e1 >= e0")
    made = pieces.select("ome", "row", "seqid", "source", F.lit("exon").alias("type"), F.col("e0").alias("start"), F.col("e1").alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("phase"), F.concat(F.lit("ID=exon_"), "gene", F.lit("_"), F.col("e0").cast("string"), F.lit(";Parent="), F.coalesce("parent", "gene")).alias("attributes"))
    return _like(made, gff)


def isoform_spans(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """(ome, gene, rna, protein, start, end): for genes whose CDS name several proteins, one transcript -T0, -T1, .. over the CDS of each, in order of start and protein."""
    cds = resolve_parents(gff, True, tasks).where("type = 'CDS'").withColumn("protein", F.coalesce(_id("protein_id"), _id("proteinId")))
    spans = cds.where("protein IS NOT NULL").groupBy("ome", "gene", "protein").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    group = W.partitionBy("ome", "gene")
    ranked = spans.withColumn("n", F.count("*").over(group)).withColumn("k", F.row_number().over(group.orderBy("start", "protein")) - 1)
    return ranked.where("n > 1").select("ome", "gene", F.concat("gene", F.lit("-T"), F.col("k").cast("string")).alias("rna"), "protein", "start", "end")


def split_isoforms(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """``gff`` with the transcripts of ``isoform_spans``: in their genes they take the place of the RNAs, each CDS gets its protein's as Parent, and the exons are those of the CDS."""
    protein = F.coalesce(_id("protein_id"), _id("proteinId"))
    own = W.partitionBy("ome", "gene", "_p")
    rows = _models(_by_genome(gff, tasks)).withColumn("_p", F.when(F.col("type") == "CDS", protein)).withColumn("_at", F.when(F.col("_p").isNotNull() & F.col("gene").isNotNull(), F.struct(F.min("start").over(own).alias("a"), F.col("_p").alias("p"), F.max("end").over(own).alias("b"))))
    # the proteins of a gene in order of start and name
    spans = rows.withColumn("_all", F.array_sort(F.collect_set("_at").over(_gene())))
    name = lambda k: F.concat("gene", F.lit("-T"), k.cast("string"))
    cols = [c for c in gff.columns if c != "ome"]
    row = lambda **new: F.struct(*(new.get(c, F.col(c)).alias(c) for c in cols))
    two, tx = F.size("_all") > 1, name(F.array_position("_all", F.col("_at")) - 1)
    made = F.transform("_all", lambda x, k: row(type=F.lit("mRNA"), start=x["a"], end=x["b"], attributes=F.concat(F.lit("ID="), name(k), F.lit(";Parent="), "gene", F.lit(";protein_id="), x["p"])))
    cds = row(attributes=set_attr(F.col("attributes"), "Parent", tx))
    exon = row(type=F.lit("exon"), phase=F.lit("."), attributes=F.concat(F.lit("ID=exon_"), "id", F.lit(";Parent="), tx))
    out = F.when(~two, F.array(row())).when(F.col("type").isin(*NAMED), F.concat(F.array(row()), made)).when(F.col("_at").isNotNull(), F.array(cds, exon))
    return _like(spans.select("ome", F.explode(out).alias("x")).select("ome", "x.*"), gff)


def dedupe_equal_models(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """(ome, gene, rna): transcripts kept when those of a gene with equal CDS coordinates become one, the first."""
    cds = resolve_parents(gff, True, tasks).where("type = 'CDS' AND rna IS NOT NULL")
    models = cds.groupBy("ome", "gene", "rna").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("at"), F.min("row").alias("row"))
    return models.withColumn("k", F.row_number().over(W.partitionBy("ome", "gene", "at").orderBy("row", "rna"))).where("k = 1").select("ome", "gene", "rna")


def assign_aliases(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows with Alias: an RNA's is ome_protein, else a counter of its class in file order; a gene has its RNAs' joined by ``|``, parts have their RNA's."""
    named, rna = F.col("type").isin(*NAMED), W.partitionBy("ome", "rna")
    rows = _models(_by_genome(gff, tasks)).withColumn("_p", F.when(F.col("rna").isNotNull(), F.min(F.when(F.col("type") == "CDS", F.coalesce(_id("protein_id"), _id("proteinId")))).over(rna)))
    rows = rows.withColumns({"_pseudo": F.max(F.col("type") == "pseudogene").over(_gene()), "_bare": named & ~F.max(is_rna()).over(_gene())})
    kind = F.when(F.col("_pseudo") & F.col("gene").isNotNull(), F.when(F.col("type") == "tRNA", "pseudo-tRNA").otherwise("pseudogene")).when(F.col("type") == "mRNA", "mtdb").when(F.col("type").isin("tRNA", "rRNA"), F.col("type")).otherwise("RNA")
    bare = F.when(F.col("type") == "pseudogene", "pseudogene").otherwise("etc")
    # what is counted together: RNAs of a kind with or without protein, genes without RNA of a type
    klass = F.when(is_rna(), F.concat(F.when(F.col("_p").isNull(), "-").otherwise("+"), kind)).when(F.col("_bare"), F.concat(F.lit("="), "type"))
    counted = rows.withColumn("_class", klass).withColumn("_k", F.row_number().over(W.partitionBy("ome", "_class").orderBy("row", F.coalesce("rna", "gene"))).cast("string"))
    own = F.when(is_rna(), F.when(F.col("_p").isNotNull(), F.concat_ws("_", "ome", "_p")).otherwise(F.concat("ome", F.lit("_"), kind, "_k")))
    alone = F.when(F.col("_bare"), F.concat("ome", F.lit("_"), bare, "_k"))
    named_rna = counted.withColumns({"_own": own, "_alone": alone})
    whole = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("_own").isNotNull(), F.struct("row", F.col("_own").alias("alias")))).over(_gene())), lambda x: x["alias"]), "|")
    joined = named_rna.withColumn("_whole", F.when(F.col("gene").isNotNull(), F.coalesce(F.when(whole != "", whole), F.min("_alone").over(_gene())))).withColumn("_alias", F.when(F.col("rna").isNotNull(), F.min("_own").over(rna)))
    final = F.when(named, F.col("_whole")).otherwise(F.coalesce("_alias", "_whole"))
    return _like(joined.withColumn("attributes", F.when(final.isNull(), F.col("attributes")).otherwise(set_attr(F.col("attributes"), "Alias", final))), gff)


def rename_and_organise(gff: DataFrame, tasks: int | None = None) -> DataFrame:
    """ID and Parent made from the aliases, parts numbered; rows by contig, gene, then gene, RNA and parts."""
    rows = _models(_by_genome(gff, tasks)).withColumn("alias", _id("Alias"))
    number = F.row_number().over(W.partitionBy("ome", "alias", "type").orderBy("start", "row"))
    prefix = F.when(F.col("type").isin(*NAMED), F.lit("gene_")).when(is_rna(), F.lit("RNA_")).otherwise(F.concat("type", F.lit("_")))
    tail = F.when(F.col("type").isin(*NAMED) | is_rna(), F.lit("")).otherwise(F.concat(F.lit("_"), number.cast("string")))
    gene_alias = F.when(F.col("gene").isNotNull(), F.min(F.when(F.col("type").isin(*NAMED), F.col("alias"))).over(_gene()))
    joined = rows.withColumn("_id", F.concat(prefix, "alias", tail)).withColumn("_ga", gene_alias)
    parent = F.when(F.col("type").isin(*NAMED), F.lit(None)).when(is_rna(), F.concat(F.lit("gene_"), "_ga")).otherwise(F.concat(F.lit("RNA_"), "alias"))
    plain = set_attr(F.col("attributes"), "ID", F.col("_id"))
    named = F.when(parent.isNotNull(), set_attr(plain, "Parent", parent)).otherwise(plain)
    rank = F.when(F.col("type").isin(*NAMED), 0).when(is_rna(), 1).when(F.col("type") == "exon", 2).otherwise(3)
    first = F.min("start").over(W.partitionBy("ome", "seqid", "gene"))
    done = joined.withColumn("attributes", F.when(F.col("_id").isNull(), F.col("attributes")).otherwise(named)).withColumn("_f", first).withColumn("_k", rank)
    return _like(done.sortWithinPartitions("ome", "seqid", "_f", "gene", "_k", "start"), gff)


def gtf_to_gff3(gtf: DataFrame, prefix: Column, tasks: int | None = None) -> DataFrame:
    """Gene and transcript rows over their parts, then the parts; an RNA with CDS is mRNA; genes are numbered by contig and start; start and stop codons go and reversed coordinates turn."""
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    attrs = F.col("attributes")
    rows = _by_genome(gtf, tasks).where("type NOT IN ('start_codon', 'stop_codon', 'gene', 'transcript', 'mRNA')").withColumns({"start": lo, "end": hi, "gene": gtf_attr(attrs, "gene_id"), "tx": F.coalesce(gtf_attr(attrs, "transcript_id"), gtf_attr(attrs, "gene_id"))}).where("gene IS NOT NULL")
    gene, tx = W.partitionBy("ome", "gene"), W.partitionBy("ome", "gene", "tx")
    cols = [c for c in gtf.columns if c != "ome"]

    def span(over: WindowSpec) -> Column:
        """Ends over all parts, the rest from the first."""
        top = F.min(F.struct("row", "seqid", "source", "strand")).over(over)
        return F.struct(*(top[c].alias(c) for c in ("row", "seqid", "source", "strand")), F.min("start").over(over).alias("start"), F.max("end").over(over).alias("end"))

    rows = rows.withColumns({"_gene": span(gene), "_g": F.row_number().over(gene.orderBy("row"))})
    rows = rows.withColumns({"_tx": span(tx), "_coding": F.max(F.col("type") == "CDS").over(tx), "_t": F.row_number().over(tx.orderBy("row"))})
    # parts of a gene are equal in this order, so genes are counted
    number = F.dense_rank().over(W.partitionBy("ome").orderBy("_gene.seqid", "_gene.start", "gene"))
    k = F.row_number().over(W.partitionBy("ome", "tx", "type").orderBy("start", "row"))
    named = rows.withColumns({"_alias": F.concat(prefix, F.lit("_"), number.cast("string")), "_k": k.cast("string")})
    row = lambda of=None, **new: F.struct(*(new.get(c, F.col(f"{of}.{c}") if of and c in ("row", "seqid", "source", "strand", "start", "end") else F.col(c)).alias(c) for c in cols))
    dot = {"score": F.lit("."), "phase": F.lit(".")}
    tail = F.concat(F.lit(";Alias="), "_alias")
    gene_row = row("_gene", **dot, type=F.lit("gene"), attributes=F.concat(F.lit("ID=gene_"), "gene", tail))
    tx_row = row("_tx", **dot, type=F.when(F.col("_coding"), "mRNA").otherwise("RNA"), attributes=F.concat(F.lit("ID=RNA_"), "tx", F.lit(";Parent=gene_"), "gene", tail))
    part = row(attributes=F.concat(F.lit("ID="), "type", F.lit("_"), "tx", F.lit("_"), "_k", F.lit(";Parent=RNA_"), "tx", tail))
    made = F.array(part, F.when(F.col("_g") == 1, gene_row), F.when(F.col("_t") == 1, tx_row))
    return _like(named.select("ome", F.explode(F.array_compact(made)).alias("x")).select("ome", "x.*"), gtf)


def gff2_to_gff3(gff: DataFrame) -> DataFrame:
    """Attributes ``name "x"; proteinId 1; transcriptId 2`` as ID, Parent, Alias and product; exons and CDS are numbered within their gene."""
    attrs = F.col("attributes")
    first = lambda c: F.first(c, ignorenulls=True).over(W.partitionBy("ome", "name").orderBy("row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = gff.withColumns({"name": gtf_attr(attrs, "name"), "p": gtf_attr(attrs, "proteinId"), "q": gtf_attr(attrs, "product_name")}).where("name IS NOT NULL")
    rows = rows.withColumn("alias", F.concat_ws("_", "ome", F.coalesce(first(F.col("p")), F.col("name")))).withColumn("q", first(F.col("q")))
    k = F.row_number().over(W.partitionBy("ome", "name", "type").orderBy("row"))
    tail = F.when(F.col("q").isNotNull(), F.concat(F.lit(";product="), "q")).otherwise(F.lit(""))
    made = F.when(F.col("type") == "gene", F.concat(F.lit("ID=gene_"), "name", F.lit(";Alias="), "alias", tail)).when(is_rna(), F.concat(F.lit("ID=RNA_"), "name", F.lit(";Parent=gene_"), "name", F.lit(";Alias="), "alias", tail)).otherwise(F.concat(F.lit("ID="), "type", F.lit("_"), "name", F.lit("_"), k.cast("string"), F.lit(";Parent=RNA_"), "name", F.lit(";Alias="), "alias"))
    return _like(rows.withColumn("attributes", made), gff)


def add_models(new: DataFrame, ref: DataFrame, tasks: int | None = None) -> DataFrame:
    """New models completed and named ome_manualN, counted on from the reference's; a gene with several RNAs is an error."""
    top = ref.withColumn("k", F.regexp_extract(_id("Alias"), r"_manual(\d+)", 1).try_cast("int")).groupBy("ome").agg(F.max("k").alias("top"))
    named = F.col("type").isin(*NAMED)
    rows = _models(_completed(_by_genome(new, tasks))).withColumn("_n", F.count(F.when(is_rna(), 1)).over(_gene())).withColumn("_named", named)
    counted = rows.withColumn("_k", F.row_number().over(W.partitionBy("ome", "_named").orderBy("row", "gene"))).join(top, "ome", "left")
    number = (F.coalesce("top", F.lit(0)) + F.col("_k")).cast("string")
    alias = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several RNAs of "), "gene"))).otherwise(F.concat("ome", F.lit("_manual"), number))
    joined = counted.withColumn("_alias", F.min(F.when(named & F.col("gene").isNotNull(), alias)).over(_gene())).where("_alias IS NOT NULL")
    return _like(joined.withColumn("attributes", set_attr(F.col("attributes"), "Alias", F.col("_alias"))), new)


def upsert_og_tags(tags: DataFrame, ogs: DataFrame, tag: str) -> DataFrame:
    """(gene, tags) with the group of ``ogs`` (gene, hg) under ``tag``, new or in place of the old one."""
    new = ogs.groupBy("gene").agg(F.max("hg").cast("string").alias("hg"))
    both = tags.join(new, "gene", "full")
    held = F.map_filter(F.coalesce(parse_og_tags(F.col("tags")), F.create_map().cast("map<string,string>")), lambda k, _: k != tag)
    added = F.when(F.col("hg").isNotNull(), F.map_concat(held, F.create_map(F.lit(tag), F.col("hg")))).otherwise(parse_og_tags(F.col("tags")))
    return both.select("gene", format_og_tags(added).alias("tags"))


def annotate_og(gff: DataFrame, tags: DataFrame) -> DataFrame:
    """Gene rows get an OG attribute."""
    rows = gff.withColumn("_a", _id("Alias")).join(tags.select(F.col("gene").alias("_a"), "tags"), "_a", "left")
    return _like(rows.withColumn("attributes", F.when((F.col("type") == "gene") & F.col("tags").isNotNull(), set_attr(F.col("attributes"), "OG", F.col("tags"))).otherwise(F.col("attributes"))), gff)


def tag_query_features(gff: DataFrame, ids: DataFrame, tasks: int | None = None) -> DataFrame:
    """``gff`` with ``tag``: the wanted id (id) a row has as ID or protein, handed on from parts to RNA and from RNA to gene.

    Only names are looked up among the wanted ones; those found go to their genomes with the rows.
    """
    want = ids.select(F.col("id").alias("_want")).where("_want IS NOT NULL").distinct()
    protein = F.coalesce(_id("protein_id"), _id("proteinId"))
    names = gff.select("ome", F.explode(F.array_compact(F.array_distinct(F.array(_id(), protein)))).alias("_want"))
    found = names.join(want, "_want", "left_semi").distinct()
    own = gff.withColumn("_want", F.lit(None).cast("string"))
    rows = _by_genome(own.unionByName(found, allowMissingColumns=True)) if tasks is None else own.unionByName(found.repartition(tasks, "ome"), allowMissingColumns=True)
    met = rows.withColumns({"_id": _id(), "_p": _id("Parent"), "_q": protein})
    wanted = F.col("_want")
    for key, name in (("_id", "_t1"), ("_q", "_t2")):
        met = _looked_up(met, F.col(key), wanted, {name: wanted})
    now = met.where("_want IS NULL").withColumn("tag", F.coalesce("_t1", "_t2"))
    for _ in range(2):  # part to RNA, RNA to gene
        now = _looked_up(now, F.col("_id"), F.col("_p"), {"_up": F.col("tag")}).withColumn("tag", F.coalesce("tag", "_up")).drop("_up")
    return now.select(*gff.columns, "tag")


def curate(gff: DataFrame, dialect: float = 3.0, prefix: Column | None = None) -> DataFrame:
    """The converter of the dialect, then types, missing rows, aliases, names and order."""
    if dialect == 2.5:
        rows = gtf_to_gff3(gff, F.col("ome") if prefix is None else prefix)
    else:
        rows = gff2_to_gff3(gff) if dialect == 2.0 else gff
    complete = staged(complete_models(staged(normalise_types(rows), "types")), "complete")
    return rename_and_organise(staged(assign_aliases(complete), "aliases"))


def genome_dialects(gff: DataFrame) -> DataFrame:
    """(ome, dialect, curated): the dialect of a genome's first row that shows one, and whether that row has an Alias already."""
    kind = gff_dialect(F.col("attributes"))
    rows = gff.select("ome", "row", kind.alias("dialect"), _id("Alias").isNotNull().alias("curated")).where("dialect IS NOT NULL")
    return rows.groupBy("ome").agg(F.min(F.struct("row", "dialect", "curated")).alias("m")).select("ome", "m.dialect", "m.curated")


def curate_genomes(gff: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(gff, contigs, proteins, failed) of many genomes, each by the converter of its own dialect.

    Contigs get their genome's code before their name. A genome fails, with its reason, if it has contigs but no annotation or
    the other way round, if no row shows a dialect, if no gene is left, or if no protein has a residue; it is then in none of the other tables.
    """
    dialects = staged(genome_dialects(gff), "dialects")
    omes, held = gff.select("ome").distinct(), contigs.select("ome").distinct()
    of = lambda d: gff.join(dialects.where(F.col("dialect") == d).select("ome"), "ome", "left_semi")
    done = staged(reduce(DataFrame.unionByName, [curate(of(d), d) for d in (3.0, 2.5, 2.0)]), "curated")
    models, bases = prefix_contigs(done), prefix_contigs(contigs)
    proteins = staged(proteins_from_gff(models, bases), "proteins")
    empty = proteome_qc(proteins).where("rejected").select("ome", F.lit("empty proteins").alias("reason"))
    unknown = omes.join(dialects, "ome", "left_anti").select("ome", F.lit("unknown dialect").alias("reason"))
    bare = dialects.join(done.where("type = 'gene'").select("ome").distinct(), "ome", "left_anti").select("ome", F.lit("no genes").alias("reason"))
    lone = held.join(omes, "ome", "left_anti").select("ome", F.lit("no annotation").alias("reason")).unionByName(omes.join(held, "ome", "left_anti").select("ome", F.lit("no assembly").alias("reason")))
    # one reason a genome, the first in this order
    others = unknown.unionByName(bare).unionByName(empty.join(bare, "ome", "left_anti"))
    failed = staged(lone.unionByName(others.join(lone, "ome", "left_anti")).where("ome IS NOT NULL"), "failed")
    fine = lambda rows: rows.join(failed.select("ome"), "ome", "left_anti")
    return fine(models), fine(bases), fine(proteins), failed
