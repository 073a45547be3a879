"""Gene features: statistics, selection, gene order and loci.

Annotation tables have (ome, seqid, source, type, start, end, score, strand, phase,
attributes), coordinates counted from 1 and inclusive; ``ome`` partitions the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.functions.columns import gff3_attr, set_attr

CLASSES = ("gene", "cds", "mrna", "trna", "rna", "pseudogene")


def feature_class(kind: Column) -> Column:
    """One of CLASSES or null; ``rna`` is any other type that names RNA."""
    return F.when(kind == "gene", "gene").when(kind == "CDS", "cds").when(kind == "mRNA", "mrna").when(kind == "tRNA", "trna").when(kind.contains("RNA"), "rna").when(kind == "pseudogene", "pseudogene")


def annotation_stats(gff: DataFrame) -> DataFrame:
    """For each genome and class: total length, count, mean and median; a class without rows is null.

    Length is ``end - start``, without 1 added. The median is the sorted element number
    rint(n / 2), half to even, counted from 1; 0 stands for the last.
    """
    rows = gff.select("ome", feature_class(F.col("type")).alias("kind"), F.abs(F.col("end") - F.col("start")).alias("size")).where("kind IS NOT NULL")
    # lengths repeat: counts of equal ones are summed map-side, and only they are sorted
    counts = rows.groupBy("ome", "kind", "size").agg(F.count("*").alias("c"))
    group = W.partitionBy("ome", "kind")
    ranked = counts.withColumn("run", F.sum("c").over(group.orderBy("size").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(group))
    middle = F.rint(F.col("all") / 2).cast("long")
    chosen = F.when(F.col("run") >= F.when(middle == 0, F.col("all")).otherwise(middle), F.col("size"))
    total = F.sum(F.col("size") * F.col("c"))
    by_kind = ranked.groupBy("ome", "kind").agg(total.alias("total"), F.sum("c").alias("n"), (total / F.sum("c")).alias("mean"), F.min(chosen).alias("median"))
    of = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    return by_kind.groupBy("ome").agg(*(of(kind, column).alias(f"{kind}_{column}") for kind in CLASSES for column in ("total", "n", "mean", "median")))


def with_alias(gff: DataFrame) -> DataFrame:
    return gff.withColumn("alias", gff3_attr(F.col("attributes"), "Alias"))


def _asked_names(rows: DataFrame, accessions: DataFrame, tasks: int) -> DataFrame:
    """(ome, alias) of ``rows`` whose alias is among ``accessions``, dealt by genome to ``tasks``: only names are moved, there and back."""
    names = rows.where("ome IS NOT NULL").select("ome", "alias").distinct()
    return names.join(accessions.select("alias").distinct(), "alias", "left_semi").repartition(tasks, "ome").select("ome", "alias", F.lit(True).alias("asked"))


def _brought(rows: DataFrame, given: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the least ``name`` of the rows of ``given`` (ome, key, name) of their genome and key; both are dealt by genome alike, and neither is moved, as it would be for a join."""
    # columns without the names of their tables: a union keeps how its parts are dealt only then
    bare = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
    both = bare(rows.withColumn("_own", F.lit(True))).unionByName(bare(given), allowMissingColumns=True)
    return both.withColumn(name, F.min(name).over(W.partitionBy("ome", key))).where("_own").drop("_own")


def features_by_accession(gff: DataFrame, accessions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows any of whose aliases is among ``accessions`` (alias), each once; rows that are dealt by genome to ``tasks`` already are not moved."""
    rows = with_alias(gff)
    if tasks is not None:
        one = rows.withColumn("one", F.explode(F.array_distinct(F.split("alias", r"\|"))))
        found = _asked_names(one.select("ome", F.col("one").alias("alias")), accessions, tasks).withColumnRenamed("alias", "one")
        return _brought(one, found, "one", "asked").where("asked").select(*rows.columns).distinct()
    split = rows.withColumn("all", F.array_distinct(F.split("alias", r"\|"))).withColumn("one", F.explode("all"))
    asked = accessions.select(F.col("alias").alias("one")).distinct()
    # equal rows of one alias are together already; only those of several aliases are moved once more
    one = split.where(F.size("all") == 1).drop("all").join(asked, "one", "left_semi").distinct().drop("one")
    more = split.where(F.size("all") > 1).drop("all").join(asked, "one", "left_semi").drop("one").distinct()
    return one.unionByName(more)


def coding_cds(gff: DataFrame) -> DataFrame:
    """CDS rows whose alias both an mRNA and a gene of the genome carry."""
    rows = with_alias(gff)
    mrna = rows.where("type = 'mRNA'").select("ome", "alias").distinct()
    gene = rows.where("type = 'gene'").select("ome", F.explode(F.split("alias", r"\|")).alias("alias")).distinct()
    return rows.where("type = 'CDS'").join(mrna, ["ome", "alias"], "left_semi").join(gene, ["ome", "alias"], "left_semi")


def distinct_products(gff: DataFrame) -> DataFrame:
    """Lower-case product names of RNA rows."""
    return gff.where(F.col("type").contains("RNA")).select(F.lower(gff3_attr(F.col("attributes"), "product")).alias("product")).where("product IS NOT NULL").distinct()


def gene_model_errors(gff: DataFrame) -> DataFrame:
    """(ome, alias, error): transcripts without a gene, and genes that a CDS or exon leaves."""
    rows = with_alias(gff)
    gene = rows.where("type = 'gene'").groupBy("ome", "alias").agg(F.min("start").alias("g0"), F.max("end").alias("g1"))
    rna = rows.where(F.col("type").contains("RNA")).select("ome", "alias").distinct()
    parts = rows.where("type IN ('CDS', 'exon')").groupBy("ome", "alias").agg(F.min("start").alias("p0"), F.max("end").alias("p1"))
    lost = rna.join(gene, ["ome", "alias"], "left_anti").select("ome", "alias", F.lit("no gene").alias("error"))
    out = parts.join(gene, ["ome", "alias"]).where("p0 < g0 OR p1 > g1").select("ome", "alias", F.lit("outside").alias("error"))
    return lost.unionByName(out)


def gene_positions(gff: DataFrame, spread: bool | int = False, marks: DataFrame | None = None) -> DataFrame:
    """(ome, seqid, alias, start, end, pos): genes of each contig in order, counted from 1.

    ``spread`` moves a genome's rows together first, once for all that follows; tables stored by genome don't need it. A number is that
    of the tasks, which then are not made fewer.
    ``marks`` (ome, alias, mark) go there with them, and each gene gets the list of its own, without a join.

    Coordinates are those of the RNA rows; a gene gives its own, split at ``|``, only for
    aliases that no RNA of the genome carries. Ties in start are ordered by alias.
    """
    rows = with_alias(gff).where(F.col("alias").isNotNull() & (F.col("type").contains("RNA") | F.col("type").isin("gene", "pseudogene")))
    is_rna = F.col("type").contains("RNA")
    one = rows.select("ome", "seqid", F.explode(F.when(is_rna, F.array("alias")).otherwise(F.split("alias", r"\|"))).alias("alias"), is_rna.alias("rna"), F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"))
    if marks is not None:
        known = marks.where("ome IS NOT NULL AND alias IS NOT NULL AND mark IS NOT NULL").select("ome", "alias", "mark", F.lit(False).alias("own"))
        one = one.withColumn("own", F.lit(True)).unionByName(known, allowMissingColumns=True)
    if spread or marks is not None:
        one = one.repartition("ome") if isinstance(spread, bool) else one.repartition(spread, "ome")
    lo, hi = (F.when(F.col("rna"), F.col(c)) for c in ("lo", "hi"))
    spans = one.groupBy("ome", "seqid", "alias", *([] if marks is None else ["mark", "own"])).agg(F.min(lo).alias("r0"), F.max(hi).alias("r1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gene = W.partitionBy("ome", "alias")
    spans = spans.withColumn("any", F.max(F.col("r0").isNotNull()).over(gene))
    if marks is not None:
        spans = spans.withColumn("marks", F.collect_list("mark").over(gene)).where("own")
    spans = spans.where(F.col("r0").isNotNull() | ~F.col("any"))
    both = spans.select("ome", "seqid", "alias", F.coalesce("r0", "lo").alias("start"), F.coalesce("r1", "hi").alias("end"), *([] if marks is None else ["marks"]))
    return both.withColumn("pos", F.row_number().over(W.partitionBy("ome", "seqid").orderBy("start", "alias")))


def asked_positions(pos: DataFrame, accessions: DataFrame, labels: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``pos``, not moved if it is dealt by genome to ``tasks`` already, with ``asked``: whether a gene is among ``accessions`` (alias); with ``labels`` (alias, label) also the list of a gene's labels, and how many places have its alias."""
    if tasks is None:
        marked = pos.join(accessions.select("alias").distinct().withColumn("asked", F.lit(True)), "alias", "left")
    else:
        marked = _brought(pos, _asked_names(pos, accessions, tasks), "alias", "asked")
    marked = marked.withColumn("asked", F.coalesce("asked", F.lit(False)))
    if labels is None:
        return marked
    own = labels.groupBy("alias").agg(F.collect_list("label").alias("labels"))
    return marked.join(own, "alias", "left").withColumn("places", F.count("*").over(W.partitionBy("alias")))


def locus_by_genes(pos: DataFrame, accessions: DataFrame, k: int = 10) -> DataFrame:
    """(focus, ome, seqid, alias, pos): up to ``k`` genes on either side of each accession, read from the contig's order."""
    around = W.partitionBy("ome", "seqid").orderBy("pos").rangeBetween(-k, k)
    near = asked_positions(pos, accessions).select("ome", "seqid", "alias", "pos", "asked").withColumn("near", F.collect_list(F.struct("alias", "pos")).over(around))
    return near.where("asked").select(F.col("alias").alias("focus"), "ome", "seqid", F.explode("near").alias("x")).select("focus", "ome", "seqid", "x.alias", "x.pos")


def _opened(pos: DataFrame, ends: DataFrame, *keys: str) -> DataFrame:
    """The genes of the places ``lo`` to ``hi`` of each row of ``ends``, by an equi-join on the place."""
    near = ends.select(*keys, "ome", "seqid", F.explode(F.sequence("lo", "hi")).alias("pos"))
    return pos.select("ome", "seqid", "alias", "pos").join(near, ["ome", "seqid", "pos"]).select(*keys, "ome", "seqid", "alias", "pos")


#: Places of a contig that are gathered at a time.
PLACES = 16


def _opened_here(rows: DataFrame) -> DataFrame:
    """The genes of the places ``lo`` to ``hi`` of the rows that have them, as (focus, ome, seqid, alias, pos), where rows (ome, seqid, alias, pos, lo, hi) are together by contig: no row is moved.

    A contig's places are gathered block by block, for the loci that touch the block.
    """
    block = lambda c: F.floor(F.col(c) / PLACES)
    copy = lambda at, asks: F.struct(at.alias("block"), F.lit(asks).alias("asks"))
    touched = F.when(F.col("lo") <= F.col("hi"), F.transform(F.sequence(block("lo"), block("hi")), lambda b: copy(b, True)))
    copies = rows.select("*", F.explode(F.concat(F.array(copy(block("pos"), False)), F.coalesce(touched, F.array().cast("array<struct<block:bigint,asks:boolean>>")))).alias("_x")).select("*", "_x.*")
    genes = F.collect_list(F.when(~F.col("asks"), F.struct("alias", "pos"))).over(W.partitionBy("ome", "seqid", "block"))
    inside = copies.withColumn("_genes", genes).where("asks").select("ome", "seqid", F.col("alias").alias("focus"), "lo", "hi", F.explode("_genes").alias("x"))
    return inside.where("x.pos BETWEEN lo AND hi").select("focus", "ome", "seqid", "x.alias", "x.pos")


def locus_by_bases(pos: DataFrame, accessions: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """The genes from the first that ends at or after start - n to the last that starts at or before end + n.

    Both ends are looked up in one sort of a contig's genes and questions: the last start up to a coordinate,
    and the first place where the running maximum of ends reaches one.
    """
    contig = W.partitionBy("ome", "seqid")
    reach = F.max("end").over(contig.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    # equal coordinates: a question for the first place, then genes, then a question for the last place
    row = lambda at, rank, reached, started, ask: F.struct(at.alias("at"), F.lit(rank).alias("rank"), reached.alias("reached"), started.alias("started"), F.lit(ask).alias("ask"))
    none = F.lit(None).cast("int")
    own = F.array(row(F.col("reach"), 1, F.col("pos"), none, ""), row(F.col("start"), 1, none, F.col("pos"), ""))
    asks = F.array(row(F.col("start") - n, 0, none, none, "lo"), row(F.col("end") + n, 2, none, none, "hi"))
    rows = asked_positions(pos, accessions, tasks=tasks).select("ome", "seqid", "alias", "pos", "start", "end", "asked").withColumn("reach", reach)
    events = rows.select("ome", "seqid", "alias", "pos", F.explode(F.when(F.col("asked"), F.concat(own, asks)).otherwise(own)).alias("x"))
    so_far = contig.orderBy("x.at", "x.rank").rowsBetween(W.unboundedPreceding, 0)
    told = events.select("ome", "seqid", "alias", "pos", F.col("x.ask").alias("ask"), (F.coalesce(F.max("x.reached").over(so_far), F.lit(0)) + 1).alias("first"), F.max("x.started").over(so_far).alias("last"))
    ends = told.groupBy("ome", "seqid", "alias", "pos").agg(F.max(F.when(F.col("ask") == "lo", F.col("first"))).alias("lo"), F.max(F.when(F.col("ask") == "hi", F.col("last"))).alias("hi"))
    return _opened_here(ends)


def locus_between(pos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Genes from one accession to another of the same contig; ``pairs`` has (a, b)."""
    at = pos.select("ome", "seqid", "alias", "pos")
    a = at.select("ome", "seqid", F.col("alias").alias("a"), F.col("pos").alias("pa"))
    b = at.select("ome", "seqid", F.col("alias").alias("b"), F.col("pos").alias("pb"))
    ends = pairs.join(a, "a").join(b, ["b", "ome", "seqid"]).withColumns({"lo": F.least("pa", "pb"), "hi": F.greatest("pa", "pb")})
    return _opened(pos, ends, "a", "b")


def _best_rows(gff: DataFrame) -> DataFrame:
    """(ome, alias, x): the annotation row that stands for a gene, an RNA row where there is one."""
    rows = with_alias(gff).where(F.col("type").contains("RNA") | F.col("type").isin("gene", "pseudogene")).select("ome", F.explode(F.split("alias", r"\|")).alias("alias"), "type", "start", "end", "strand")
    order = F.struct(F.when(F.col("type").contains("RNA"), 0).otherwise(1).alias("k"), "start", "type", "end", "strand")
    return rows.groupBy("ome", "alias").agg(F.min(order).alias("x"))


def locus_features(locus: DataFrame, gff: DataFrame) -> DataFrame:
    """One annotation row for each gene of a locus: an RNA row where there is one."""
    # a gene's row is chosen once, not in each locus; the key of the join is also that of the count, so loci are moved once
    return _once(locus.join(_best_rows(gff), ["ome", "alias"]))


def features_around(gff: DataFrame, accessions: DataFrame, k: int, tasks: int) -> DataFrame:
    """``locus_features`` of ``locus_by_genes``, where ``gff`` is dealt by genome to ``tasks``: genes take their annotation rows along when loci are read from the contig's order, and neither is moved."""
    pos = _brought(asked_positions(gene_positions(gff), accessions, tasks=tasks), _best_rows(gff), "alias", "x")
    around = W.partitionBy("ome", "seqid").orderBy("pos").rangeBetween(-k, k)
    near = pos.select("ome", "seqid", "alias", "pos", "asked", F.collect_list(F.struct("alias", "pos", "x")).over(around).alias("near")).where("asked")
    opened = near.select(F.col("alias").alias("focus"), "ome", "seqid", F.explode("near").alias("y")).select("focus", "ome", "seqid", "y.alias", "y.pos", "y.x")
    return _once(opened.where("x IS NOT NULL"))


def _once(featured: DataFrame) -> DataFrame:
    first = W.partitionBy("focus", "ome", "alias").orderBy("seqid", "pos")
    return featured.withColumn("r", F.row_number().over(first)).where("r = 1").select("focus", "ome", "seqid", "alias", "pos", "x.type", "x.start", "x.end", "x.strand")


def trim_locus(locus: DataFrame, labels: DataFrame) -> DataFrame:
    """Loci cut to their first and last labelled gene; ``labels`` has (alias, label), others get ``na``."""
    named = locus.join(labels.select("alias", "label"), "alias", "left")
    whole = W.partitionBy("focus")
    hit = F.when(F.col("label").isNotNull(), F.col("pos"))
    cut = named.withColumn("lo", F.min(hit).over(whole)).withColumn("hi", F.max(hit).over(whole)).where("pos BETWEEN lo AND hi")
    return cut.select("focus", "ome", "seqid", "alias", "pos", F.coalesce("label", F.lit("na")).alias("label"))


def trimmed_loci(pos: DataFrame, accessions: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """``trim_locus`` of ``locus_by_genes``: labels are found for genes, not for genes of loci, and a locus is cut before it is opened."""
    around = W.partitionBy("ome", "seqid").orderBy("pos").rangeBetween(-k, k)
    rows = asked_positions(pos, accessions, labels).select("ome", "seqid", "alias", "pos", "asked", "labels", "places")
    near = rows.withColumn("near", F.collect_list(F.struct("alias", "pos", "labels")).over(around)).where("asked")
    hits = F.transform(F.filter("near", lambda x: F.coalesce(F.size(x["labels"]), F.lit(0)) > 0), lambda x: x["pos"])
    own = near.withColumns({"lo": F.array_min(hits), "hi": F.array_max(hits)})
    cols = ["focus", "ome", "seqid", "near", "lo", "hi"]
    named = own.withColumnRenamed("alias", "focus")
    one = named.where("places = 1").select(*cols)
    # an accession with several places has one locus over all of them
    whole = W.partitionBy("focus")
    more = named.where("places > 1").withColumns({"lo": F.min("lo").over(whole), "hi": F.max("hi").over(whole)}).select(*cols)
    opened = one.unionByName(more).select("focus", "ome", "seqid", "lo", "hi", F.explode("near").alias("x")).where("x.pos BETWEEN lo AND hi")
    return opened.select("focus", "ome", "seqid", "x.alias", "x.pos", F.explode(F.when(F.size("x.labels") > 0, F.col("x.labels")).otherwise(F.array(F.lit("na")))).alias("label"))


def split_by_gap(pos: DataFrame, gap: int) -> DataFrame:
    """``pos`` with the number of the block on its contig; a new block starts where the gap to the gene before is larger."""
    order = W.partitionBy("ome", "seqid").orderBy("pos")
    new = F.when(F.col("start") - F.lag("end").over(order) > gap, 1).otherwise(0)
    return pos.withColumn("new", new).withColumn("block", F.sum("new").over(order)).drop("new")


def sort_gff(gff: DataFrame) -> DataFrame:
    """Rows by contig, then gene by gene (by the gene's start), a gene's rows from gene to parts."""
    rows = with_alias(gff)
    rank = F.when(F.col("type").isin("gene", "pseudogene"), 0).when(F.col("type").contains("RNA"), 1).when(F.col("type") == "exon", 2).otherwise(3)
    first = F.min("start").over(W.partitionBy("ome", "seqid", "alias"))
    return rows.withColumn("_first", first).withColumn("_rank", rank).repartition("ome").sortWithinPartitions("ome", "seqid", "_first", "alias", "_rank", "start").drop("_first", "_rank")


BIN = 20_000


def _binned(genes: DataFrame, size: int) -> DataFrame:
    """A row for each bin that a gene touches."""
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    return genes.withColumn("bin", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))


def overlapping_genes(genes: DataFrame, size: int = BIN) -> DataFrame:
    """(ome, seqid, a, b): pairs of genes of a contig with max(starts) < min(ends), a < b; ``genes`` has alias, start, end."""
    g = _binned(genes.select("ome", "seqid", "alias", "start", "end"), size)
    x, y = g.alias("x"), g.alias("y")
    s, e = F.greatest("x.start", "y.start"), F.least("x.end", "y.end")
    same = (F.col("x.ome") == F.col("y.ome")) & (F.col("x.seqid") == F.col("y.seqid")) & (F.col("x.bin") == F.col("y.bin"))
    # the bin where the overlap starts reports the pair
    pairs = x.join(y, same & (F.col("x.alias") < F.col("y.alias")) & (s < e) & (F.floor(s / size) == F.col("x.bin")))
    return pairs.select("x.ome", "x.seqid", F.col("x.alias").alias("a"), F.col("y.alias").alias("b"))


def replace_overlapping(new: DataFrame, ref: DataFrame, size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """(kept reference genes, (new, old) pairs): a reference gene goes if a new gene of its contig starts or ends inside it."""
    ends = new.select("ome", "seqid", F.col("alias").alias("new"), F.explode(F.array("start", "end")).alias("at")).withColumn("bin", F.floor(F.col("at") / size))
    old = _binned(ref.select("ome", "seqid", F.col("alias").alias("old"), "start", "end"), size)
    pairs = ends.join(old, ["ome", "seqid", "bin"]).where("at BETWEEN start AND end").select("ome", "new", "old").distinct()
    return ref.join(pairs.select("ome", F.col("old").alias("alias")).distinct(), ["ome", "alias"], "left_anti"), pairs


def merge_overlapping_genes(genes: DataFrame) -> DataFrame:
    """(ome, seqid, start, end, alias, n): connected overlaps as one gene; its alias joins theirs by ``|`` in order."""
    order = W.partitionBy("ome", "seqid").orderBy("start", "end", "alias")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = genes.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "alias"))), lambda x: x["alias"]), "|")
    return rows.groupBy("ome", "seqid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), joined.alias("alias"), F.count("*").alias("n")).drop("island")


def merge_into_spliced_genes(gff: DataFrame) -> DataFrame:
    """``gff`` with connected overlaps of genes made one alternately spliced gene: the first spans all and joins their aliases by ``|``, the others go, and their RNAs get it as Parent."""
    rows = with_alias(gff).withColumn("_id", gff3_attr(F.col("attributes"), "ID"))
    genes = rows.where("type = 'gene'").select("ome", "seqid", "alias", "start", "end", F.col("_id").alias("id"))
    order = W.partitionBy("ome", "seqid").orderBy("start", "end", "alias")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = genes.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("island", F.sum("_new").over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "alias", "id")))
    merged = marked.groupBy("ome", "seqid", "island").agg(parts.alias("parts"), F.min("start").alias("g0"), F.max("end").alias("g1"))
    whole = F.array_join(F.transform("parts", lambda x: x["alias"]), "|")
    named = merged.select("ome", F.get("parts", F.lit(0))["id"].alias("top"), "g0", "g1", whole.alias("whole"), F.explode("parts").alias("own")).select("ome", "top", "g0", "g1", "whole", F.col("own.id").alias("gid"))
    key = F.when(F.col("type") == "gene", F.col("_id")).when(F.col("type").contains("RNA"), gff3_attr(F.col("attributes"), "Parent"))
    met = rows.withColumn("gid", key).join(named, ["ome", "gid"], "left").where((F.col("type") != "gene") | (F.col("gid") == F.col("top")))
    is_gene = (F.col("type") == "gene") & F.col("top").isNotNull()
    attributes = F.when(is_gene, set_attr(F.col("attributes"), "Alias", F.col("whole"))).when(F.col("top").isNotNull(), set_attr(F.col("attributes"), "Parent", F.col("top"))).otherwise(F.col("attributes"))
    return met.withColumns({"attributes": attributes, "start": F.when(is_gene, F.col("g0")).otherwise(F.col("start")), "end": F.when(is_gene, F.col("g1")).otherwise(F.col("end"))}).select(*gff.columns)
