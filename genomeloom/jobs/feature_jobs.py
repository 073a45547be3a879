"""Registered queries on gene features, sequences and hits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from genomeloom.functions import columns as C
from genomeloom.jobs.fixtures import by_genome, domain, genes_by_genome, oracle
from genomeloom.operators import curate as Q
from genomeloom.operators import features as X
from genomeloom.operators import hits as H
from genomeloom.operators import sequences as S
from genomeloom.sources.shared import staged
from genomeloom.sources.store import stored

CLASS = "CASE WHEN type = 'gene' THEN 'gene' WHEN type = 'CDS' THEN 'cds' WHEN type = 'mRNA' THEN 'mrna' WHEN type = 'tRNA' THEN 'trna' WHEN contains(type, 'RNA') THEN 'rna' WHEN type = 'pseudogene' THEN 'pseudogene' END"
ALIAS = "nullif(regexp_extract(attributes, '(?:^|;)Alias=([^;]*)', 1), '')"
POS = f"""
r AS (SELECT ome, seqid, type, "start", "end", {ALIAS} AS alias FROM {{gff}}),
rna AS (SELECT ome, seqid, alias, "start", "end" FROM r WHERE contains(type, 'RNA') AND alias IS NOT NULL),
own AS (SELECT ome, seqid, alias, "start", "end" FROM r WHERE type IN ('gene', 'pseudogene') AND alias IS NOT NULL AND (ome, alias) NOT IN (SELECT ome, alias FROM rna)),
span AS (SELECT ome, seqid, alias, min(least("start", "end")) AS "start", max(greatest("start", "end")) AS "end" FROM (SELECT * FROM rna UNION ALL SELECT * FROM own) GROUP BY ALL),
pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY ome, seqid ORDER BY "start", alias) AS INT) AS pos FROM span)"""


def _gff(spark, sf_dir, **made):
    return domain(spark, sf_dir, "gff", **made)


def _stored_gff(spark, sf_dir):
    """Annotation stored by genome: what follows needs no exchange."""
    return stored(_gff(spark, sf_dir), "gff", ["seqid", "start"])


def _focus(spark, sf_dir):
    """The accessions that the operators are asked for: every gene that a search hit."""
    return domain(spark, sf_dir, "hits").select(F.col("sseqid").alias("alias"))


def _dealt(spark, sf_dir):
    """Annotation that lies by genome, the accessions of ``_focus`` from the same genes, and the number of tasks."""
    genes, tasks = genes_by_genome(spark, sf_dir)
    return by_genome(spark, sf_dir, "gff", genes), domain(spark, sf_dir, "hits", genes=genes).select(F.col("sseqid").alias("alias")), tasks


def _features_around(gff, focus, tasks):
    return X.features_around(gff, focus, 2, tasks)


def _mixed(spark, sf_dir):
    """Annotation of every genome in one of three dialects, by its kingdom."""
    of = lambda name, *kingdoms: domain(spark, sf_dir, name).join(domain(spark, sf_dir, "omes").where(F.col("kingdom").isin(*kingdoms)).select("ome"), "ome", "left_semi")
    rows = of("gff", "AFRICA", "AMERICA", "MIDDLE EAST").unionByName(of("gtf", "ASIA")).unionByName(of("gff2", "EUROPE"))
    return rows.withColumn("row", F.struct("seqid", "start", "type", "attributes"))


def _pos(spark, sf_dir, **made):
    return X.gene_positions(_gff(spark, sf_dir, **made), spread=True)


def _between(pos):
    """From the third to the ninth gene of each contig."""
    at = lambda k, name: pos.where(F.col("pos") == k).select(F.col("alias").alias(name), "ome", "seqid")
    return X.locus_between(pos, at(3, "a").join(at(9, "b"), ["ome", "seqid"]).select("a", "b"))


def _stats_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN kind = '{k}' THEN {c} END) AS {k}_{c}" for k in X.CLASSES for c in ("total", "n", "mean", "median"))
    return f"""
WITH rows_ AS (SELECT ome, {CLASS} AS kind, abs("end" - "start") AS size FROM {{gff}}),
lists AS (SELECT ome, kind, CAST(sum(size) AS BIGINT) AS total, count(*) AS n, avg(size) AS mean, list_sort(list(size)) AS l FROM rows_ WHERE kind IS NOT NULL GROUP BY ALL),
stats AS (SELECT ome, kind, total, n, mean, CASE WHEN round_even(n / 2, 0) = 0 THEN l[-1] ELSE l[CAST(round_even(n / 2, 0) AS BIGINT)] END AS median FROM lists)
SELECT ome, {cols} FROM stats GROUP BY ome"""


def _hits(spark, sf_dir, **made):
    # o and n name a gene, so sseqid is not needed in the order
    return domain(spark, sf_dir, "hits", **made).withColumn("row", F.struct("o", "n"))


JOBS = {
    "a1_annotation_stats": (lambda s, d: X.annotation_stats(_gff(s, d)), _stats_sql()),
    "a1_stored_annotation_stats": (lambda s, d: X.annotation_stats(_stored_gff(s, d)), _stats_sql()),
    "w1_stored_gene_positions": (lambda s, d: X.gene_positions(_stored_gff(s, d)), f'WITH {POS.strip()} SELECT ome, seqid, alias, "start", "end", pos FROM pos'),
    "p10_features_by_accession": (
        lambda s, d: X.features_by_accession(*_dealt(s, d)).select("ome", "seqid", "type", "start", "end", "alias"),
        f"""SELECT DISTINCT ome, seqid, type, "start", "end", {ALIAS} AS alias FROM {{gff}} WHERE {ALIAS} IN (SELECT sseqid FROM {{hits}})""",
    ),
    "p11_coding_cds": (
        lambda s, d: X.coding_cds(_gff(s, d)).select("ome", "alias", "start", "end"),
        f"""WITH r AS (SELECT *, {ALIAS} AS alias FROM {{gff}}), m AS (SELECT DISTINCT ome, alias FROM r WHERE type = 'mRNA'), g AS (SELECT DISTINCT ome, alias FROM r WHERE type = 'gene')
SELECT r.ome, r.alias, r."start", r."end" FROM r JOIN m ON m.ome = r.ome AND m.alias = r.alias JOIN g ON g.ome = r.ome AND g.alias = r.alias WHERE r.type = 'CDS'""",
    ),
    "p14_distinct_products": (
        lambda s, d: X.distinct_products(_gff(s, d)),
        "SELECT DISTINCT lower(nullif(regexp_extract(attributes, '(?:^|;)product=([^;]*)', 1), '')) AS product FROM {gff} WHERE contains(type, 'RNA') AND contains(attributes, 'product=')",
    ),
    "a19_gene_model_errors": (
        lambda s, d: X.gene_model_errors(_gff(s, d)),
        f"""WITH r AS (SELECT *, {ALIAS} AS alias FROM {{gff}}),
g AS (SELECT ome, alias, min("start") AS g0, max("end") AS g1 FROM r WHERE type = 'gene' GROUP BY ALL)
SELECT DISTINCT ome, alias, 'no gene' AS error FROM r WHERE contains(type, 'RNA') AND (ome, alias) NOT IN (SELECT (ome, alias) FROM g)
UNION ALL SELECT p.ome, p.alias, 'outside' FROM (SELECT ome, alias, min("start") AS p0, max("end") AS p1 FROM r WHERE type IN ('CDS', 'exon') GROUP BY ALL) p JOIN g USING (ome, alias) WHERE p0 < g0 OR p1 > g1""",
    ),
    "f4_gff_dialect": (
        lambda s, d: Q.genome_dialects(_mixed(s, d)).select("ome", "dialect", "curated"),
        "SELECT DISTINCT g.ome, CASE WHEN o.kingdom = 'ASIA' THEN 2.5 WHEN o.kingdom = 'EUROPE' THEN 2.0 ELSE 3.0 END::DOUBLE AS dialect, o.kingdom NOT IN ('ASIA', 'EUROPE') AS curated FROM {genes} g JOIN {omes} o USING (ome)",
    ),
    "f5_set_attribute": (
        lambda s, d: _gff(s, d).where("type = 'gene'").select("ome", C.set_attr(F.col("attributes"), "product", F.col("strand")).alias("attributes")),
        """SELECT ome, regexp_replace(attributes, ';product=[^;]*', '') || ';product=' || strand AS attributes FROM {gff} WHERE type = 'gene'""",
    ),
    "w1_gene_positions": (lambda s, d: _pos(s, d), f'WITH {POS.strip()} SELECT ome, seqid, alias, "start", "end", pos FROM pos'),
    "w2_locus_by_genes": (
        lambda s, d: X.locus_by_genes(_pos(s, d), _focus(s, d), 5),
        f"WITH {POS.strip()}, f AS (SELECT * FROM pos WHERE alias IN (SELECT sseqid FROM {{hits}})) SELECT f.alias AS focus, ome, seqid, p.alias, p.pos FROM pos p JOIN f USING (ome, seqid) WHERE abs(p.pos - f.pos) <= 5",
    ),
    "w3_locus_by_bases": (
        lambda s, d: X.locus_by_bases(_pos(s, d), _focus(s, d), 20000),
        f"""WITH {POS.strip()}, f AS (SELECT * FROM pos WHERE alias IN (SELECT sseqid FROM {{hits}})),
b AS (SELECT f.alias AS focus, ome, seqid, min(CASE WHEN p."end" >= f."start" - 20000 THEN p.pos END) AS lo, max(CASE WHEN p."start" <= f."end" + 20000 THEN p.pos END) AS hi FROM pos p JOIN f USING (ome, seqid) GROUP BY ALL)
SELECT focus, ome, seqid, alias, pos FROM pos JOIN b USING (ome, seqid) WHERE pos BETWEEN lo AND hi""",
    ),
    "w4_locus_between": (
        lambda s, d: _between(staged(_pos(s, d).select("ome", "seqid", "alias", "pos"), "positions")),
        f"WITH {POS.strip()} SELECT a.alias AS a, b.alias AS b, ome, seqid, p.alias, p.pos FROM pos a JOIN pos b USING (ome, seqid) JOIN pos p USING (ome, seqid) WHERE a.pos = 3 AND b.pos = 9 AND p.pos BETWEEN 3 AND 9",
    ),
    "w5_locus_features": (
        lambda s, d: _features_around(*_dealt(s, d)),
        f"""WITH {POS.strip()}, f AS (SELECT * FROM pos WHERE alias IN (SELECT sseqid FROM {{hits}})), l AS (SELECT f.alias AS focus, ome, seqid, p.alias, p.pos FROM pos p JOIN f USING (ome, seqid) WHERE abs(p.pos - f.pos) <= 2),
g AS (SELECT ome, {ALIAS} AS alias, type, "start", "end", strand, CASE WHEN contains(type, 'RNA') THEN 0 ELSE 1 END AS k FROM {{gff}} WHERE contains(type, 'RNA') OR type IN ('gene', 'pseudogene'))
SELECT focus, ome, seqid, alias, pos, type, "start", "end", strand FROM l JOIN g USING (ome, alias) QUALIFY row_number() OVER (PARTITION BY focus, ome, alias ORDER BY k, "start", type, "end") = 1""",
    ),
    "w6_trim_locus": (
        lambda s, d: X.trimmed_loci(_pos(s, d), _focus(s, d), domain(s, d, "genes").where("part % 3 = 0").select("alias", F.concat(F.lit("k"), F.col("part").cast("string")).alias("label")), 8),
        f"""WITH {POS.strip()}, f AS (SELECT * FROM pos WHERE alias IN (SELECT sseqid FROM {{hits}})), l AS (SELECT f.alias AS focus, ome, seqid, p.alias, p.pos FROM pos p JOIN f USING (ome, seqid) WHERE abs(p.pos - f.pos) <= 8),
n AS (SELECT l.*, 'k' || part AS label FROM l LEFT JOIN (SELECT alias, part FROM {{genes}} WHERE part % 3 = 0) g USING (alias)),
t AS (SELECT *, min(CASE WHEN label IS NOT NULL THEN pos END) OVER (PARTITION BY focus) AS lo, max(CASE WHEN label IS NOT NULL THEN pos END) OVER (PARTITION BY focus) AS hi FROM n)
SELECT focus, ome, seqid, alias, pos, coalesce(label, 'na') AS label FROM t WHERE pos BETWEEN lo AND hi""",
    ),
    "w11_split_by_gap": (
        lambda s, d: X.split_by_gap(_pos(s, d), 5000).select("ome", "seqid", "alias", "block"),
        f"""WITH {POS.strip()}, n AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY ome, seqid ORDER BY pos) > 5000 THEN 1 ELSE 0 END AS new FROM pos)
SELECT ome, seqid, alias, CAST(sum(new) OVER (PARTITION BY ome, seqid ORDER BY pos) AS BIGINT) AS block FROM n""",
    ),
    "w17_sort_gff": (lambda s, d: X.sort_gff(_gff(s, d)).select("ome", "seqid", "type", "start", "end", "alias"), f'SELECT ome, seqid, type, "start", "end", {ALIAS} AS alias FROM {{gff}}'),
    "j14_replace_overlapping": (
        lambda s, d: X.replace_overlapping(domain(s, d, "genes").where("n = 7"), domain(s, d, "genes").where("n <= 4"))[1],
        """SELECT DISTINCT a.ome, a.alias AS new, b.alias AS old FROM {genes} a JOIN {genes} b ON a.ome = b.ome AND a.seqid = b.seqid
WHERE a.n = 7 AND b.n <= 4 AND (a."start" BETWEEN b."start" AND b."end" OR a."end" BETWEEN b."start" AND b."end")""",
    ),
    "j15_overlapping_genes": (
        lambda s, d: X.overlapping_genes(domain(s, d, "genes")),
        """SELECT x.ome, x.seqid, x.alias AS a, y.alias AS b FROM {genes} x JOIN {genes} y ON x.ome = y.ome AND x.seqid = y.seqid AND x.alias < y.alias
WHERE greatest(x."start", y."start") < least(x."end", y."end")""",
    ),
    "g10_merge_overlapping": (
        lambda s, d: X.merge_overlapping_genes(domain(s, d, "genes")),
        """WITH o AS (SELECT *, max("end") OVER (PARTITION BY ome, seqid ORDER BY "start", "end", alias ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {genes}),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY ome, seqid ORDER BY "start", "end", alias) AS island FROM o)
SELECT ome, seqid, min("start") AS "start", max("end") AS "end", string_agg(alias, '|' ORDER BY "start", "end", alias) AS alias, count(*) AS n FROM i GROUP BY ome, seqid, island""",
    ),
    "a2_assembly_stats": (
        lambda s, d: S.assembly_stats(domain(s, d, "contigs")),
        """WITH c AS (SELECT ome, seqid, len(sequence) AS size, len(regexp_replace(sequence, '[^acgtACGT]', '', 'g')) AS acgt, len(regexp_replace(sequence, '[^gcGC]', '', 'g')) AS gc, len(regexp_replace(sequence, '[^acgt]', '', 'g')) AS masked FROM {contigs}),
r AS (SELECT *, sum(size) OVER (PARTITION BY ome ORDER BY size DESC, seqid ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY ome ORDER BY size DESC, seqid) AS rank,
  sum(size) OVER (PARTITION BY ome) AS total, sum(CASE WHEN size >= 1000 THEN size END) OVER (PARTITION BY ome) AS total_long FROM c WHERE size > 0)
SELECT ome, max(CASE WHEN run * 2 >= total THEN size END) AS n50, CAST(min(CASE WHEN run * 2 >= total THEN rank END) AS INT) AS l50,
  max(CASE WHEN size >= 1000 AND run * 2 >= total_long THEN size END) AS n50_long, CAST(min(CASE WHEN size >= 1000 AND run * 2 >= total_long THEN rank END) AS INT) AS l50_long,
  max(size) AS largest, min(size) AS shortest, count(*) AS contigs, count(*) FILTER (WHERE size >= 1000) AS contigs_long, CAST(sum(size) AS BIGINT) AS length, CAST(coalesce(sum(size) FILTER (WHERE size >= 1000), 0) AS BIGINT) AS length_long,
  round(100.0::DOUBLE * sum(gc) / nullif(sum(acgt), 0), 4) AS gc, round(100.0::DOUBLE * sum(gc) FILTER (WHERE size >= 1000) / nullif(sum(acgt) FILTER (WHERE size >= 1000), 0), 4) AS gc_long,
  round(100.0::DOUBLE * sum(masked) / sum(size), 4) AS masked, round(100.0::DOUBLE * sum(masked) FILTER (WHERE size >= 1000) / nullif(sum(size) FILTER (WHERE size >= 1000), 0), 4) AS masked_long,
  round(100.0::DOUBLE * min(CASE WHEN run * 2 >= total THEN rank END) / count(*), 4) AS l50_percent FROM r GROUP BY ome""",
    ),
    "f6_reverse_complement": (
        lambda s, d: domain(s, d, "contigs").select("seqid", F.sha2(C.reverse_complement(F.col("sequence")), 256).alias("digest")),
        f"SELECT seqid, sha256(reverse(translate(sequence, '{C.COMPLEMENT[0]}', '{C.COMPLEMENT[1]}'))) AS digest FROM {{contigs}}",
    ),
    "f9_gc_percent": (
        lambda s, d: domain(s, d, "contigs").select("seqid", C.gc_percent(F.col("sequence")).alias("gc")),
        "SELECT seqid, CASE WHEN len(sequence) > 0 THEN printf('%.2f%%', 100.0::DOUBLE * len(regexp_replace(sequence, '[^GC]', '', 'g')) / len(sequence)) END AS gc FROM {contigs}",
    ),
    "f12_truncate": (
        lambda s, d: domain(s, d, "contigs").select("seqid", F.length(C.truncate_seq(F.col("sequence"), 500)).alias("n")),
        "SELECT seqid, CASE WHEN len(sequence) >= 500 THEN 499 ELSE CAST(len(sequence) AS INT) END AS n FROM {contigs}",
    ),
    "j1_fetch_sequences": (
        lambda s, d: S.fetch_sequences(domain(s, d, "contigs").select("seqid"), domain(s, d, "contigs"))[0].select("seqid", F.sha2("sequence", 256).alias("digest")),
        "SELECT seqid, sha256(sequence) AS digest FROM {contigs}",
    ),
    "j2_fetch_subsequences": (
        lambda s, d: S.fetch_subsequences(domain(s, d, "contigs").select(F.concat("seqid", F.lit("[20:5]")).alias("accession")).unionByName(domain(s, d, "contigs").select(F.concat("seqid", F.lit("[3:40]")).alias("accession"))), domain(s, d, "contigs")).select("accession", "sequence"),
        f"""SELECT seqid || '[3:40]' AS accession, substr(sequence, 4, 38) AS sequence FROM {{contigs}} UNION ALL SELECT seqid || '[20:5]', reverse(translate(substr(sequence, 5, 17), '{C.COMPLEMENT[0]}', '{C.COMPLEMENT[1]}')) FROM {{contigs}}""",
    ),
    "j3_fetch_subsequences_1based": (
        lambda s, d: S.fetch_subsequences_1based(domain(s, d, "contigs").select(F.concat("seqid", F.lit("[3-40]")).alias("accession")), domain(s, d, "contigs")).select("accession", "sequence"),
        "SELECT seqid || '[3-40]' AS accession, substr(sequence, 3, 38) AS sequence FROM {contigs}",
    ),
    "w7_select_hits": (
        lambda s, d: H.select_hits(_hits(s, d), 3, 0.008, 30, 0.00025, 0.000125).select("qseqid", "sseqid", "pident", "bitscore"),
        """SELECT qseqid, sseqid, pident, bitscore FROM (SELECT *, row_number() OVER (PARTITION BY split_part(sseqid, '_', 1), qseqid ORDER BY pident DESC, o, n, sseqid) AS k FROM {hits}) h
WHERE k <= 3 AND floor(bitscore) > 30 AND floor(1000 * pident) > 25 AND evalue <= 0.008 AND floor(1000 * ppos) > 12.5""",
    ),
    "w8_select_hits_global": (
        lambda s, d: H.select_hits_global(_hits(s, d), 20, 0.008, 30, 0.00025, 0.000125).select("qseqid", "sseqid", "bitscore"),
        """SELECT qseqid, sseqid, bitscore FROM (SELECT *, row_number() OVER (PARTITION BY split_part(sseqid, '_', 1) ORDER BY bitscore DESC, o, n, sseqid) AS k FROM {hits}
WHERE floor(bitscore) > 30 AND floor(1000 * pident) > 25 AND evalue <= 0.008 AND floor(1000 * ppos) > 12.5) h WHERE k <= 20""",
    ),
    "w10_hits_to_accessions": (lambda s, d: H.hits_to_accessions(domain(s, d, "hits"), True), "SELECT DISTINCT qseqid, sseqid || '[' || sstart || '-' || send || ']' AS accession FROM {hits}"),
    "j17_hits_in_all_queries": (
        lambda s, d: H.hits_in_all_queries(domain(s, d, "hits").select(F.expr("concat('q', o % 3)").alias("qseqid"), F.substring_index("sseqid", "_", 1).alias("sseqid"))),
        "WITH h AS (SELECT 'q' || o % 3 AS qseqid, split_part(sseqid, '_', 1) AS sseqid FROM {hits}) SELECT sseqid FROM h GROUP BY sseqid HAVING count(DISTINCT qseqid) = (SELECT count(DISTINCT qseqid) FROM h)",
    ),
    "a13_route_queries": (
        lambda s, d: H.route_queries(domain(s, d, "hits"), 900),
        "SELECT qseqid, count(DISTINCT sseqid) AS n, CASE WHEN count(DISTINCT sseqid) > 900 THEN 'cluster' WHEN count(DISTINCT sseqid) < 3 THEN 'few' ELSE 'ready' END AS route FROM {hits} GROUP BY qseqid",
    ),
    "a14_queries_per_gene": (
        lambda s, d: H.queries_per_gene(domain(s, d, "hits")),
        "SELECT split_part(sseqid, '_', 1) AS ome, sseqid AS gene, string_agg(DISTINCT qseqid, ',' ORDER BY qseqid) AS queries FROM {hits} GROUP BY sseqid",
    ),
}
QUERIES = {name: job for name, (job, _) in JOBS.items()}
ORACLES = {name: oracle(sql) for name, (_, sql) in JOBS.items()}
