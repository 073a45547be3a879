"""Registered queries on whole jobs: locus comparison and catalog update, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from genomeloom.jobs.catalog_jobs import _new, _retired
from genomeloom.jobs.feature_jobs import POS, _hits
from genomeloom.jobs.fixtures import by_genome, domain, genes_by_genome, oracle
from genomeloom.jobs.group_jobs import _catalog
from genomeloom.operators.features import gene_positions
from genomeloom.operators.workflows import compare_loci, update_catalog
from genomeloom.sources.shared import staged


def _submitted(s, d):
    """The genomes of the documents, and all customers', which come without an assembly."""
    own = domain(s, d, "submitted").select("assembly_acc", "genus", "species")
    listed = _new(s, d).where(F.col("assembly_acc").startswith("GCA_c"))
    return own.unionByName(listed).withColumns({"source": F.lit("ncbi"), "version": F.lit("20210101")})


def _update(s, d):
    """Each submitted row with its code and number of curated genes, or with the reason for which it failed; and the codes whose place was taken."""
    codes = staged(domain(s, d, "submitted").select("assembly_acc", "genome"), "submitted")
    of = lambda name: domain(s, d, name).withColumnRenamed("ome", "genome").join(codes, "genome").drop("genome")
    models = of("docmodels").withColumn("row", F.struct("seqid", "start", "type", "attributes"))
    ledger = s.createDataFrame([], "code string, source string, version string, attempt_date string")
    done = update_catalog(_catalog(s, d), _submitted(s, d), _retired(s, d), ledger, models, of("dna").select("assembly_acc", "seqid", "sequence"), "20210102")
    genes = done.gff.where("type = 'gene'").groupBy("ome").agg(F.count("*").alias("genes"))
    added = done.catalog.where("version = '20210101'").select("assembly_acc", "ome").join(genes, "ome", "left")
    none = lambda t: F.lit(None).cast(t)
    rows = added.select("assembly_acc", "ome", "genes", none("string").alias("reason"))
    rows = rows.unionByName(done.failed.select("assembly_acc", none("string").alias("ome"), none("long").alias("genes"), "reason"))
    return rows.unionByName(done.replaced.select("assembly_acc", "ome", none("long").alias("genes"), F.lit("replaced").alias("reason")))


def _compared(s, d, *args, **limits):
    """The locus comparison, with hits and positions from the same genes, which lie by genome."""
    genes, tasks = genes_by_genome(s, d)
    return compare_loci(_hits(s, d, genes=genes), gene_positions(by_genome(s, d, "gff", genes)), *args, tasks=tasks, **limits)


JOBS = {
    "compare_loci": (
        lambda s, d: _compared(s, d, 10_000, max_hits=1000, evalue=0.008, bitscore=200, pident=0.003),
        f"""WITH {POS.strip()},
s AS (SELECT *, split_part(sseqid, '_', 1) AS ome, row_number() OVER (PARTITION BY split_part(sseqid, '_', 1), qseqid ORDER BY pident DESC, o, n, sseqid) AS k FROM {{hits}}),
a AS (SELECT ome, sseqid AS alias, qseqid, max(pident) AS pident FROM s WHERE k <= 1000 AND floor(bitscore) > 200 AND floor(1000 * pident) > 300 AND evalue <= 0.008 AND floor(1000 * ppos) > 0 GROUP BY ALL),
f AS (SELECT * FROM pos WHERE alias IN (SELECT alias FROM a)),
b AS (SELECT f.alias AS focus, ome, seqid, min(CASE WHEN p."end" >= f."start" - 10000 THEN p.pos END) AS lo, max(CASE WHEN p."start" <= f."end" + 10000 THEN p.pos END) AS hi FROM pos p JOIN f USING (ome, seqid) GROUP BY ALL),
l AS (SELECT focus, ome, alias, pos FROM pos JOIN b USING (ome, seqid) WHERE pos BETWEEN lo AND hi),
h AS (SELECT ome, focus, qseqid, CAST(max(pident) AS DECIMAL(18,6)) AS p FROM l JOIN a USING (ome, alias) GROUP BY ALL),
c AS (SELECT ome, focus, count(*) AS shared, CAST(sum(p) AS DOUBLE) AS p FROM h GROUP BY ALL HAVING count(*) > 1),
rated AS (SELECT ome, focus, shared / CAST((SELECT count(DISTINCT qseqid) FROM {{hits}}) AS DOUBLE) * (p / shared) / 100 AS similarity FROM c),
t AS (SELECT * FROM rated QUALIFY rank() OVER (PARTITION BY ome ORDER BY similarity DESC) = 1),
g AS (SELECT DISTINCT l.ome, l.alias, l.pos, t.similarity FROM l JOIN t USING (ome, focus))
SELECT g.ome, g.alias AS gene, g.pos, x.queries, g.similarity FROM g LEFT JOIN (SELECT ome, alias, string_agg(qseqid, ',' ORDER BY qseqid) AS queries FROM a GROUP BY ALL) x USING (ome, alias)""",
    ),
    "update_catalog": (
        _update,
        """WITH k AS (SELECT s.*, o.ome AS old, rpad(lower(substr(s.genus, 1, 3)) || lower(substr(s.species, 1, 3)), 6, '.') AS p FROM {submitted} s LEFT JOIN {omes} o ON o.assembly_acc = s.assembly_acc),
m AS (SELECT genome, count(*) AS genes FROM (SELECT DISTINCT ome AS genome, alias FROM {docgenes}) x GROUP BY genome),
c AS (SELECT k.assembly_acc, k.old, CASE WHEN old IS NOT NULL THEN old || '.1' ELSE p || row_number() OVER (PARTITION BY old IS NULL, p ORDER BY k.assembly_acc) END AS ome, m.genes FROM k LEFT JOIN m ON m.genome = k.genome)
SELECT assembly_acc, CASE WHEN genes IS NOT NULL THEN ome END AS ome, genes, CASE WHEN genes IS NULL THEN 'no annotation' END AS reason FROM c
UNION ALL SELECT assembly_acc, old, NULL, 'replaced' FROM c WHERE old IS NOT NULL AND genes IS NOT NULL
UNION ALL SELECT assembly_acc, NULL, NULL, 'no assembly' FROM {news} WHERE assembly_acc LIKE 'GCA_c%'""",
    ),
}
QUERIES = {name: job for name, (job, _) in JOBS.items()}
ORACLES = {name: oracle(sql) for name, (_, sql) in JOBS.items()}
