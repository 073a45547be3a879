"""Domain tables derived from the plain tables by SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.sources.shared import staged, table
from genomeloom.sources.store import stored

PLAIN = frozenset("region nation customer supplier part orders lineitem events documents".split())

#: name: SELECT over plain tables and earlier entries, each named in braces
TABLES = {
    "omes": """
SELECT s_suppkey, lower(substr(r_name, 1, 3)) || 'gen' || CAST(s_suppkey AS STRING) AS ome, replace(n_name, '_', '') AS genus,
  'sp' || CAST(s_suppkey % 7 AS STRING) AS species, 'st' || CAST(s_suppkey % 11 AS STRING) AS strain, r_name AS kingdom, n_name AS family,
  CASE WHEN s_suppkey % 2 = 0 THEN 'jgi' ELSE 'ncbi' END AS source,
  'GCA_' || CAST(CAST(floor(s_suppkey / 2.0) AS BIGINT) AS STRING) || '.' || CAST(1 + s_suppkey % 2 AS STRING) AS assembly_acc,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Author ' || CAST(s_suppkey AS STRING) END AS published,
  CAST(20200000 + s_suppkey % 400 AS STRING) AS version, 'bio' || CAST(s_suppkey % 60 AS STRING) AS biosample
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "genes": """
SELECT ome, ome || '_c' || CAST(part % 4 AS STRING) AS seqid, 1 + (o * 97 + n * 13) % 1000000 AS "start", 1 + (o * 97 + n * 13) % 1000000 + size * 30 AS "end",
  CASE WHEN flag = 'R' THEN '-' ELSE '+' END AS strand, ome || '_' || CAST(o AS STRING) || 'x' || CAST(n AS STRING) AS alias, o, n, part
FROM (SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS n, min(l_suppkey) AS supp, min(l_partkey) AS part, CAST(min(l_quantity) AS BIGINT) AS size, min(l_returnflag) AS flag
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) g JOIN {omes} ON supp = s_suppkey""",
    "gff": """
SELECT ome, seqid, 'x' AS source, CASE WHEN n = 7 THEN 'pseudogene' ELSE 'gene' END AS type, "start", "end", '.' AS score, strand, '.' AS phase,
  'ID=gene_' || alias || ';Alias=' || alias || ';product=kind ' || CAST(part % 50 AS STRING) AS attributes FROM {genes}
UNION ALL
SELECT ome, seqid, 'x', CASE WHEN n <= 4 THEN 'mRNA' WHEN n = 5 THEN 'tRNA' ELSE 'rRNA' END, "start", "end", '.', strand, '.', 'ID=rna_' || alias || ';Parent=gene_' || alias || ';Alias=' || alias || ';product=kind ' || CAST(part % 50 AS STRING) FROM {genes} WHERE n <= 6
UNION ALL
SELECT ome, seqid, 'x', 'CDS', "start", "start" + CAST(floor(("end" - "start") / 3.0) AS BIGINT), '.', strand, '0', 'ID=cds1_' || alias || ';Parent=rna_' || alias || ';Alias=' || alias FROM {genes} WHERE n <= 4
UNION ALL
SELECT ome, seqid, 'x', 'CDS', "end" - CAST(floor(("end" - "start") / 3.0) AS BIGINT), "end" + CASE WHEN part % 97 = 0 THEN 5 ELSE 0 END, '.', strand, '0', 'ID=cds2_' || alias || ';Parent=rna_' || alias || ';Alias=' || alias FROM {genes} WHERE n <= 4
UNION ALL
SELECT ome, seqid, 'x', 'exon', "start", "end", '.', strand, '.', 'ID=exon_' || alias || ';Parent=rna_' || alias || ';Alias=' || alias FROM {genes} WHERE n <= 4""",
    "contigs": """
SELECT source || lang AS ome, source || lang || '_' || CAST(doc_id AS STRING) AS seqid, text AS sequence FROM {documents}""",
    "hits": """
SELECT qseqid, sseqid, pident, ppos, sstart, send, evalue, bitscore, o, n FROM (
  SELECT 'q' || CAST(o_custkey % 50 AS STRING) AS qseqid, alias AS sseqid, CAST((o * 7919 + n * 104729 + part * 31) % 10001 AS DOUBLE) / 100 AS pident,
    CAST((o * 7919 + n * 104729 + part * 31) % 10001 AS DOUBLE) / 100 + 3 AS ppos, 1 + o % 200 AS sstart, 100 + (o * 3 + n) % 300 AS send,
    CAST((part * 13 + n) % 1000 AS DOUBLE) / 100000 AS evalue, CAST((o * 31 + part * 17) % 900 AS DOUBLE) AS bitscore, o, n
  FROM {genes} JOIN {orders} ON o = o_orderkey) h""",
    "cluster_pairs": """
SELECT min(alias) OVER (PARTITION BY part) AS rep, alias AS member FROM {genes}""",
    "likeness": """
SELECT least(a.p_partkey, b.p_partkey) AS src, greatest(a.p_partkey, b.p_partkey) AS dst, CAST((a.p_partkey * 37 + b.p_partkey * 91) % 101 AS DOUBLE) AS pident
FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
    "isoforms": """
SELECT ome, seqid, 'x' AS source, 'gene' AS type, "start", "end", '.' AS score, strand, '.' AS phase, 'ID=gene_' || alias || ';Alias=' || alias AS attributes FROM {genes} WHERE n <= 4
UNION ALL
SELECT ome, seqid, 'x', 'mRNA', "start", "end", '.', strand, '.', 'ID=rna' || CAST(k AS STRING) || '_' || alias || ';Parent=gene_' || alias || ';Alias=' || alias FROM {genes} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) t WHERE n <= 4
UNION ALL
SELECT ome, seqid, 'x', 'CDS', "start" + CASE WHEN k = 2 AND part % 2 = 0 THEN 3 ELSE 0 END, "end" - n, '.', strand, '0', 'ID=cds' || CAST(k AS STRING) || '_' || alias || ';Parent=rna' || CAST(k AS STRING) || '_' || alias || ';Alias=' || alias || ';protein_id=p' || CAST(CASE WHEN n <= 2 THEN k ELSE 1 END AS STRING) || '_' || alias
FROM {genes} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) t WHERE n <= 4""",
    "introns": """
SELECT ome, seqid, 'x' AS source, 'gene' AS type, "start", "end", '.' AS score, strand, '.' AS phase, 'ID=gene_' || alias AS attributes FROM {genes}
UNION ALL
SELECT ome, seqid, 'x', 'mRNA', "start", "end", '.', strand, '.', 'ID=rna_' || alias || ';Parent=gene_' || alias FROM {genes}
UNION ALL
SELECT ome, seqid, 'x', 'intron', "start" + 10, "start" + 10 + n, '.', strand, '.', 'ID=int_' || alias || ';Parent=rna_' || alias FROM {genes}""",
    "gtf": """
SELECT ome, seqid, 'x' AS source, type, CASE WHEN n = 1 THEN "end" ELSE "start" END AS "start", CASE WHEN n = 1 THEN "start" ELSE "end" END AS "end", '.' AS score, strand, '.' AS phase, 'gene_id ' || chr(34) || alias || chr(34) || '; transcript_id ' || chr(34) || alias || '.t' || chr(34) AS attributes
FROM {genes} CROSS JOIN (SELECT 'exon' AS type UNION ALL SELECT 'CDS' UNION ALL SELECT 'start_codon') t WHERE n <= 4 OR type = 'exon'""",
    "gff2": """
SELECT ome, seqid, 'x' AS source, type, "start", "end", '.' AS score, strand, '.' AS phase, 'name ' || chr(34) || alias || chr(34) || '; proteinId ' || CAST(o AS STRING) || '0' || CAST(n AS STRING) || CASE WHEN n = 2 THEN '; product_name ' || chr(34) || 'kind' || chr(34) ELSE '' END AS attributes
FROM {genes} CROSS JOIN (SELECT 'gene' AS type UNION ALL SELECT 'mRNA' UNION ALL SELECT 'CDS') t""",
    "tax": """
SELECT replace(n_name, '_', '') AS genus, r_name AS kingdom, n_name AS family FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""",
    "news": """
SELECT 'GCA_c' || CAST(c_custkey AS STRING) AS assembly_acc, r_name AS genus, 'gen' || n_name AS species, CAST(c_custkey AS BIGINT) AS c FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT assembly_acc, kingdom, 'gen', -CAST(s_suppkey AS BIGINT) FROM {omes}""",
    "aligned": """
SELECT file, ome, rpad(sequence, CAST(max(length(sequence)) OVER (PARTITION BY file) AS INT), '-') AS sequence FROM (
  SELECT lang || '_' || CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS STRING) AS file, source AS ome, text || '.' AS sequence FROM {documents} WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL) a""",
    "dna": """
SELECT source || lang AS ome, source || lang || '_' || CAST(doc_id AS STRING) AS seqid, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ARNDCEQGHILKMFPSTWYVX*ARND') AS protein
FROM {documents} WHERE text IS NOT NULL""",
    "docgenes": """
SELECT ome, seqid, seqid || 'g' AS alias, strand, 1 + CAST(floor(size / 10.0) AS BIGINT) AS a, size - CAST(floor(size / 10.0) AS BIGINT) AS b, CAST(floor(size / 5.0) AS BIGINT) AS s, size
FROM (SELECT source || lang AS ome, source || lang || '_' || CAST(doc_id AS STRING) AS seqid, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(length(text) AS BIGINT) AS size FROM {documents}) d WHERE size >= 20""",
    "docgff": """
SELECT ome, seqid, 'x' AS source, type, CASE WHEN type = 'CDS' AND k = 2 THEN b - s ELSE a END AS "start", CASE WHEN type = 'CDS' AND k = 1 THEN a + s ELSE b END AS "end", '.' AS score, strand, '.' AS phase, 'ID=' || type || CAST(k AS STRING) || alias || ';Alias=' || alias AS attributes
FROM {docgenes} CROSS JOIN (SELECT 'gene' AS type, 1 AS k UNION ALL SELECT 'mRNA', 1 UNION ALL SELECT 'CDS', 1 UNION ALL SELECT 'CDS', 2) t""",
    "docmodels": """
SELECT ome, seqid, 'x' AS source, type, CASE WHEN type = 'CDS' AND k = 2 THEN b - s ELSE a END AS "start", CASE WHEN type = 'CDS' AND k = 1 THEN a + s ELSE b END AS "end", '.' AS score, strand, '.' AS phase,
  CASE WHEN type = 'gene' THEN 'ID=g' || alias WHEN type = 'mRNA' THEN 'ID=r' || alias || ';Parent=g' || alias ELSE 'ID=c' || CAST(k AS STRING) || alias || ';Parent=r' || alias || ';protein_id=p' || alias END AS attributes
FROM {docgenes} CROSS JOIN (SELECT 'gene' AS type, 1 AS k UNION ALL SELECT 'mRNA', 1 UNION ALL SELECT 'CDS', 1 UNION ALL SELECT 'CDS', 2) t""",
    "submitted": """
SELECT 'GCA_' || CAST(row_number() OVER (ORDER BY source, lang) AS STRING) || '.1' AS assembly_acc, source AS genus, lang AS species, source || lang AS genome
FROM {documents} WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang""",
    "listing": """
SELECT 'GCA_' || CAST(o_custkey AS STRING) || '.' || CAST(1 + o_orderkey % 3 AS STRING) AS assembly_acc, 'GCA_' || CAST(o_custkey AS STRING) AS base, c_mktsegment AS grp, CAST(o_orderdate AS STRING) AS modified, CAST(o_orderkey AS BIGINT) AS o,
  CASE WHEN o_orderkey % 6 = 0 THEN '-' ELSE CAST(o_orderkey % 5000 AS STRING) END AS genes
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}


#: What a table's joins and groups are on: rows go there once. A number of tasks that is named is not made smaller, for these rows make many each.
TOGETHER = {"genes": ("lineitem", ("l_orderkey",))}
SPREAD = {"likeness": ("part", ("p_brand", "p_type", "p_size"))}
ROWS = 5_000


def _placed(name: str, x: str, df: DataFrame) -> DataFrame:
    if TOGETHER.get(name, ("",))[0] == x:
        return df.repartition(*TOGETHER[name][1])
    if SPREAD.get(name, ("",))[0] == x:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(least, -(-df.count() // ROWS)), *SPREAD[name][1])
    return df


#: Genes whose rows and all that is made of them are one task's work.
GENES = 50_000


def tasks_of(genes: DataFrame) -> int:
    """Tasks for what is made of ``genes``, a written table."""
    return max(int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-genes.count() // GENES))


def genes_by_genome(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The genes, written by genome, and the number of tasks that they are dealt to: what is made of them lies there too, and only genes are moved, not their features."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // GENES))
    genes = stored(domain(spark, sf_dir, "genes"), "genes", ["o", "n"], buckets=n, tidy=True)
    return _bare(genes), n


def _bare(df: DataFrame) -> DataFrame:
    """Columns without the names of their tables: a union keeps how its parts are dealt only then."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def by_genome(spark: SparkSession, sf_dir: str, name: str, genes: DataFrame) -> DataFrame:
    """A derived table made where the ``genes`` of ``genes_by_genome`` lie."""
    return _bare(domain(spark, sf_dir, name, genes=genes))


def needed(sql: str) -> list[str]:
    """The derived tables that ``sql`` builds on, in order of definition."""
    found: set[str] = set()
    todo = set(re.findall(r"\{(\w+)\}", sql)) - PLAIN
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo |= set(re.findall(r"\{(\w+)\}", TABLES[name])) - PLAIN
    return [name for name in TABLES if name in found]


def oracle(sql: str) -> str:
    """``sql`` with its derived tables as common table expressions, for an engine that knows the plain tables."""
    bare = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    parts = [f"{name} AS ({bare(TABLES[name])})" for name in needed(sql)]
    body = bare(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join([*parts, body[len('WITH RECURSIVE'):].strip()])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*parts, body[5:].strip()])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


def domain(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A derived table as a DataFrame; those it builds on that are already ``made`` are not made again."""
    if name in PLAIN:
        return table(spark, sf_dir, name)
    used = re.findall(r"\{(\w+)\}", TABLES[name])
    parts = {x: made[x] if x in made else domain(spark, sf_dir, x, **made) for x in set(used)}
    # what a table reads several times is made once
    parts = {x: staged(df, x) if used.count(x) > 1 and x not in PLAIN and x not in made else df for x, df in parts.items()}
    parts = {x: _placed(name, x, df) for x, df in parts.items()}
    return spark.sql(TABLES[name].replace('"', "`"), **parts)
