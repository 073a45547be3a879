"""Registered queries on sequences cut by annotation, and on column functions of sequences, hits and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from genomeloom.functions import columns as C
from genomeloom.jobs.fixtures import domain, oracle
from genomeloom.operators import hits as H
from genomeloom.operators import sequences as S

REVERSE = "reverse(translate({}, '" + C.COMPLEMENT[0] + "', '" + C.COMPLEMENT[1] + "'))"
CDS = "x AS (SELECT g.ome, g.seqid, g.alias, g.strand, substr(sequence, a, s + 1) || substr(sequence, b - s, s + 1) AS piece FROM {docgenes} g JOIN {dna} d ON d.seqid = g.seqid), c AS (SELECT ome, alias, CASE WHEN strand = '-' THEN " + REVERSE.format("piece") + " ELSE piece END AS sequence FROM x)"


def _translated(sequence: str) -> str:
    """Residues of the codons, each looked up by the places of its letters."""
    at = lambda k: f"(strpos('TCAG', substr(codon, {k}, 1)) - 1)"
    codons = f"regexp_extract_all(translate({sequence}, 'acgtuU', 'ACGTTT'), '[\\s\\S][\\s\\S][\\s\\S]')"
    one = f"CASE WHEN least({at(1)}, {at(2)}, {at(3)}) < 0 THEN 'X' ELSE substr('{C.STANDARD_CODE}', 1 + 16 * {at(1)} + 4 * {at(2)} + {at(3)}, 1) END"
    return f"array_to_string(list_transform({codons}, lambda codon: {one}), '')"


def _dna(s, d):
    return domain(s, d, "dna")


def _hmm(s, d):
    hits = domain(s, d, "hits").select(F.col("qseqid").alias("query"), F.lit(200).alias("model_len"), F.col("sseqid").alias("seq"), F.col("evalue").alias("seq_e"), F.col("bitscore").alias("seq_score"))
    domains = domain(s, d, "hits").select(F.col("qseqid").alias("query"), F.col("sseqid").alias("seq"), F.col("sstart").alias("hmm_from"), F.col("send").alias("hmm_to"))
    return H.select_hmm_hits(hits, domains, 0.5, 0.008, 100, 30)


HMM = "h AS (SELECT qseqid AS query, sseqid AS seq, bitscore AS seq_score, sstart AS hmm_from, send AS hmm_to FROM {hits} WHERE send - sstart + 1 >= 100 AND evalue < 0.008 AND bitscore >= 100 QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) <= 30)"
MASS = " + ".join(f"{w} * (len(p) - len(replace(p, '{x}', '')))" for x, w in (C.MASS | {"X": sum(C.MASS.values()) / len(C.MASS)}).items())
JOBS = {
    "q1_proteins": (
        lambda s, d: S.proteins_from_gff(domain(s, d, "docgff"), _dna(s, d)).select("ome", "alias", F.sha2("sequence", 256).alias("digest")),
        f"WITH {CDS} SELECT ome, alias, sha256({_translated('sequence')}) AS digest FROM c",
    ),
    "q2_cds": (lambda s, d: S.cds_from_gff(domain(s, d, "docgff"), _dna(s, d)).select("ome", "alias", F.sha2("sequence", 256).alias("digest")), f"WITH {CDS} SELECT ome, alias, sha256(sequence) AS digest FROM c"),
    "q2_cds_with_flanks": (
        lambda s, d: S.cds_from_gff(domain(s, d, "docgff"), _dna(s, d), 7).select("ome", "alias", F.sha2("sequence", 256).alias("digest")),
        "WITH x AS (SELECT g.ome, g.alias, g.strand, substr(sequence, greatest(a - 7, 1), a + s - greatest(a - 7, 1) + 1) || substr(sequence, b - s, s + 8) AS piece FROM {docgenes} g JOIN {dna} d ON d.seqid = g.seqid) SELECT ome, alias, sha256(CASE WHEN strand = '-' THEN " + REVERSE.format("piece") + " ELSE piece END) AS digest FROM x",
    ),
    "q3_gene_spans": (
        lambda s, d: S.gene_spans(domain(s, d, "docgff"), _dna(s, d), 15).select("ome", "alias", F.sha2("sequence", 256).alias("digest"), "before", "after"),
        "WITH x AS (SELECT g.ome, g.alias, g.strand, least(15, a - 1) AS before, greatest(0, least(15, size - b)) AS after, a, b, sequence FROM {docgenes} g JOIN {dna} d ON d.seqid = g.seqid), y AS (SELECT *, substr(sequence, a - before, b + after - a + before + 1) AS piece FROM x) SELECT ome, alias, sha256(CASE WHEN strand = '-' THEN " + REVERSE.format("piece") + " ELSE piece END) AS digest, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM y",
    ),
    "q4_region_sequences": (
        lambda s, d: S.region_sequences(domain(s, d, "docgff"), _dna(s, d), 5).select("seqid", F.sha2("sense", 256).alias("sense"), F.sha2("antisense", 256).alias("antisense")),
        "WITH x AS (SELECT g.seqid, substr(sequence, greatest(a - 5, 1), b + 5 - greatest(a - 5, 1) + 1) AS piece FROM {docgenes} g JOIN {dna} d ON d.seqid = g.seqid) SELECT seqid, sha256(piece) AS sense, sha256(" + REVERSE.format("piece") + ") AS antisense FROM x",
    ),
    "q5_prefix_contigs": (
        lambda s, d: S.prefix_contigs(domain(s, d, "gff").withColumn("seqid", F.when(F.col("type") == "gene", F.expr("substring(seqid, length(ome) + 2)")).when(F.col("type") == "CDS", F.expr("ome || '.3_' || substring(seqid, length(ome) + 2)")).otherwise(F.col("seqid")))).select("ome", "seqid", "type", "start", "end", "attributes"),
        "SELECT ome, seqid, type, \"start\", \"end\", attributes FROM {gff}",
    ),
    "q6_translate_fasta": (lambda s, d: S.translate_fasta(_dna(s, d).select("seqid", "sequence")).select("seqid", F.sha2("sequence", 256).alias("digest")), f"SELECT seqid, sha256({_translated('sequence')}) AS digest FROM {{dna}}"),
    "a22_proteome_qc": (
        lambda s, d: S.proteome_qc(S.proteins_from_gff(domain(s, d, "docgff"), _dna(s, d))),
        f"WITH {CDS}, p AS (SELECT ome, replace({_translated('sequence')}, '*', '') AS p FROM c) SELECT ome, count(*) AS n, count(*) FILTER (WHERE len(p) = 0) AS n_empty, count(*) = count(*) FILTER (WHERE len(p) = 0) AS rejected FROM p GROUP BY ome",
    ),
    "j4_extract_regions": (
        lambda s, d: S.extract_regions(s.sql(REGIONS, docgenes=domain(s, d, "docgenes")), _dna(s, d)).select("name", F.sha2("sequence", 256).alias("digest"), "overrun"),
        """WITH r AS (SELECT alias, strand, substr(sequence, CAST(a + 1 AS BIGINT), 30) AS x, substr(sequence, CAST(s + 1 AS BIGINT), CAST(size - 1 - s AS BIGINT)) AS y, a, s, size FROM {docgenes} g JOIN {dna} d ON d.seqid = g.seqid),
p AS (SELECT *, CASE WHEN s < a THEN y || x ELSE x || y END AS f FROM r)
SELECT alias AS name, sha256(CASE WHEN strand = '-' THEN """ + REVERSE.format("f") + """ ELSE f END) AS digest, a + 30 > size AS overrun FROM p""",
    ),
    "w9_hmm_hits": (lambda s, d: _hmm(s, d)[0].select("query", "seq", "seq_score"), f"WITH {HMM} SELECT query, seq, seq_score FROM h"),
    "w9_hmm_domains": (lambda s, d: _hmm(s, d)[1], f"WITH {HMM} SELECT query, seq, hmm_from, hmm_to FROM h"),
    "f1_ome_of": (lambda s, d: domain(s, d, "genes").select("alias", C.ome_of(F.col("alias")).alias("code")), "SELECT alias, split_part(alias, '_', 1) AS code FROM {genes}"),
    "f2_gff3_attributes": (
        lambda s, d: domain(s, d, "gff").select("attributes", *(C.gff3_attr(F.col("attributes"), x).alias(x.lower()) for x in ("ID", "Parent", "product", "OG"))),
        "SELECT attributes, " + ", ".join(f"nullif(regexp_extract(attributes, '(?:^|;){x}=([^;]*)', 1), '') AS {x.lower()}" for x in ("ID", "Parent", "product", "OG")) + " FROM {gff}",
    ),
    "f3_gtf_attributes": (lambda s, d: domain(s, d, "gtf").select("attributes", C.gtf_attr(F.col("attributes"), "gene_id").alias("gene"), C.gtf_attr(F.col("attributes"), "transcript_id").alias("tx")), "SELECT attributes, split_part(attributes, chr(34), 2) AS gene, split_part(attributes, chr(34), 4) AS tx FROM {gtf}"),
    "f8_codon_frames": (
        lambda s, d: _dna(s, d).select("seqid", F.explode(C.codon_frames(F.col("sequence"))).alias("frame", "codons")).select("seqid", "frame", F.size("codons").alias("n"), F.sha2(F.array_join("codons", ""), 256).alias("digest")),
        "WITH b AS (SELECT seqid, sequence AS x, 1 AS sign FROM {dna} UNION ALL SELECT seqid, " + REVERSE.format("sequence") + ", -1 FROM {dna}), f AS (SELECT seqid, sign * (k + 1) AS frame, substr(x, k + 1, 3 * greatest(CAST(floor((len(x) - k) / 3.0) AS BIGINT), 0)) AS y FROM b CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t) SELECT seqid, CAST(frame AS INT) AS frame, CAST(len(y) // 3 AS INT) AS n, sha256(y) AS digest FROM f",
    ),
    "f10_base_counts": (
        lambda s, d: domain(s, d, "contigs").select("seqid", C.base_counts(F.col("sequence")).alias("x")).select("seqid", "x.*"),
        "SELECT seqid, len(sequence) - len(translate(sequence, 'acgtACGT', '')) AS acgt, len(sequence) - len(translate(sequence, 'gcGC', '')) AS gc, len(sequence) - len(translate(sequence, 'acgt', '')) AS masked FROM {contigs}",
    ),
    "f11_protein_mass": (
        lambda s, d: _dna(s, d).select("seqid", F.round(C.protein_mass(F.regexp_replace("protein", "[^A-Z*]", "")), 3).alias("mass")),
        f"WITH x AS (SELECT seqid, replace(regexp_replace(protein, '[^A-Z*]', '', 'g'), '*', '') AS p FROM {{dna}}) SELECT seqid, round(CASE WHEN len(p) > 0 THEN {MASS} - 18.01 * (len(p) - 1) ELSE 0 END, 3)::DOUBLE AS mass FROM x",
    ),
    "f13_clean_names": (lambda s, d: domain(s, d, "part").select("p_partkey", C.clean_name(F.concat_ws(" ", "p_name", "p_type")).alias("plain"), C.clean_name(F.concat_ws(" ", "p_name", "p_type"), True).alias("strict")), "SELECT p_partkey, regexp_replace(p_name || ' ' || p_type, '[^A-Za-z0-9_]', '', 'g') AS plain, regexp_replace(p_name || ' ' || p_type, '[^A-Za-z0-9]', '', 'g') AS strict FROM part"),
    "f19_og_tags": (lambda s, d: domain(s, d, "genes").select("alias", C.format_og_tags(C.parse_og_tags(F.expr("'Z:' || part || '|S:1|K:' || n || '|A:2'"))).alias("tags")), "SELECT alias, 'K:' || n || '|S:1|A:2|Z:' || part AS tags FROM {genes}"),
    "f20_tree_support": (
        lambda s, d: domain(s, d, "part").select("p_partkey", F.expr("concat('((a:1,b:1)', p_size, ':1,(c:1,d:1)', p_partkey % 100, ':0.5):0;')").alias("t")).select("p_partkey", C.tree_mean_support(F.col("t")).alias("support"), C.strip_support(F.col("t")).alias("bare")),
        "SELECT p_partkey, CASE WHEN p_size > 1 OR p_partkey % 100 > 1 THEN (p_size + p_partkey % 100) / 2.0::DOUBLE / 100 ELSE (p_size + p_partkey % 100) / 2.0::DOUBLE END AS support, '((a:1,b:1):1,(c:1,d:1):0.5):0;' AS bare FROM part",
    ),
    "f21_set_indexes": (
        lambda s, d: domain(s, d, "genes").select("alias", *(f(F.col("n"), F.col("n") + F.col("o") % 5, F.col("n") + F.col("part") % 7).alias(name) for name, f in (("jaccard", C.jaccard), ("sorensen", C.sorensen), ("overlap", C.overlap)))),
        "WITH x AS (SELECT alias, n::DOUBLE AS n, (n + o % 5)::DOUBLE AS a, (n + part % 7)::DOUBLE AS b FROM {genes}) SELECT alias, n / (a + b - n) AS jaccard, 2 * n / (a + b) AS sorensen, n / least(a, b) AS overlap FROM x",
    ),
    "f22_plain_numbers": (lambda s, d: domain(s, d, "hits").select("sseqid", C.fmt_float(F.col("evalue")).alias("text")), "SELECT sseqid, regexp_replace(regexp_replace(printf('%.5f', evalue), '0+$', ''), '\\.$', '') AS text FROM {hits}"),
}
REGIONS = """SELECT ome, seqid, a AS "start", a + 30 AS "end", strand, alias AS name FROM {docgenes} UNION ALL SELECT ome, seqid, s, -1, strand, alias FROM {docgenes}""".replace('"', "`")
QUERIES = {name: job for name, (job, _) in JOBS.items()}
ORACLES = {name: oracle(sql) for name, (_, sql) in JOBS.items()}
