"""Registered queries on the catalog: listings, redundancy between archives, codes and files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from genomeloom.functions import columns as C
from genomeloom.jobs.fixtures import domain, oracle
from genomeloom.jobs.group_jobs import _catalog
from genomeloom.operators import catalog as K


def _tax(s, d):
    return domain(s, d, "tax").distinct().select("genus", F.create_map(F.lit("kingdom"), F.col("kingdom"), F.lit("family"), F.col("family"), F.lit("no rank"), F.lit("x")).alias("taxonomy"))


def _new(s, d):
    return domain(s, d, "news").select("assembly_acc", "genus", "species")


def _mixed_codes(s, d):
    """New rows whose given, new and repeated codes share prefixes, with and without names."""
    return s.sql(MIXED, omes=domain(s, d, "omes"), customer=domain(s, d, "customer"))


MIXED = """SELECT 'm' || CAST(c_custkey AS STRING) AS assembly_acc, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE o.kingdom END AS genus, 'gen' AS species,
 CASE WHEN c_custkey % 10 = 0 THEN o.ome WHEN c_custkey % 10 = 1 THEN substr(o.ome, 1, 6) || CAST(200 + c_custkey % 700 AS STRING) WHEN c_custkey % 10 = 2 THEN 'Bad' || CAST(c_custkey AS STRING) ELSE '' END AS ome
FROM {customer} JOIN {omes} o ON s_suppkey = 1 + c_custkey % 20
UNION ALL SELECT assembly_acc, kingdom, 'gen', '' FROM {omes} WHERE s_suppkey % 3 = 0"""
MIXED_SQL = f"""WITH x AS ({MIXED}), b AS (SELECT *, regexp_extract(ome, '^(......[0-9]+)', 1) AS base, CASE WHEN contains(substr(ome, 7), '.') THEN CAST(split_part(substr(ome, 7), '.', 2) AS INT) ELSE 0 END AS v FROM (SELECT ome, assembly_acc FROM {{omes}} UNION ALL SELECT lower(substr(r_name, 1, 3)) || 'gen' || CAST(5000 + r_regionkey AS STRING), NULL FROM {{region}}) u),
ver AS (SELECT base, max(v) AS v FROM b GROUP BY base), acc AS (SELECT assembly_acc, max(base) AS base FROM b WHERE assembly_acc IS NOT NULL GROUP BY assembly_acc),
k AS (SELECT x.assembly_acc, x.ome, lower(substr(genus, 1, 3)) || 'gen' AS prefix, CASE WHEN x.ome <> '' THEN regexp_extract(x.ome, '^(......[0-9]+)', 1) ELSE acc.base END AS base FROM x LEFT JOIN acc ON acc.assembly_acc = x.assembly_acc),
g AS (SELECT k.*, ver.v, CASE WHEN k.ome <> '' AND NOT regexp_matches(k.ome, '^[a-z. ]+[0-9]+([.][0-9]+)?$') THEN 'malformed' WHEN ver.v IS NOT NULL THEN 'next' WHEN k.ome <> '' THEN 'given' WHEN prefix IS NULL THEN 'no name' ELSE 'new' END AS kind FROM k LEFT JOIN ver ON ver.base = k.base),
t AS (SELECT substr(base, 1, 6) AS prefix, max(CAST(substr(base, 7) AS INT)) AS top FROM (SELECT base FROM b UNION ALL SELECT base FROM g WHERE kind = 'given') y GROUP BY 1),
n AS (SELECT g.*, top, row_number() OVER (PARTITION BY kind, CASE kind WHEN 'next' THEN g.base WHEN 'given' THEN ome ELSE g.prefix END ORDER BY assembly_acc) AS nth FROM g LEFT JOIN t ON t.prefix = g.prefix),
c AS (SELECT assembly_acc, CASE WHEN kind = 'next' THEN base || '.' || (v + nth) WHEN kind = 'given' AND nth = 1 THEN ome WHEN kind = 'new' THEN prefix || (coalesce(top, 0) + nth) END AS code, CASE WHEN kind = 'given' THEN 'given twice' ELSE kind END AS failure FROM n)"""


def _retired(s, d):
    return domain(s, d, "region").select(F.expr("lower(substr(r_name, 1, 3)) || 'gen' || CAST(5000 + r_regionkey AS STRING)").alias("ome"))


def _portals(s, d):
    """Portal rows: one for each customer, its code, names as of its nation, a version and a biosample."""
    return s.sql(PORTALS, customer=domain(s, d, "customer"), nation=domain(s, d, "nation"))


def _archive(s, d):
    return s.sql(ARCHIVE, omes=domain(s, d, "omes"))


PORTALS = """SELECT 'P' || CAST(c_custkey AS STRING) AS portal, replace(n_name, '_', '') AS genus, 'sp' || CAST(c_custkey % 7 AS STRING) AS species, 'st' || CAST(c_custkey % 13 AS STRING) AS strain, CAST(20200000 + c_custkey % 900 AS STRING) AS version, 'bio' || CAST(c_custkey AS STRING) AS biosample
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
ARCHIVE = """SELECT assembly_acc, CASE WHEN s_suppkey % 4 = 0 THEN 'P' || CAST(s_suppkey AS STRING) ELSE 'asm' END AS assembly_name, CASE WHEN s_suppkey % 9 = 0 THEN 'JGI' ELSE 'lab' END AS submitter, genus, species, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE strain END AS strain, biosample FROM {omes}"""
PAIRS = "SELECT assembly_acc, 'P' || CAST(s_suppkey AS STRING) AS portal FROM {omes} WHERE source = 'ncbi' AND published = ''"
OVERLAP = f"""WITH a AS ({ARCHIVE}), j AS ({PORTALS}), pr AS ({PAIRS}),
f AS (SELECT DISTINCT lower(genus || '_' || species || '_' || strain) AS k FROM j), b AS (SELECT DISTINCT lower(genus || '_' || species) AS k FROM j),
r AS (SELECT a.assembly_acc, CASE WHEN a.assembly_acc IN (SELECT assembly_acc FROM pr) THEN 'pair' WHEN assembly_name IN (SELECT portal FROM j) THEN 'name' WHEN contains(lower(submitter), 'jgi') THEN 'submitter'
 WHEN lower(genus || '_' || species || '_' || strain) IN (SELECT k FROM f) THEN 'strain' WHEN strain = '' AND lower(genus || '_' || species) IN (SELECT k FROM b) THEN 'species' END AS rule FROM a)"""


def _pairs(s, d):
    return s.sql(PAIRS, omes=domain(s, d, "omes"))


def _overlap(s, d):
    return K.cross_source_overlap(_archive(s, d), _portals(s, d), _pairs(s, d))


def _added(s, d):
    """Rows to merge: customers under codes that the catalog has in part, some with an accession that it holds."""
    return s.sql(ADDED, customer=domain(s, d, "customer"), nation=domain(s, d, "nation"), region=domain(s, d, "region"))


ADDED = """SELECT lower(substr(r_name, 1, 3)) || 'gen' || CAST(c_custkey AS STRING) AS ome, CASE WHEN c_custkey % 3 = 0 THEN 'GCA_' || CAST(CAST(floor(c_custkey / 6.0) AS BIGINT) AS STRING) || '.1' ELSE 'GCA_n' || CAST(c_custkey AS STRING) END AS assembly_acc, r_name AS genus, 'gen' AS species
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""


def _genera(s, d):
    return domain(s, d, "omes").select("ome", "genus", F.when(F.col("source") == "jgi", F.create_map(F.lit("kingdom"), F.lit(""))).otherwise(F.create_map(F.lit("kingdom"), F.col("kingdom"))).alias("taxonomy"))


def _files(s, d):
    return s.sql(FILES, omes=domain(s, d, "omes"))


FILES = "SELECT ome, CASE WHEN source = 'jgi' THEN '/d/' || ome || '.fna' ELSE '' END AS fna, CASE WHEN published <> '' THEN '/d/' || ome || '.faa' END AS faa, '/d/' || ome || '.gff3' AS gff3 FROM {omes}"
STATUS = "SELECT o_orderkey AS o, CASE WHEN o_orderstatus = 'F' THEN 'cited ' || CAST(o_custkey AS STRING) ELSE '' END AS citation, CASE WHEN o_orderstatus = 'O' THEN 'Yes' ELSE 'no' END AS is_published, CASE WHEN o_custkey % 2 = 0 THEN 'true' END AS is_public FROM {orders}"
JOBS = {
    "p9_lookup_codes": (
        lambda s, d: K.lookup_codes(domain(s, d, "omes").select(F.when(F.col("source") == "ncbi", F.concat("ome", F.lit("."), F.col("version").substr(7, 2))).otherwise(F.col("ome")).alias("ome")).unionByName(domain(s, d, "omes").select(F.concat("ome", F.lit(".3")).alias("ome"))), domain(s, d, "omes").select(F.col("ome").alias("code"))).select("code", "ome"),
        """WITH c AS (SELECT ome AS code, CASE WHEN source = 'ncbi' THEN ome || '.' || substr(version, 7, 2) ELSE ome END AS ome FROM {omes} UNION ALL SELECT ome, ome || '.3' FROM {omes})
SELECT code, ome FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN ome = code THEN 0 ELSE 1 END, coalesce(TRY_CAST(split_part(ome, '.', 2) AS INT), 0) DESC, ome DESC) = 1""",
    ),
    "p15_clean_listing": (
        lambda s, d: K.clean_assembly_listing(domain(s, d, "listing").withColumn("proteins", F.when(F.col("o") % 7 == 0, "0").otherwise("12")), ["building", "MACHINERY"], domain(s, d, "omes").select("assembly_acc", "genus")).select("o", "genus"),
        "SELECT l.o, m.genus FROM {listing} l JOIN {omes} m ON m.assembly_acc = l.assembly_acc WHERE lower(l.grp) IN ('building', 'machinery') AND l.genes NOT IN ('-', '', '0') AND l.o % 7 <> 0",
    ),
    "p16_publication_status": (
        lambda s, d: K.publication_status(s.sql(STATUS, orders=domain(s, d, "orders"))).select("o", "published"),
        f"WITH x AS ({STATUS}) SELECT o, CASE WHEN citation <> '' THEN citation ELSE '1' END AS published FROM x WHERE citation <> '' OR is_published = 'Yes' OR is_public = 'true'",
    ),
    "j5_assimilate_taxonomy": (
        lambda s, d: K.assimilate_taxonomy(_catalog(s, d), _tax(s, d)).select("ome", F.try_element_at("taxonomy", F.lit("kingdom")).alias("kingdom"), F.size("taxonomy").alias("ranks")),
        "SELECT ome, CASE WHEN kingdom <> 'ASIA' THEN kingdom END AS kingdom, CAST(CASE WHEN kingdom <> 'ASIA' THEN 2 ELSE 0 END AS INT) AS ranks FROM {omes}",
    ),
    "j6_genera_needing_taxonomy": (lambda s, d: K.genera_needing_taxonomy(_genera(s, d), _tax(s, d)), "SELECT DISTINCT genus FROM {omes} WHERE source = 'jgi' AND kingdom = 'ASIA'"),
    "j7_constrain_lineages": (
        lambda s, d: K.constrain_lineages(_catalog(s, d), _tax(s, d), domain(s, d, "nation").where("n_nationkey = 8").select(F.lit("genus").alias("rank"), F.regexp_replace("n_name", "_", "").alias("name")).union(domain(s, d, "region").where("r_name = 'EUROPE'").select(F.lit("Kingdom"), F.lower("r_name")))).select("ome"),
        "SELECT ome FROM {omes} WHERE kingdom = 'EUROPE' OR genus = (SELECT replace(n_name, '_', '') FROM {nation} WHERE n_nationkey = 8)",
    ),
    "j8_attach_organism": (lambda s, d: K.attach_organism(domain(s, d, "listing"), domain(s, d, "omes").select("assembly_acc", "genus"))[0].select("o", "genus"), "SELECT l.o, m.genus FROM {listing} l JOIN {omes} m ON m.assembly_acc = l.assembly_acc"),
    "j8_retried_accessions": (lambda s, d: K.attach_organism(domain(s, d, "listing"), domain(s, d, "omes").select("assembly_acc", "genus"))[1], "SELECT DISTINCT replace(assembly_acc, 'GCA_', 'GCF_') AS assembly_acc FROM {listing} WHERE assembly_acc NOT IN (SELECT assembly_acc FROM {omes})"),
    "j9_cross_source_overlap": (lambda s, d: _overlap(s, d)[1].select("assembly_acc", "rule"), OVERLAP + " SELECT assembly_acc, rule FROM r WHERE rule IS NOT NULL"),
    "j9_unique_rows": (lambda s, d: _overlap(s, d)[0].select("assembly_acc"), OVERLAP + " SELECT assembly_acc FROM r WHERE rule IS NULL"),
    "j9_overlap_pairs": (
        lambda s, d: K.overlap_tables(_archive(s, d), _portals(s, d), _pairs(s, d), _pairs(s, d).limit(0))[0].select("assembly_acc", "portal", "biosample"),
        OVERLAP
        + """, ff AS (SELECT lower(genus || '_' || species || '_' || strain) AS k, min(portal) AS portal FROM j GROUP BY 1), bb AS (SELECT lower(genus || '_' || species) AS k, min(portal) AS portal FROM j GROUP BY 1)
SELECT assembly_acc, portal, NULL AS biosample FROM pr
UNION ALL SELECT a.assembly_acc, CASE r.rule WHEN 'name' THEN a.assembly_name WHEN 'strain' THEN ff.portal ELSE bb.portal END, a.biosample
FROM r JOIN a ON a.assembly_acc = r.assembly_acc LEFT JOIN ff ON ff.k = lower(genus || '_' || species || '_' || strain) LEFT JOIN bb ON bb.k = lower(genus || '_' || species) WHERE r.rule IN ('name', 'strain', 'species')""",
    ),
    "j11_jgi_redundancy": (
        lambda s, d: K.jgi_redundancy(_catalog(s, d).withColumn("assembly_acc", F.when(F.col("source") == "jgi", F.concat(F.lit("P"), F.regexp_extract("ome", r"(\d+)$", 1))).otherwise(F.col("assembly_acc"))), _portals(s, d), _pairs(s, d), _portals(s, d).where("version = '20200007'")).select("portal", "old_ome", "rule"),
        f"""WITH j AS (SELECT * FROM ({PORTALS}) x WHERE version <> '20200007'), c AS (SELECT s_suppkey, ome, source, version, biosample, CASE WHEN source = 'jgi' THEN 'P' || s_suppkey ELSE assembly_acc END AS acc FROM {{omes}}),
b AS (SELECT biosample, min(ome) AS ome FROM c GROUP BY biosample HAVING count(*) = 1), p AS (SELECT x.portal, min(c.ome) AS ome FROM ({PAIRS}) x JOIN c ON c.acc = x.assembly_acc GROUP BY x.portal)
SELECT j.portal, coalesce(c.ome, b.ome, p.ome) AS old_ome, CASE WHEN c.ome IS NOT NULL THEN CASE WHEN CAST(j.version AS INT) > CAST(c.version AS INT) THEN 'update' ELSE 'known' END WHEN b.ome IS NOT NULL THEN 'biosample' WHEN p.ome IS NOT NULL THEN 'pair' ELSE 'new' END AS rule
FROM j LEFT JOIN c ON c.source = 'jgi' AND c.acc = j.portal LEFT JOIN b ON b.biosample = j.biosample LEFT JOIN p ON p.portal = j.portal""",
    ),
    "j18_restore_overlap": (
        lambda s, d: K.restore_failed_overlap(_overlap(s, d)[0].select("assembly_acc"), _overlap(s, d)[1], _portals(s, d).where("strain = 'st5'").select(F.col("portal").alias("code")), _pairs(s, d)),
        OVERLAP + " SELECT assembly_acc FROM r WHERE rule IS NULL UNION ALL SELECT assembly_acc FROM r WHERE rule IS NOT NULL AND assembly_acc IN (SELECT pr.assembly_acc FROM pr JOIN j ON j.portal = pr.portal WHERE j.strain = 'st5')",
    ),
    "w14_generate_codes": (
        lambda s, d: K.generate_codes(_new(s, d), _catalog(s, d), _retired(s, d)).select("assembly_acc", "ome"),
        """WITH u AS (SELECT substr(ome, 1, 6) AS p, CAST(substr(ome, 7) AS INT) AS k FROM {omes} UNION ALL SELECT lower(substr(r_name, 1, 3)) || 'gen', CAST(5000 + r_regionkey AS INT) FROM {region}),
t AS (SELECT p, max(k) AS top FROM u GROUP BY p), x AS (SELECT assembly_acc, lower(substr(genus, 1, 3)) || 'gen' AS p FROM {news} WHERE assembly_acc LIKE 'GCA_c%')
SELECT x.assembly_acc, x.p || (coalesce(t.top, 0) + row_number() OVER (PARTITION BY x.p ORDER BY x.assembly_acc)) AS ome FROM x LEFT JOIN t ON t.p = x.p
UNION ALL SELECT assembly_acc, ome || '.1' FROM {omes}""",
    ),
    "w14_given_codes": (
        lambda s, d: K.generate_codes(domain(s, d, "omes").select(F.concat(F.lit("n"), "assembly_acc").alias("assembly_acc"), "genus", "species", F.when(F.col("source") == "jgi", F.col("ome")).when(F.col("published") == "", F.lit("Bad1")).otherwise(F.concat(F.lit("zzzzzz"), F.regexp_extract("ome", r"(\d+)$", 1))).alias("ome")), _catalog(s, d), _retired(s, d)).select("assembly_acc", "ome"),
        "SELECT 'n' || assembly_acc AS assembly_acc, CASE WHEN source = 'jgi' THEN ome || '.1' ELSE 'zzzzzz' || s_suppkey END AS ome FROM {omes} WHERE source = 'jgi' OR published <> ''",
    ),
    "w14_shared_prefixes": (lambda s, d: K.generate_codes(_mixed_codes(s, d), _catalog(s, d), _retired(s, d)).select("assembly_acc", "ome"), MIXED_SQL + " SELECT assembly_acc, code AS ome FROM c WHERE code IS NOT NULL"),
    "w14_failed_codes": (lambda s, d: K.failed_codes(_mixed_codes(s, d), _catalog(s, d), _retired(s, d)), MIXED_SQL + " SELECT assembly_acc, failure FROM c WHERE code IS NULL"),
    "w15_merge_catalog": (
        lambda s, d: K.merge_catalog(domain(s, d, "omes").select("ome", "assembly_acc", "genus", "species"), _added(s, d))[0].select("ome", "assembly_acc"),
        f"""WITH a AS (SELECT * FROM ({ADDED}) x WHERE assembly_acc NOT IN (SELECT assembly_acc FROM {{omes}})), k AS (SELECT ome FROM {{omes}} UNION ALL SELECT ome FROM a),
t AS (SELECT substr(ome, 1, 6) AS p, max(CAST(substr(ome, 7) AS INT)) AS top FROM k GROUP BY 1), c AS (SELECT * FROM a WHERE ome IN (SELECT ome FROM {{omes}}))
SELECT ome, assembly_acc FROM {{omes}} UNION ALL SELECT ome, assembly_acc FROM a WHERE ome NOT IN (SELECT ome FROM {{omes}})
UNION ALL SELECT substr(c.ome, 1, 6) || (t.top + row_number() OVER (PARTITION BY t.p ORDER BY c.assembly_acc)), c.assembly_acc FROM c JOIN t ON t.p = substr(c.ome, 1, 6)""",
    ),
    "w16_promote": (
        lambda s, d: K.promote(domain(s, d, "omes").select("ome", "version"), domain(s, d, "omes").where("source = 'ncbi'").select(F.concat("ome", F.lit(".1")).alias("ome"), "version"))[0],
        "SELECT ome, version FROM {omes} WHERE source <> 'ncbi' UNION ALL SELECT ome || '.1', version FROM {omes} WHERE source = 'ncbi'",
    ),
    "a20_stale_files": (lambda s, d: K.stale_files(_added(s, d).select("ome", "assembly_acc"), _catalog(s, d)), f"SELECT ome, assembly_acc FROM ({ADDED}) x WHERE ome NOT IN (SELECT ome FROM {{omes}})"),
    "a23_file_completeness": (lambda s, d: K.file_completeness(_files(s, d), ("fna", "faa", "gff3")), "SELECT ome, concat_ws(',', CASE WHEN source <> 'jgi' THEN 'fna' END, CASE WHEN published = '' THEN 'faa' END) AS lacking FROM {omes}"),
    "s22_file_manifest": (lambda s, d: K.file_manifest(_files(s, d)), "SELECT ome, 'fna' AS type, '/d/' || ome || '.fna' AS path FROM {omes} WHERE source = 'jgi' UNION ALL SELECT ome, 'faa', '/d/' || ome || '.faa' FROM {omes} WHERE published <> '' UNION ALL SELECT ome, 'gff3', '/d/' || ome || '.gff3' FROM {omes}"),
    "f14_split_organism": (
        lambda s, d: domain(s, d, "omes").select("ome", C.split_organism(F.concat_ws(" ", "genus", "species", "strain", F.lit("b"), F.concat(F.lit("v2."), F.col("version").substr(8, 1)))).alias("x")).select("ome", "x.*"),
        "SELECT ome, genus, species, strain || 'b' AS strain, '2.' || substr(version, 8, 1) AS version FROM {omes}",
    ),
    "f15_norm_version": (lambda s, d: domain(s, d, "listing").select("o", C.norm_version(F.concat("modified", F.lit(" 00:00:00"))).alias("v")), "SELECT o, coalesce(TRY_CAST(replace(regexp_replace(modified || ' 00:00:00', ' 00:00:00$', ''), '-', '') AS DOUBLE), 0.0) AS v FROM {listing}"),
    "f18_rename_codes": (
        lambda s, d: K.rename_codes(domain(s, d, "genes").select(F.concat_ws("|", "alias", "ome").alias("id"), F.expr("'(' || ome || ':1,' || alias || '.2:x' || ome || '7,xxabcdef99)'").alias("value")), domain(s, d, "omes").select("ome", F.concat_ws("_", "genus", "species").alias("name"))),
        "SELECT g.alias || '|' || g.ome AS id, '(' || o.genus || '_' || o.species || ':1,' || o.genus || '_' || o.species || substr(g.alias, length(g.ome) + 1) || '.2:x' || coalesce(p.genus || '_' || p.species, g.ome || '7') || ',xxabcdef99)' AS value FROM {genes} g JOIN {omes} o ON o.ome = g.ome LEFT JOIN {omes} p ON p.ome = g.ome || '7'",
    ),
}
QUERIES = {name: job for name, (job, _) in JOBS.items()}
ORACLES = {name: oracle(sql) for name, (_, sql) in JOBS.items()}
