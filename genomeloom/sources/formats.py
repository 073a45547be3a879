"""Readers and writers of the text formats of genome work.

Readers split files into records by Spark's own line separator, so a large file is read by
many tasks; only annotation files are read whole, for their tail section ends the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.functions.columns import RANKS, ome_of
from genomeloom.operators.presence import matrix_lines, number_members
from genomeloom.sources.fastq import read_fastq  # noqa: F401
from genomeloom.sources.shared import staged

# Columns of the tab-separated formats.
CATALOG = ("ome", "genus", "species", "strain", "taxonomy", "version", "source", "biosample", "assembly_acc", "acquisition_date", "published", "fna", "faa", "gff3")
HITS = "qseqid string, sseqid string, pident double, ppos double, sstart long, send long, evalue double, bitscore double"
GFF = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
EXTENSIONS = {"fna": "fna", "faa": "faa", "gff3": "gff3"}


def _file_stem() -> Column:
    """Name of the file a row was read from, without folder and extension."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))


def read_catalog(spark: SparkSession, path: str, data_dir: str | None = None) -> DataFrame:
    """Catalog rows: short rows are padded with "", taxonomy (JSON, either quote) has all default ranks and genus, species and strain; empty paths become ``data_dir``/ome.ext."""
    parts = F.split("value", "\t", -1)
    rows = _lines(spark, path).select(*(F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(CATALOG)))
    held = F.coalesce(F.from_json(F.regexp_replace("taxonomy", "'", '"'), "map<string,string>"), F.create_map().cast("map<string,string>"))
    default = F.create_map(*[F.lit(x) for r in RANKS for x in (r, "")])
    missing = F.map_filter(default, lambda k, _: ~F.array_contains(F.map_keys(held), k))
    own = F.create_map(F.lit("genus"), F.col("genus"), F.lit("species"), F.concat_ws(" ", "genus", "species"), F.lit("strain"), F.col("strain"))
    named = F.map_filter(held, lambda k, _: ~k.isin("genus", "species", "strain"))
    rows = rows.withColumn("taxonomy", F.map_concat(named, missing, own))
    for c, ext in EXTENSIONS.items() if data_dir else ():
        rows = rows.withColumn(c, F.when(F.col(c) == "", F.concat(F.lit(data_dir.rstrip("/") + "/"), "ome", F.lit("." + ext))).otherwise(F.col(c)))
    return rows


def write_catalog(catalog: DataFrame, path: str, headers: bool = False, data_dir: str | None = None) -> None:
    """Tab-separated rows in order of code as ordered part files, which joined by name are the file; taxonomy without genus, species and strain, default paths empty."""
    plain = catalog.withColumn("taxonomy", F.to_json(F.map_filter("taxonomy", lambda k, _: ~k.isin("genus", "species", "strain"))))
    for c, ext in EXTENSIONS.items() if data_dir else ():
        plain = plain.withColumn(c, F.when(F.col(c) == F.concat(F.lit(data_dir.rstrip("/") + "/"), "ome", F.lit("." + ext)), "").otherwise(F.col(c)))
    rows = plain.select(F.lit(1).alias("kind"), "ome", F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CATALOG)).alias("value"))
    if headers:
        head = catalog.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("ome"), F.lit("#" + "\t".join(CATALOG)).alias("value"))
        rows = head.unionByName(rows)
    write_ordered(rows, path, "kind", "ome")


def latest_catalog(spark: SparkSession, folder: str) -> str | None:
    """Path of the newest YYYYMMDD.mtdb file of ``folder``."""
    day = F.regexp_extract("path", r"/(\d{8})\.mtdb$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mtdb").load(folder).select("path")
    return files.where(day != "").agg(F.max_by("path", day)).first()[0]


def read_fasta(spark: SparkSession, path: str, ome: Column | None = None) -> DataFrame:
    """(ome, seqid, description, sequence): id up to the first space, lines joined, comment lines dropped; of repeated ids in a file the last stays."""
    records = spark.read.option("lineSep", "\n>").text(path).select((_file_stem() if ome is None else ome).alias("ome"), F.regexp_replace("value", "^>|\r", "").alias("value"), F.monotonically_increasing_id().alias("row"))
    lines = F.split("value", "\n")
    head = F.element_at(lines, 1)
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith("#"))
    rows = records.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("ome", "row", F.regexp_extract(head, r"^(\S*)", 1).alias("seqid"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.array_join(F.transform(body, lambda x: F.trim(x)), "").alias("sequence"))
    last = rows.groupBy("ome", "seqid").agg(F.max("row").alias("row"))
    return rows.join(last, ["ome", "seqid", "row"], "left_semi").select("ome", "seqid", "description", "sequence")


def write_fasta(rows: DataFrame, path: str, by: str | None = None, description: bool = True) -> None:
    head = F.concat_ws(" ", "seqid", F.when(F.col("description") != "", F.col("description"))) if description and "description" in rows.columns else F.col("seqid")
    out = rows.select(*([by] if by else []), F.concat(F.lit(">"), head, F.lit("\n"), F.col("sequence")).alias("value"))
    (out.write.partitionBy(by) if by else out.write).text(path)


def read_gff(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """Annotation rows with their place in the file (row). A row without nine fields or whole coordinates is an error, or goes with mode="drop"."""
    whole = spark.read.text(path, wholetext=True).select(_file_stem().alias("ome"), F.element_at(F.split("value", "(?:^|\n)##FASTA", 2), 1).alias("value"))
    rows = whole.select("ome", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", "\t", -1)
    good = (F.size(parts) == 9) & F.get(parts, F.lit(3)).rlike(r"^\d+$") & F.get(parts, F.lit(4)).rlike(r"^\d+$")
    rows = rows.where(good) if mode == "drop" else rows.withColumn("line", F.when(good, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("malformed annotation row: "), "line"))))
    return rows.select("ome", "row", *(F.get(parts, F.lit(k)).cast("long" if c in ("start", "end") else "string").alias(c) for k, c in enumerate(GFF)))


def write_gff(gff: DataFrame, path: str, by: str = "ome") -> None:
    """One folder a genome; every file starts with the version line."""
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in GFF))
    order = [c for c in ("seqid", "row", "start") if c in gff.columns]
    rows = gff.select(by, F.lit(1).alias("_h"), *order, line.alias("value"))
    head = gff.select(by).distinct().select(by, F.lit(0).alias("_h"), *(F.lit(None).cast(gff.schema[c].dataType).alias(c) for c in order), F.lit("##gff-version 3").alias("value"))
    head.unionByName(rows).repartition(by).sortWithinPartitions(by, "_h", *order).select(by, "value").write.partitionBy(by).text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    head = F.concat_ws(" ", "read_id", F.when(F.col("description") != "", F.col("description")))
    reads.select(F.concat(F.lit("@"), head, F.lit("\n"), "sequence", F.lit("\n+\n"), "score").alias("value")).write.text(path)


def reads_by_id(reads: DataFrame, ids: DataFrame) -> DataFrame:
    return reads.join(ids.select("read_id").distinct(), "read_id", "left_semi")


def read_hits(spark: SparkSession, path: str, fmt: str = "blast", convert: bool = False) -> DataFrame:
    """Search rows with the subject's genome; seven columns (fmt="mmseqs") have no ppos; ``convert`` names queries by their file."""
    schema = HITS if fmt == "blast" else HITS.replace("ppos double, ", "")
    rows = spark.read.csv(path, sep="\t", schema=schema)
    rows = rows.withColumn("qseqid", _file_stem()) if convert else rows
    rows = rows if fmt == "blast" else rows.withColumn("ppos", F.lit(None).cast("double"))
    return rows.select(*[f.split()[0] for f in HITS.split(", ")], ome_of(F.col("sseqid")).alias("ome"))


HMM_HITS = "query string, model_len long, seq string, seq_e double, seq_score double, seq_bias double, dom_e double, dom_score double, dom_bias double, exp double, n long"
HMM_DOMAINS = "query string, seq string, dom_num long, incl string, score double, bias double, c_evalue double, i_evalue double, hmm_from long, hmm_to long, ali_from long, ali_to long, env_from long, env_to long, acc double"


def read_hmmsearch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, domains) of text reports, one record a query."""
    report = spark.read.option("lineSep", "//\n").text(path).where(F.col("value").contains("Query:"))
    named = report.select(F.regexp_extract("value", r"Query:\s+(\S+)", 1).alias("query"), F.regexp_extract("value", r"\[M=(\d+)\]", 1).cast("long").alias("model_len"), "value")
    table = F.regexp_extract("value", r"(?s)E-value\s+score.*?-\n(.*?)(?:\n\s*\n|\Z)", 1)
    number = r"([0-9.eE+-]+)"
    row = r"(?m)^\s*" + r"\s+".join([number] * 7) + r"\s+(\d+)\s+(\S+).*$"
    line = F.explode(F.regexp_extract_all(table, F.lit(row), F.lit(0))).alias("line")
    cells = F.split(F.trim("line"), r"\s+")
    get = lambda k, t: F.get(cells, F.lit(k)).cast(t)
    hits = named.select("query", "model_len", line).select("query", "model_len", get(8, "string").alias("seq"), *(get(k, "double").alias(c) for k, c in enumerate(("seq_e", "seq_score", "seq_bias", "dom_e", "dom_score", "dom_bias", "exp"))), get(7, "long").alias("n"))
    block = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)>> (\S+).*?(?=>> |\Z|Internal pipeline)"), F.lit(0))).alias("block")
    blocks = named.select("query", block).select("query", F.regexp_extract("block", r">> (\S+)", 1).alias("seq"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^\s*\d+ [!?]\s.*$"), F.lit(0))).alias("line"))
    spans = ((6, "hmm_from"), (7, "hmm_to"), (9, "ali_from"), (10, "ali_to"), (12, "env_from"), (13, "env_to"))
    domains = blocks.select("query", "seq", get(0, "long").alias("dom_num"), get(1, "string").alias("incl"), get(2, "double").alias("score"), get(3, "double").alias("bias"), get(4, "double").alias("c_evalue"), get(5, "double").alias("i_evalue"), *(get(k, "long").alias(c) for k, c in spans), get(15, "double").alias("acc"))
    # field orders in the report: E, score, bias of the sequence, then score and E of the best domain are as printed
    return hits.select(*[f.split()[0] for f in HMM_HITS.split(", ")]), domains.select(*[f.split()[0] for f in HMM_DOMAINS.split(", ")])


def read_hmm_profiles(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(name, acc, profile) of a profile library, all or those of ``names`` (name)."""
    rows = spark.read.option("lineSep", "//\n").text(path).where(F.trim("value") != "")
    out = rows.select(F.regexp_extract("value", r"(?m)^NAME\s+(\S+)", 1).alias("name"), F.regexp_extract("value", r"(?m)^ACC\s+(\S+)", 1).alias("acc"), F.concat("value", F.lit("//\n")).alias("profile"))
    return out if names is None else out.join(names.select("name").distinct(), "name", "left_semi")


def read_cluster_pairs(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).alias("rep"), F.get(parts, F.lit(1)).alias("member"))


def read_orthogroups(spark: SparkSession, path: str) -> DataFrame:
    """(hg, gene, ome) of lines ``OG0000001: a_1 b_2``."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\D*\d+:"))
    genes = F.filter(F.split(F.regexp_replace("value", "^[^:]*:", ""), r"\s+"), lambda x: x != "")
    return rows.select(F.regexp_extract("value", r"^\D*(\d+):", 1).cast("long").alias("hg"), F.explode(genes).alias("gene")).withColumn("ome", ome_of(F.col("gene")))


PREDB = ("assembly_acc", "genus", "species", "strain", "version", "biosample", "assembly_path", "gff_path", "source", "restriction", "published", "previous_ome")
ALIASES = {"assembly_accession": "assembly_acc", "accession": "assembly_acc", "fna": "assembly_path", "assemblyPath": "assembly_path", "gff3": "gff_path", "gffPath": "gff_path", "genomeSource (ncbi/jgi/new)": "source", "useRestriction (yes/no)": "restriction", "ome": "previous_ome"}


def read_predb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with a reason) of a submission table; headers by any of their names, an empty species is ``sp.``."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    for c in raw.columns:
        bare = c.lstrip("#").strip()
        raw = raw.withColumnRenamed(c, ALIASES.get(bare, bare))
    lacking = [c for c in ("assembly_acc", "genus", "assembly_path", "gff_path", "source") if c not in raw.columns]
    if lacking:
        raise ValueError(f"missing headers: {', '.join(lacking)}")
    rows = raw.select(*((F.coalesce(F.trim(c), F.lit("")) if c in raw.columns else F.lit("")).alias(c) for c in PREDB)).withColumn("species", F.when(F.col("species") == "", "sp.").otherwise(F.col("species")))
    many = rows.groupBy("assembly_acc").agg(F.count("*").alias("_n"))
    reason = F.when(F.col("_n") > 1, "assembly_acc not unique").when(~F.lower("restriction").isin("", "yes", "no", "y", "n", "true", "false"), "restriction").when(~F.lower("source").isin("jgi", "ncbi", "new"), "source").when(F.col("genus") == "", "genus")
    marked = rows.join(many, "assembly_acc").withColumn("reason", reason).drop("_n")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


REPORT = "accession string, organism struct<organismName:string,infraspecificNames:struct<strain:string,isolate:string>>, assemblyInfo struct<assemblyName:string,submitter:string,biosample:struct<attributes:array<struct<name:string,value:string>>>>, annotationInfo struct<provider:string>"


def read_assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """Assembly metadata, one JSON object a line: names with other than letters and digits removed; strain, else isolate, else the biosample's."""
    rows = spark.read.schema(REPORT).json(path).where("accession IS NOT NULL")
    words = F.split("organism.organismName", r"\s+")
    own = F.get(F.filter("assemblyInfo.biosample.attributes", lambda a: F.lower(a["name"]) == "strain"), F.lit(0))["value"]
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")
    strain = F.coalesce("organism.infraspecificNames.strain", "organism.infraspecificNames.isolate", own)
    return rows.select(F.col("accession").alias("assembly_acc"), bare(F.get(words, F.lit(0))).alias("genus"), bare(F.get(words, F.lit(1))).alias("species"), bare(strain).alias("strain"), F.col("assemblyInfo.assemblyName").alias("assembly_name"), F.coalesce("assemblyInfo.submitter", "annotationInfo.provider").alias("submitter"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(genus, taxonomy) of a cache: genus, tab, JSON map."""
    parts = F.split("value", "\t", 2)
    return _lines(spark, path).select(F.get(parts, F.lit(0)).alias("genus"), F.from_json(F.get(parts, F.lit(1)), "map<string,string>").alias("taxonomy"))


def read_taxonomy_report(spark: SparkSession, path: str, rank: str, clade: str) -> DataFrame:
    """(genus, taxonomy) of the genera of one clade, from JSON lines that hold a classification by rank: {rank: {name}}."""
    classes = "struct<" + ",".join(f"`{r}`:struct<name:string>" for r in (*RANKS, "genus")) + ">"
    rows = spark.read.schema(f"taxonomy struct<classification:{classes}>").json(path).select("taxonomy.classification.*")
    own = F.create_map(*[x for r in RANKS for x in (F.lit(r), F.coalesce(F.col(f"`{r}`.name"), F.lit("")))])
    named = rows.select(F.col("genus.name").alias("genus"), own.alias("taxonomy")).where("genus IS NOT NULL")
    return named.where(F.lower(F.element_at("taxonomy", rank)) == clade.lower()).dropDuplicates(["genus"])


def write_taxonomy(tax: DataFrame, path: str) -> None:
    """Lines of ``read_taxonomy`` in order of genus, as ordered part files."""
    line = F.concat_ws("\t", "genus", F.to_json(F.map_filter("taxonomy", lambda k, _: k.isin(*RANKS))))
    write_ordered(tax.select("genus", line.alias("value")), path, "genus")


LEDGERS = {"failed": "code string, source string, version string, attempt_date string", "duplicates": "assembly_acc string, ome string, source string, reason string", "retired": "ome string", "pairs": "assembly_acc string, portal string", "organisms": "assembly_acc string, genus string, species string, strain string"}


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=LEDGERS[kind], comment="#")


def upsert_ledger(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` added or in place of those with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_phylip(pairs: DataFrame, row: str, col: str, path: str) -> None:
    """0/1 characters of a long (row, col) table as ordered part files: in the first a line of both numbers, then a line a row; columns in order. Parts joined by name are the file."""
    held = staged(pairs.select(row, col).where(F.col(row).isNotNull()).distinct(), "phylip")
    lines = matrix_lines(held, row, col, number_members(held, col))
    size = held.agg(F.countDistinct(row).alias("n"), F.countDistinct(col).alias("m"))
    head = size.select(F.lit(0).alias("kind"), F.lit("").alias("k"), F.concat_ws(" ", "n", "m").alias("value"))
    body = lines.select(F.lit(1).alias("kind"), F.col(row).cast("string").alias("k"), F.concat(F.col(row).cast("string"), F.lit(" "), F.col("line")).alias("value"))
    write_ordered(head.unionByName(body), path, "kind", "k")


def write_ordered(lines: DataFrame, path: str, *order: str) -> None:
    """``value`` of ``lines`` in order: part files hold ranges of it, so the parts joined in order of their names are one sorted file, and no task writes all."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def write_report(rows: DataFrame, path: str, key: str = "ome") -> None:
    """Tab-separated in order of the key, with a header whose first name follows a #, as ordered part files: the header begins the first."""
    cols = [key, *(c for c in rows.columns if c != key)]
    body = rows.select(F.lit(1).alias("kind"), F.col(key).alias("k"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).alias("value"))
    head = rows.sparkSession.createDataFrame([("\t".join(["#" + key, *cols[1:]]),)], "value string").select(F.lit(0).alias("kind"), F.lit(None).cast(rows.schema[key].dataType).alias("k"), "value")
    write_ordered(head.unionByName(body), path, "kind", "k")


def write_nexus_partitions(parts: DataFrame, path: str) -> None:
    """The text block that names the partitions (file, start, end) of a joined alignment, a line each, as ordered part files."""
    fixed = parts.sparkSession.createDataFrame([(0, 0, "#nexus"), (0, 1, "begin sets;"), (2, 0, "end;")], "kind int, k long, value string")
    named = parts.select(F.lit(1).alias("kind"), F.col("start").cast("long").alias("k"), F.format_string("    charset %s = %d-%d;", F.col("file").cast("string"), F.col("start").cast("long"), F.col("end").cast("long")).alias("value"))
    write_ordered(fixed.unionByName(named), path, "kind", "k")
