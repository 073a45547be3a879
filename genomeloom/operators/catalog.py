"""The genome catalog: selection, sampling, versions, redundancy, codes and merging.

Catalog rows have ome, genus, species, strain, taxonomy (map of rank to name), version,
source, biosample, assembly_acc, acquisition_date, published, fna, faa and gff3.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomeloom.sources.shared import staged
from genomeloom.functions.columns import acc_alternate, acc_base, acc_version, norm_version

#: Ranks that taxonomy maps do not keep.
DROPPED_RANKS = ("no rank", "subkingdom", "genus", "species", "species group", "varietas", "forma")


def extract_lineage(catalog: DataFrame, names: list[str]) -> DataFrame:
    """Genomes of any of the lineages, whatever their rank; case does not matter."""
    wanted = [n.lower() for n in names]
    return catalog.where(F.exists(F.map_values("taxonomy"), lambda x: F.lower(x).isin(wanted)))


def extract_ids(catalog: DataFrame, ids: DataFrame, column: str = "ome") -> DataFrame:
    return catalog.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def extract_source(catalog: DataFrame, source: str) -> DataFrame:
    return catalog.where(F.lower("source") == source.lower())


def extract_published(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.coalesce(F.col("published"), F.lit("")) != "")


def extract_inverse(catalog: DataFrame, kept: DataFrame) -> DataFrame:
    return catalog.join(kept.select("ome"), "ome", "left_anti")


def rank_value(rank: str) -> Column:
    return F.col(rank) if rank in ("genus", "species", "strain") else F.coalesce(F.try_element_at("taxonomy", F.lit(rank)), F.lit(""))


def sample_per_rank(catalog: DataFrame, rank: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` genomes of each value of ``rank``, chosen by a digest of their code and the seed."""
    best = W.partitionBy("_v").orderBy(F.md5(F.concat_ws(":", "ome", F.lit(str(seed)))), "ome")
    return catalog.withColumn("_v", rank_value(rank)).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n).drop("_v", "_k")


def split_by_rank(catalog: DataFrame, rank: str) -> DataFrame:
    """With a column ``part``: the value of ``rank``, or unclassified."""
    return catalog.withColumn("part", F.when(rank_value(rank) != "", rank_value(rank)).otherwise("unclassified"))


def extract(catalog: DataFrame, rank: str | None = None, n: int | None = None, seed: int = 0, lineages: list[str] | None = None, ids: DataFrame | None = None, source: str | None = None, published: bool = False, inverse: bool = False, by: str | None = None) -> DataFrame:
    """Sampling, then lineages or ids, source, publication, inversion and splitting, in this order."""
    kept = catalog if rank is None or n is None else sample_per_rank(catalog, rank, n, seed)
    if lineages:
        kept = extract_lineage(kept, lineages)
    elif ids is not None:
        kept = extract_ids(kept, ids)
    kept = extract_source(kept, source) if source else kept
    kept = extract_published(kept) if published else kept
    kept = extract_inverse(catalog, kept) if inverse else kept
    return split_by_rank(kept, by) if by else kept


def lookup(catalog: DataFrame, code: str) -> DataFrame:
    """The genome of ``code``, else the newest version of it; of equal versions the greatest code."""
    own = catalog.where((F.col("ome") == code) | F.col("ome").startswith(code + "."))
    order = [F.when(F.col("ome") == code, 0).otherwise(1), F.desc(acc_version(F.col("ome"))), F.desc("ome")]
    return own.orderBy(*order).limit(1)


def lookup_codes(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, and the catalog's columns): for each of ``codes`` (code) its genome, else the newest version of it; of equal versions the greatest code."""
    asked = codes.select("code").distinct()
    base = F.regexp_replace("ome", r"\.\d+$", "")
    rows = catalog.select(F.explode(F.array_distinct(F.array("ome", base))).alias("code"), "*").join(asked, "code")
    return latest_versions(rows, F.col("code"), (F.col("ome") == F.col("code")).cast("int"), acc_version(F.col("ome")), F.col("ome"))


def min_n50(catalog: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    return catalog.join(stats.where(F.col("n50") > n).select("ome"), "ome", "left_semi")


def publication_status(rows: DataFrame, allow_unpublished: bool = False) -> DataFrame:
    """``published``: the citation, else 1 for rows flagged published or public, else empty; unpublished rows go unless allowed."""
    flag = F.lower(F.coalesce(F.col("is_published").cast("string"), F.lit(""))).isin("true", "yes", "y", "1") | F.lower(F.coalesce(F.col("is_public").cast("string"), F.lit(""))).isin("true", "yes", "y", "1")
    out = rows.withColumn("published", F.coalesce(F.when(F.col("citation") != "", F.col("citation")), F.when(flag, F.lit("1")), F.lit("")))
    return out if allow_unpublished else out.where("published <> ''")


def clean_assembly_listing(rows: DataFrame, groups: list[str], organisms: DataFrame) -> DataFrame:
    """Listed assemblies of the groups with an archive accession, genes and proteins, and a genus."""
    given = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("-", "", "0")
    kept = rows.where(F.lower("grp").isin([g.lower() for g in groups]) & F.col("assembly_acc").rlike("^GC[AF]_") & given("genes") & given("proteins"))
    return kept.join(organisms.where("genus <> ''"), "assembly_acc")


def assimilate_taxonomy(catalog: DataFrame, tax: DataFrame) -> DataFrame:
    """Taxonomy by genus (tax: genus, taxonomy), without dropped ranks; an empty map where the genus is unknown."""
    known = tax.select("genus", F.map_filter("taxonomy", lambda k, _: ~k.isin(*DROPPED_RANKS)).alias("_t")).dropDuplicates(["genus"])
    return catalog.join(known, "genus", "left").withColumn("taxonomy", F.coalesce("_t", F.create_map().cast("map<string,string>"))).drop("_t").select(*catalog.columns)


def genera_needing_taxonomy(catalog: DataFrame, tax: DataFrame) -> DataFrame:
    bare = catalog.where(~F.exists(F.map_values("taxonomy"), lambda x: x != ""))
    return bare.select("genus").distinct().join(tax.select("genus"), "genus", "left_anti")


def constrain_lineages(rows: DataFrame, tax: DataFrame, constraints: DataFrame) -> DataFrame:
    """Rows whose genus is allowed, by itself (rank genus) or by a rank of its taxonomy; constraints: (rank, name)."""
    named = constraints.select(F.lower("rank").alias("rank"), F.lower("name").alias("name"))
    ranks = tax.select("genus", F.explode("taxonomy").alias("rank", "name")).select("genus", F.lower("rank").alias("rank"), F.lower("name").alias("name"))
    allowed = ranks.join(named, ["rank", "name"], "left_semi").select(F.lower("genus").alias("_g")).union(named.where("rank = 'genus'").select("name")).distinct()
    return rows.join(allowed, F.lower(rows["genus"]) == F.col("_g"), "left_semi")


def attach_organism(rows: DataFrame, organisms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their organism, other archive's accessions of the rest to try again)."""
    found = rows.join(organisms, "assembly_acc")
    rest = rows.join(organisms.select("assembly_acc"), "assembly_acc", "left_anti")
    return found, rest.select(F.coalesce(acc_alternate(F.col("assembly_acc")), F.col("assembly_acc")).alias("assembly_acc")).distinct()


def cross_source_overlap(ncbi: DataFrame, jgi: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows only one archive has, overlapping rows with the first rule that matches).

    Rules: a known pair; the assembly's name is the portal's code; the submitter is the
    portal's; the same genus, species and strain; the same genus and species without strain.
    """
    name = lambda *c: F.lower(F.concat_ws("_", *c))
    codes = jgi.select(F.col("portal")).distinct()
    full = jgi.select(name("genus", "species", "strain").alias("_full")).distinct()
    bare = jgi.select(name("genus", "species").alias("_bare")).distinct()
    rows = (
        ncbi.join(pairs.select("assembly_acc", F.lit(1).alias("_p")).dropDuplicates(["assembly_acc"]), "assembly_acc", "left")
        .join(codes.select(F.col("portal").alias("assembly_name"), F.lit(1).alias("_n")), "assembly_name", "left")
        .withColumn("_full", name("genus", "species", "strain"))
        .withColumn("_bare", name("genus", "species"))
        .join(full.withColumn("_f", F.lit(1)), "_full", "left")
        .join(bare.withColumn("_b", F.lit(1)), "_bare", "left")
    )
    no_strain = F.coalesce(F.col("strain"), F.lit("")) == ""
    rule = F.coalesce(F.when(F.col("_p") == 1, "pair"), F.when(F.col("_n") == 1, "name"), F.when(F.lower("submitter").contains("jgi") | F.lower("submitter").contains("joint genome"), "submitter"), F.when(F.col("_f") == 1, "strain"), F.when(no_strain & (F.col("_b") == 1), "species"))
    marked = rows.withColumn("rule", rule).select(*ncbi.columns, "rule")
    return marked.where("rule IS NULL").drop("rule"), marked.where("rule IS NOT NULL")


def overlap_tables(ncbi: DataFrame, jgi: DataFrame, pairs: DataFrame, unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unique) after ``cross_source_overlap``: the known ones, with the portal (and biosample) that each overlapping row met, and with the accessions that met none."""
    only, both = cross_source_overlap(ncbi, jgi, pairs)
    name = lambda *c: F.lower(F.concat_ws("_", *c))
    one = lambda key, alias: jgi.groupBy(key.alias(alias)).agg(F.min("portal").alias("portal"))
    rows = both.withColumn("_full", name("genus", "species", "strain")).withColumn("_bare", name("genus", "species"))
    rows = rows.join(pairs.groupBy("assembly_acc").agg(F.min("portal").alias("_p")), "assembly_acc", "left")
    rows = rows.join(one(name("genus", "species", "strain"), "_full").withColumnRenamed("portal", "_f"), "_full", "left").join(one(name("genus", "species"), "_bare").withColumnRenamed("portal", "_b"), "_bare", "left")
    portal = F.when(F.col("rule") == "pair", F.col("_p")).when(F.col("rule") == "name", F.col("assembly_name")).when(F.col("rule") == "strain", F.col("_f")).when(F.col("rule") == "species", F.col("_b"))
    carried = F.col("biosample") if "biosample" in ncbi.columns else F.lit(None).cast("string")
    found = rows.select("assembly_acc", portal.alias("portal"), carried.alias("biosample")).where("portal IS NOT NULL")
    return pairs.unionByName(found.join(pairs.select("assembly_acc"), "assembly_acc", "left_anti"), allowMissingColumns=True), unique.select("assembly_acc").union(only.select("assembly_acc")).distinct()


def rename_codes(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``lines`` (id, value) with genome codes of ``names`` (ome, name) replaced, a versioned code before its base, never a code that a digit follows.

    Names, a row a genome, go to every task. Lines are moved once, by id; codes are cut out of them, renamed and put back where they are.
    """
    pattern = r"[a-z.]{6}\d+(?:\.\d+)?"
    pieces = F.arrays_zip(F.split("value", pattern, -1).alias("gap"), F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("code"))
    cut = lines.repartition("id").select("id", F.posexplode(pieces).alias("at", "x")).select("id", "at", F.col("x.gap").alias("gap"), F.col("x.code").alias("code"), F.regexp_replace("x.code", r"\.\d+$", "").alias("base"))
    one = names.dropDuplicates(["ome"])
    met = cut.join(F.broadcast(one.select(F.col("ome").alias("code"), F.col("name").alias("n1"))), "code", "left").join(F.broadcast(one.select(F.col("ome").alias("base"), F.col("name").alias("n2"))), "base", "left")
    new = F.coalesce("n1", F.concat("n2", F.expr("substring(code, length(base) + 1)")), "code", F.lit(""))
    back = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("gap", new).alias("t")))), lambda x: x["t"]), "")
    return met.groupBy("id").agg(back.alias("value"))


def latest_versions(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row for each ``key``: the first when sorted falling by ``order``."""
    return rows.withColumn("_key", key).withColumn("_k", F.row_number().over(W.partitionBy("_key").orderBy(*[o.desc_nulls_last() for o in order]))).where("_k = 1").drop("_key", "_k")


def dereplicate_catalog(catalog: DataFrame) -> DataFrame:
    """Archive rows by accession base (highest version, then code), portal rows by accession (highest version, then code)."""
    archive = F.lower("source") == "ncbi"
    key = F.concat_ws("|", F.lower("source"), F.when(archive, acc_base(F.col("assembly_acc"))).otherwise(F.col("assembly_acc")))
    order = F.when(archive, acc_version(F.col("assembly_acc")).cast("double")).otherwise(norm_version(F.col("version")))
    return latest_versions(catalog, key, order, F.col("ome"))


def ncbi_redundancy(catalog: DataFrame, ncbi: DataFrame, dups: DataFrame) -> DataFrame:
    """New archive rows with their fate: add (unknown accession), update (newer than the catalog's), or drop; listed duplicates go."""
    held = latest_versions(catalog.where(F.lower("source") == "ncbi"), acc_base(F.col("assembly_acc")), acc_version(F.col("assembly_acc")), norm_version(F.col("version")))
    have = held.select(acc_base(F.col("assembly_acc")).alias("_base"), F.col("ome").alias("old_ome"), norm_version(F.col("version")).alias("_old"))
    new = ncbi.join(dups.select("assembly_acc"), "assembly_acc", "left_anti").withColumn("_base", acc_base(F.col("assembly_acc")))
    fate = F.when(F.col("old_ome").isNull(), "add").when(norm_version(F.col("version")) > F.col("_old"), "update").otherwise("drop")
    return new.join(have, "_base", "left").withColumn("fate", fate).drop("_base", "_old")


def jgi_redundancy(catalog: DataFrame, jgi: DataFrame, pairs: DataFrame, dups: DataFrame) -> DataFrame:
    """New portal rows with the catalog row they meet and why: portal (update if newer), a biosample that only one row has, a known pair; else new."""
    rows = jgi.join(dups.select("portal"), "portal", "left_anti")
    same = latest_versions(catalog.where(F.lower("source") == "jgi"), F.col("assembly_acc"), norm_version(F.col("version"))).select(F.col("assembly_acc").alias("portal"), F.col("ome").alias("_o1"), norm_version(F.col("version")).alias("_v"))
    sample = catalog.where("coalesce(biosample, '') <> ''").groupBy("biosample").agg(F.min("ome").alias("_o2"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    pair = pairs.join(catalog.select("assembly_acc", F.col("ome").alias("_o3")), "assembly_acc").groupBy("portal").agg(F.min("_o3").alias("_o3"))
    met = rows.join(same, "portal", "left").join(sample, "biosample", "left").join(pair, "portal", "left")
    newer = norm_version(F.col("version")) > F.col("_v")
    rule = F.when(F.col("_o1").isNotNull(), F.when(newer, "update").otherwise("known")).when(F.col("_o2").isNotNull(), "biosample").when(F.col("_o3").isNotNull(), "pair").otherwise("new")
    return met.select(*jgi.columns, F.coalesce("_o1", "_o2", "_o3").alias("old_ome"), rule.alias("rule"))


def skip_failed(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows (code, version) but those that failed at the same or a later version."""
    last = failed.groupBy("code").agg(F.max(norm_version(F.col("version"))).alias("_v"))
    return rows.join(last, "code", "left").where(F.col("_v").isNull() | (norm_version(F.col("version")) > F.col("_v"))).drop("_v")


def resume(todo: DataFrame, done: DataFrame, key: str = "ome") -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def restore_failed_overlap(kept: DataFrame, overlap: DataFrame, failed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``kept`` and the overlapping rows whose preferred portal failed."""
    lost = pairs.join(failed.select(F.col("code").alias("portal")), "portal", "left_semi").select("assembly_acc")
    return kept.unionByName(overlap.join(lost, "assembly_acc", "left_semi").select(*kept.columns))


# Characters that codes leave out, and those that a given code may not begin with.
LEFT_OUT = "()[]$#@ |+=%^&*'\"!~`,<>?;:\\{}"
CODE = r"^([^\d_,'\";:\\|\[\]{}=+!@#$%^&*()]{6})(\d+)(?:\.(\d+))?$"
#: Codes as they are made: a prefix of six characters, a number, perhaps a version.
MADE = r"^(.{6})(\d+)(?:\.(\d+))?$"


def _prefix(genus: Column, species: Column) -> Column:
    """Three characters of each name, in lower case, without those that codes leave out, filled up to six by dots; null without a name."""
    both = F.concat(F.lower(F.substring(genus, 1, 3)), F.lower(F.substring(species, 1, 3)))
    return F.rpad(F.translate(both, LEFT_OUT, ""), 6, ".")


def _coded(new: DataFrame, catalog: DataFrame, retired: DataFrame) -> DataFrame:
    """``new`` with ome (null if it failed) and failure."""
    part = lambda k, c="ome", pattern=MADE: F.regexp_extract(c, pattern, k)
    base = lambda c: F.concat(part(1, c), part(2, c))
    used = catalog.select("ome").union(retired.select("ome")).where(part(1) != "")
    versions = used.groupBy(base("ome").alias("_base")).agg(F.max(F.coalesce(part(3).try_cast("int"), F.lit(0))).alias("_ver"))
    known = catalog.where(part(1) != "").groupBy("assembly_acc").agg(F.max(base("ome")).alias("_acc_base"))
    given = F.when(F.coalesce(F.col("ome"), F.lit("")) != "", F.col("ome")) if "ome" in new.columns else F.lit(None).cast("string")
    rows = new.withColumn("_given", given).drop("ome").withColumn("_prefix", _prefix(F.col("genus"), F.col("species"))).join(known, "assembly_acc", "left")
    rows = rows.withColumn("_base", F.coalesce(F.when(F.col("_given").isNotNull(), base("_given")), "_acc_base")).join(versions, "_base", "left")
    bad = F.col("_given").isNotNull() & ~F.col("_given").rlike(CODE)
    kind = F.when(bad, "malformed").when(F.col("_ver").isNotNull(), "next").when(F.col("_given").isNotNull(), "given").when(F.col("_prefix").isNull(), "no name").otherwise("new")
    rows = staged(rows.withColumn("_kind", kind), "codes")
    # numbers go on from all codes in use and from those that rows give
    taken = used.unionByName(rows.where("_kind = 'given'").select(F.col("_given").alias("ome")))
    top = taken.groupBy(part(1).alias("_prefix")).agg(F.max(part(2).cast("int")).alias("_top"))
    # of rows for one base or number the order is by accession; a code that two rows give is the first one's
    group = F.when(F.col("_kind") == "next", F.col("_base")).when(F.col("_kind") == "given", F.col("_given")).otherwise(F.col("_prefix"))
    nth = F.row_number().over(W.partitionBy("_kind", group).orderBy("assembly_acc"))
    rows = rows.withColumn("_nth", nth).join(top, "_prefix", "left")
    twice = (F.col("_kind") == "given") & (F.col("_nth") > 1)
    code = F.when(F.col("_kind") == "next", F.concat("_base", F.lit("."), (F.col("_ver") + F.col("_nth")).cast("string"))).when((F.col("_kind") == "given") & ~twice, F.col("_given"))
    code = code.when(F.col("_kind") == "new", F.concat("_prefix", (F.coalesce(F.col("_top"), F.lit(0)) + F.col("_nth")).cast("string")))
    failure = F.when(F.col("_kind").isin("malformed", "no name"), F.col("_kind")).when(twice, "given twice")
    return rows.withColumn("ome", code).withColumn("failure", failure)


def failed_codes(new: DataFrame, catalog: DataFrame, retired: DataFrame) -> DataFrame:
    """(assembly_acc, failure) of the rows that ``generate_codes`` leaves out: malformed, given twice or no name."""
    return _coded(new, catalog, retired).where("failure IS NOT NULL").select("assembly_acc", "failure")


def generate_codes(new: DataFrame, catalog: DataFrame, retired: DataFrame) -> DataFrame:
    """``new`` with ome: three letters of genus and species and the next number of that prefix, counted on from catalog, retired and given codes.

    A known assembly_acc gets the next version of its code, and so does a code that the row gives (ome) and that
    is in use; rows for the same code get one version after the other. A given code that nothing uses stays. Rows of a
    prefix are numbered by assembly_acc. Rows that get no code are left out; ``failed_codes`` names them.
    """
    return _coded(new, catalog, retired).where("failure IS NULL").select(*[c for c in new.columns if c != "ome"], "ome")


def merge_catalog(orig: DataFrame, add: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(catalog, code map): rows of a held assembly_acc replace it or are skipped; codes in use by others are made anew."""
    held = orig.select("assembly_acc")
    kept = orig.join(add.select("assembly_acc"), "assembly_acc", "left_anti") if overwrite else orig
    new = add if overwrite else add.join(held, "assembly_acc", "left_anti")
    clash = new.join(kept.select("ome"), "ome", "left_semi")
    # numbers go on from all codes of both sides; what clashes is new to the catalog, so no accession is known
    taken = kept.select("ome").union(new.select("ome"))
    recoded = generate_codes(clash.withColumnRenamed("ome", "_was"), kept.select("ome", "assembly_acc"), taken)
    codes = recoded.select(F.col("_was").alias("old"), F.col("ome").alias("new"))
    free = new.join(kept.select("ome"), "ome", "left_anti")
    return reduce(DataFrame.unionByName, [kept.select(*orig.columns), free.select(*orig.columns), recoded.select(*orig.columns)]), codes


def promote(ref: DataFrame, add: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, replaced rows): a new version of a base code takes the place of the old one; a code that ``add`` gives twice is an error."""
    if twice := add.groupBy("ome").agg(F.count("*").alias("n")).where("n > 1").head(1):
        raise ValueError(f"code {twice[0]['ome']} is not unique")
    base = lambda c: F.regexp_replace(c, r"\.\d+$", "")
    new = add.select(base(F.col("ome")).alias("_base")).distinct()
    marked = ref.withColumn("_base", base(F.col("ome")))
    return marked.join(new, "_base", "left_anti").drop("_base").unionByName(add.select(*ref.columns)), marked.join(new, "_base", "left_semi").drop("_base")


def union_catalogs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def catalog_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Codes of ``a`` that ``b`` lacks."""
    return a.select("ome").subtract(b.select("ome"))


def shared_codes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ome").intersect(b.select("ome"))


def file_manifest(catalog: DataFrame, types: tuple[str, ...] = ("fna", "faa", "gff3")) -> DataFrame:
    """(ome, type, path), a row for each file."""
    return catalog.unpivot("ome", list(types), "type", "path").where("coalesce(path, '') <> ''")


def file_completeness(catalog: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(ome, lacking): required types that a genome of the catalog has no file of, comma-joined; empty if complete."""
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(t), F.lit("")) == "", F.lit(t)) for t in required]))
    return catalog.select("ome", F.array_join(lacking, ",").alias("lacking"))


def stale_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(catalog.select("ome"), "ome", "left_anti")
