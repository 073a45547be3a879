"""Column expressions on accessions, annotation attributes, sequences and names."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC complement, average residue masses, rank and tag orders.
COMPLEMENT = ("ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn")
MASS = {"A": 89.1, "R": 174.2, "N": 132.1, "D": 133.1, "C": 121.2, "E": 147.1, "Q": 146.2, "G": 75.1, "H": 155.2, "I": 131.2, "L": 131.2, "K": 146.2, "M": 149.2, "F": 165.2, "P": 115.1, "S": 105.1, "T": 119.1, "W": 204.2, "Y": 181.2, "V": 117.1}
WATER = 18.01
RANKS = ("clade", "kingdom", "phylum", "subphylum", "class", "order", "family", "subfamily")
OG_TAGS = ("K", "P", "U", "C", "O", "F", "G", "S")
FORBIDDEN = "/\\[]|+=(){}:;<>?&*^%@#$~"
#: Amino acids of the standard code, codons counted up in the order T, C, A, G.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    return dict(zip(map("".join, product("TCAG", repeat=3)), STANDARD_CODE, strict=True))


def _empty_null(c: Column) -> Column:
    return F.when(c != "", c)


def ome_of(acc: Column) -> Column:
    """Genome of an accession: the text before its first underscore."""
    return F.substring_index(acc, "_", 1)


def gff3_attr(attributes: Column, name: str) -> Column:
    """Value of ``name=..;`` (null if absent or empty); a name inside another one doesn't count."""
    return _empty_null(F.regexp_extract(attributes, rf"(?:^|;)\s*{name}=([^;]*)", 1))


def gtf_attr(attributes: Column, name: str) -> Column:
    """Value of ``name "..";`` or ``name ..;``."""
    return _empty_null(F.regexp_extract(attributes, rf'(?:^|;)\s*{name} "?([^";]*)', 1))


gff2_attr = gtf_attr


def gff_dialect(attributes: Column) -> Column:
    """3 (key=value), 2.5 (gene_id ".."), 2 (name "..") or null."""
    return F.when(attributes.rlike(r"(?:^|;)\s*ID=[^;]"), 3.0).when(attributes.rlike(r'gene_id "'), 2.5).when(attributes.rlike(r'name "'), 2.0)


def set_attr(attributes: Column, name: str, value: Column) -> Column:
    """Replace the attribute or add it at the end."""
    rest = F.regexp_replace(attributes, rf"(^|;){name}=[^;]*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "^;+", ""), ";+$", "")
    return F.concat_ws(";", _empty_null(rest), F.concat(F.lit(f"{name}="), value))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, *COMPLEMENT))


def _triples(sequence: Column) -> Column:
    """Whole codons of a sequence, in one pass over it."""
    return F.regexp_extract_all(sequence, F.lit("(?s)..."), F.lit(0))


def translate_dna(sequence: Column) -> Column:
    """Protein of a coding sequence: stop is ``*``, a codon with an ambiguous base ``X``, an incomplete last codon is dropped."""
    letters = F.array(*[F.lit(x) for x in STANDARD_CODE])
    at = lambda codon, k: F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) - 1

    def residue(codon: Column) -> Column:
        a, b, c = (at(codon, k) for k in (1, 2, 3))
        return F.when(F.least(a, b, c) < 0, "X").otherwise(F.get(letters, 16 * a + 4 * b + c))

    return F.array_join(F.transform(_triples(F.translate(sequence, "acgtuU", "ACGTTT")), residue), "")


def codon_frames(sequence: Column) -> Column:
    """Frame (1..3, -1..-3) to its list of codons."""
    back = reverse_complement(sequence)
    frame = lambda s, k: _triples(F.substring(s, k + 1, 2**31 - 1))
    pairs = [x for k in range(3) for x in (F.lit(k + 1), frame(sequence, k))] + [x for k in range(3) for x in (F.lit(-k - 1), frame(back, k))]
    return F.create_map(*pairs)


def count_of(sequence: Column, letters: str) -> Column:
    """How many characters are among ``letters``."""
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def _hundredths(x: Column) -> Column:
    """``x`` (0 to 2**20) in whole hundredths as C prints it: rounded by the double's exact value, ties to even."""
    low = F.floor(x * 100)
    # x * 200 - (2 low + 1) in two parts that are exact, so that its sign is right
    head = F.floor(x * 2**20) / float(2**20)
    over = (head * 200 - (2 * low + 1)) + (x - head) * 200
    return low + F.when(over > 0, 1).when(over < 0, 0).otherwise(low % 2)


def gc_percent(sequence: Column) -> Column:
    """Capital G and C of the whole length as ``xx.xx%``."""
    n = _hundredths(100.0 * count_of(sequence, "GC") / F.length(sequence))
    return F.when(F.length(sequence) > 0, F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("%")))


def base_counts(sequence: Column) -> Column:
    """Bases, G and C (either case), and masked (lower-case) bases."""
    return F.struct(count_of(sequence, "acgtACGT").cast("long").alias("acgt"), count_of(sequence, "gcGC").cast("long").alias("gc"), count_of(sequence, "acgt").cast("long").alias("masked"))


def protein_mass(protein: Column) -> Column:
    """Mass of the linear chain; ``*`` weighs nothing, ``X`` the mean; an unknown letter gives null."""
    weights = MASS | {"X": sum(MASS.values()) / len(MASS)}
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    letters = F.filter(F.split(F.translate(F.upper(protein), "*", ""), ""), lambda x: x != "")
    total = F.aggregate(letters, F.lit(0.0), lambda a, x: a + F.try_element_at(known, x))
    return F.when(F.size(letters) > 0, total - WATER * (F.size(letters) - 1)).when(protein.isNotNull(), F.lit(0.0))


def truncate_seq(sequence: Column, n: int) -> Column:
    """Sequences of n or more letters are cut to n - 1."""
    return F.when(F.length(sequence) >= n, F.substring(sequence, 1, n - 1)).otherwise(sequence)


def clean_name(name: Column, strict: bool = False) -> Column:
    """Only word characters; ``strict``: only letters and digits."""
    return F.regexp_replace(name, "[^A-Za-z0-9]" if strict else "[^A-Za-z0-9_]", "")


def split_organism(name: Column) -> Column:
    """genus, species (``sp.`` if there is none), strain (the rest joined) and a trailing vN.N as version."""
    version = F.regexp_extract(name, r"\s[vV](\d+\.\d+)\s*$", 1)
    words = F.filter(F.split(F.regexp_replace(name, r"\s[vV]\d+\.\d+\s*$", ""), r"\s+"), lambda w: w != "")
    return F.struct(F.get(words, F.lit(0)).alias("genus"), F.coalesce(F.get(words, F.lit(1)), F.lit("sp.")).alias("species"), F.array_join(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))), "").alias("strain"), _empty_null(version).alias("version"))


def norm_version(version: Column) -> Column:
    """Date forms and vN.N as one number; 0 for anything else."""
    plain = F.regexp_replace(F.regexp_replace(version, r" 00:00:00$|[vV]", ""), "-", "")
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def acc_base(acc: Column) -> Column:
    return F.substring_index(acc, ".", 1)


def acc_version(acc: Column) -> Column:
    """The number after the last dot; 0 if there is none."""
    return F.coalesce(F.regexp_extract(acc, r"\.(\d+)$", 1).try_cast("int"), F.lit(0))


def acc_alternate(acc: Column) -> Column:
    """The same assembly in the other archive."""
    return F.when(acc.startswith("GCA_"), F.regexp_replace(acc, "^GCA_", "GCF_")).when(acc.startswith("GCF_"), F.regexp_replace(acc, "^GCF_", "GCA_"))


def display_name(genus: Column | None = None, species: Column | None = None, strain: Column | None = None, acc: Column | None = None, ome: Column | None = None, rank: Column | None = None) -> Column:
    """The asked parts, each followed by an underscore but the rank, which ends the name; an empty species is ``sp.``, an empty strain is left out, forbidden characters go."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    parts = [
        *([F.concat(blank(genus), F.lit("_"))] if genus is not None else []),
        *([F.concat(F.when(blank(species) == "", "sp.").otherwise(species), F.lit("_"))] if species is not None else []),
        *([F.when(blank(strain) == "", "").otherwise(F.concat(strain, F.lit("_")))] if strain is not None else []),
        *([F.concat(blank(c), F.lit("_")) for c in (acc, ome) if c is not None]),
        *([blank(rank)] if rank is not None else []),
    ]
    return F.translate(F.concat(*parts), FORBIDDEN, "")


def parse_og_tags(tags: Column) -> Column:
    return F.str_to_map(tags, F.lit(r"\|"), F.lit(":"))


def format_og_tags(tags: Column) -> Column:
    """``K:1|P:2`` in the fixed order of tags, others after them by name."""
    order = F.array(*[F.lit(t) for t in OG_TAGS])
    others = F.array_sort(F.filter(F.map_keys(tags), lambda k: ~F.array_contains(order, k)))
    named = F.concat(F.filter(order, lambda k: F.array_contains(F.map_keys(tags), k)), others)
    return F.array_join(F.transform(named, lambda k: F.concat(k, F.lit(":"), F.element_at(tags, k))), "|")


def tree_mean_support(newick: Column) -> Column:
    """Mean of the inner nodes' support values, as shares; divided by 100 if any is above 1."""
    values = F.transform(F.regexp_extract_all(newick, F.lit(r"\)(\d+\.?\d*):"), F.lit(1)), lambda x: x.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.when(F.size(values) > 0, F.when(F.exists(values, lambda x: x > 1), mean / 100).otherwise(mean))


def strip_support(newick: Column) -> Column:
    return F.regexp_replace(newick, r"\)\d+\.?\d*:", "):")


def jaccard(both: Column, n0: Column, n1: Column) -> Column:
    return both / (n0 + n1 - both)


def sorensen(both: Column, n0: Column, n1: Column) -> Column:
    return 2 * both / (n0 + n1)


def overlap(both: Column, n0: Column, n1: Column) -> Column:
    return both / F.least(n0, n1)


def fmt_float(x: Column) -> Column:
    """Plain decimal text without an exponent or trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
