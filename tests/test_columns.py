from __future__ import annotations

from pyspark.sql import functions as F

from genomeloom.functions import columns as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_attributes(spark):
    text = "ID=a;Parent=b;Alias=o_1|o_2;product=x y"
    assert one(spark, text, lambda c: C.gff3_attr(c, "Alias")) == "o_1|o_2"
    assert one(spark, text, lambda c: C.gff3_attr(c, "product")) == "x y"
    assert one(spark, text, lambda c: C.gff3_attr(c, "rent")) is None
    assert one(spark, 'gene_id "g"; transcript_id "t"', lambda c: C.gtf_attr(c, "transcript_id")) == "t"
    assert one(spark, 'name "n"; proteinId 7', lambda c: C.gff2_attr(c, "proteinId")) == "7"
    assert one(spark, "ID=a;OG=1", lambda c: C.set_attr(c, "OG", F.lit("2"))) == "ID=a;OG=2"
    assert [one(spark, t, C.gff_dialect) for t in ("ID=a", 'gene_id "g"', 'name "n"', "x")] == [3.0, 2.5, 2.0, None]


def test_sequences(spark):
    assert one(spark, "ACGTNacgRY", C.reverse_complement) == "RYcgtNACGT"
    assert one(spark, "ATGGCCNNNTAAG", C.translate_dna) == "MAX*"
    assert one(spark, "", C.translate_dna) == ""
    assert one(spark, "ACGTAC", C.codon_frames)[2] == ["CGT"]
    assert one(spark, "GGCCaatt", C.gc_percent) == "50.00%"
    assert one(spark, "ACgt-N", C.base_counts).asDict() == {"acgt": 4, "gc": 2, "masked": 2}
    assert abs(one(spark, "GA*", C.protein_mass) - (75.1 + 89.1 - 18.01)) < 1e-9
    assert one(spark, "G1", C.protein_mass) is None
    assert one(spark, "ACGTA", lambda c: C.truncate_seq(c, 5)) == "ACGT"


def test_names(spark):
    assert one(spark, "abcdef1_99", C.ome_of) == "abcdef1"
    assert one(spark, "Genus species str 1 v2.0", C.split_organism).asDict() == {"genus": "Genus", "species": "species", "strain": "str1", "version": "2.0"}
    assert one(spark, "Genus", C.split_organism)["species"] == "sp."
    assert [one(spark, v, C.norm_version) for v in ("2015-09-16 00:00:00", "v1.5", "x")] == [20150916.0, 1.5, 0.0]
    assert one(spark, "GCA_1.2", C.acc_alternate) == "GCF_1.2"
    assert one(spark, "Z:3|P:2|K:1", lambda c: C.format_og_tags(C.parse_og_tags(c))) == "K:1|P:2|Z:3"
    assert abs(one(spark, "((a:1,b:1)90:1,(c:1,d:1)70:1);", C.tree_mean_support) - 0.8) < 1e-9
    assert one(spark, "((a:1,b:1)90:1,c:1);", C.strip_support) == "((a:1,b:1):1,c:1);"
    assert one(spark, "0.000012", lambda c: C.fmt_float(c.cast("double"))) == "0.000012"
