from __future__ import annotations

import gzip

import pytest

from genomeloom.sources import formats as S


def test_catalog_round_trip(spark, tmp_path):
    (tmp_path / "c.mtdb").write_text("#ome\tgenus\nabcdef1\tGenus\tsp.\t\t{'phylum': 'P', 'class': ''}\t20140811\tjgi\tb\tAc1\t20210414\t2013/06/27\nabcdef2.1\tOther\tx\ts\t{}\t1.0\tncbi\t\tGCA_1.1\tNone\t\t\t\t\n")
    rows = S.read_catalog(spark, str(tmp_path / "c.mtdb"), "/d")
    got = {r["ome"]: r for r in rows.collect()}
    assert got["abcdef1"]["taxonomy"]["phylum"] == "P" and got["abcdef1"]["taxonomy"]["order"] == "" and got["abcdef1"]["taxonomy"]["species"] == "Genus sp."
    assert got["abcdef1"]["fna"] == "/d/abcdef1.fna"
    S.write_catalog(rows, str(tmp_path / "out"), headers=True, data_dir="/d")
    again = S.read_catalog(spark, str(tmp_path / "out"), "/d")
    lines = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert [x.split("\t")[0] for x in lines] == ["#ome", "abcdef1", "abcdef2.1"]
    assert {r["ome"]: r.asDict() for r in again.collect()} == {k: r.asDict() for k, r in got.items()}


def test_latest_catalog(spark, tmp_path):
    for day in ("20200101", "20210101"):
        (tmp_path / f"{day}.mtdb").write_text("x")
    assert S.latest_catalog(spark, str(tmp_path)).endswith("20210101.mtdb")


def test_fasta(spark, tmp_path):
    (tmp_path / "g1.fa").write_text("#top\n>a one two\nACgt\n#note\nNN\n>b\nTT\n>a\nGG\n")
    rows = {r["seqid"]: r for r in S.read_fasta(spark, str(tmp_path / "g1.fa")).collect()}
    assert rows["a"]["sequence"] == "GG" and rows["b"]["sequence"] == "TT" and rows["a"]["ome"] == "g1" and len(rows) == 2
    S.write_fasta(S.read_fasta(spark, str(tmp_path / "g1.fa")), str(tmp_path / "out"), by="ome")
    assert {r["sequence"] for r in S.read_fasta(spark, str(tmp_path / "out")).collect()} == {"GG", "TT"}


def test_gff(spark, tmp_path):
    good = "c1\tx\tgene\t1\t9\t.\t+\t.\tID=a\n"
    (tmp_path / "g.gff3").write_text("##gff-version 3\n" + good + "##FASTA\n>c1\nACGT\tA\n")
    rows = S.read_gff(spark, str(tmp_path / "g.gff3")).collect()
    assert [(r["ome"], r["start"], r["attributes"]) for r in rows] == [("g", 1, "ID=a")]
    (tmp_path / "bad.gff3").write_text(good + "c1\tx\tgene\t1\n")
    assert S.read_gff(spark, str(tmp_path / "bad.gff3"), "drop").count() == 1
    with pytest.raises(Exception, match="malformed"):
        S.read_gff(spark, str(tmp_path / "bad.gff3")).collect()
    S.write_gff(S.read_gff(spark, str(tmp_path / "g.gff3")), str(tmp_path / "out"))
    assert S.read_gff(spark, str(tmp_path / "out" / "ome=g")).count() == 1


def test_fastq(spark, tmp_path):
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@r1 d\nACG\nT\n+\n@II\nI\n@r2\nA\n+\nI\n")
    rows = {r["read_id"]: r for r in S.read_fastq(spark, str(tmp_path / "r.fq.gz")).collect()}
    assert rows["r1"]["sequence"] == "ACGT" and rows["r1"]["score"] == "@III" and rows["r2"]["score"] == "I"
    S.write_fastq(S.reads_by_id(S.read_fastq(spark, str(tmp_path / "r.fq.gz")), spark.createDataFrame([("r2",)], "read_id string")), str(tmp_path / "out"))
    assert [r["read_id"] for r in S.read_fastq(spark, str(tmp_path / "out")).collect()] == ["r2"]


def _cut(spark, path, size):
    """Reads of a file that Spark cuts every ``size`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return sorted(tuple(r) for r in S.read_fastq(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fastq_cut_anywhere(spark, tmp_path):
    """Quality lines that begin with @ and +, several lines a read, an empty read, a last one cut short."""
    (tmp_path / "r.fq").write_text("@r1 d e\nACG\nTAC\n+r1\n@II\n+II\n@r2\nAC\n+\n@r\n@r3\nGGGG\n+\n+@@+\n@r4\n\n+\n\n@r5\nTT\n+\nII\n@r6\nAC\n")
    want = [("r1", "d e", "ACGTAC", "@II+II"), ("r2", "", "AC", "@r"), ("r3", "", "GGGG", "+@@+"), ("r4", "", "", ""), ("r5", "", "TT", "II")]
    for size in (7, 29, 61):
        assert _cut(spark, tmp_path / "r.fq", size) == want, size


def test_fastq_cuts_in_memory():
    """Every cut between lines, and between any two of them: where the ends meet in whole records, these are the file's; else it is named."""
    from genomeloom.sources import fastq

    text = "@a\nAC\n+\n@I\n@b\nACGT\n+\n@+II\n@c\nA\nC\n+\n@\n+\n@d\nAAA\n+\nIII"
    lines = text.split("\n")
    top = fastq._Block(True)
    want = top.add(lines) + top.finish()
    for i in range(1, len(lines)):
        for j in range(i, len(lines)):
            got, ends = [], []
            for k, part in enumerate((lines[:i], lines[i:j], lines[j:])):
                if part:
                    block = fastq._Block(k == 0)
                    got += block.add(part) + block.finish()
                    ends.append(block.ends())
            groups, now = [], None
            for started, bad, head, tail in ends:
                assert not bad
                if now is not None:
                    now += head
                if started:
                    now = list(tail)
                    groups.append(now)
            for group in groups:
                block = fastq._Block(True)
                got += block.add(group) + block.finish()
                assert not block.bad
            assert sorted(got) == sorted(want)


def test_fastq_of_doubt_is_read_from_the_top(spark, tmp_path):
    """Scores that read as records of their own wherever the file is cut among them; a score too long is an error."""
    score = ["@x", "ACG", "+", "III", "@y", "ACG", "+", "III"]
    body = "@r1\n" + "A" * sum(map(len, score)) + "\n+\n" + "\n".join(score) + "\n@r2\nAC\n+\nII\n"
    (tmp_path / "d.fq").write_text(body)
    for size in (11, 40):
        assert [(r[0], r[3]) for r in _cut(spark, tmp_path / "d.fq", size)] == [("r1", "".join(score)), ("r2", "II")], size
    (tmp_path / "bad.fq").write_text("@r1\nAC\n+\nIII\n")
    with pytest.raises(Exception, match="score longer"):
        S.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_tables(spark, tmp_path):
    (tmp_path / "q7.tsv").write_text("x\tome1_1\t90\t95\t1\t9\t1e-5\t50\n")
    row = S.read_hits(spark, str(tmp_path / "q7.tsv"), convert=True).first()
    assert (row["qseqid"], row["ome"], row["evalue"]) == ("q7", "ome1", 1e-5)
    (tmp_path / "og.txt").write_text("OG0000012: a_1 b_2\n")
    assert [(r["hg"], r["gene"], r["ome"]) for r in S.read_orthogroups(spark, str(tmp_path / "og.txt")).collect()] == [(12, "a_1", "a"), (12, "b_2", "b")]
    (tmp_path / "p.hmm").write_text("HMMER3\nNAME  one\nACC   PF1\n//\nHMMER3\nNAME  two\n//\n")
    assert [(r["name"], r["acc"]) for r in S.read_hmm_profiles(spark, str(tmp_path / "p.hmm")).collect()] == [("one", "PF1"), ("two", "")]
    (tmp_path / "r.jsonl").write_text('{"accession":"GCA_1.1","organism":{"organismName":"Ge-nus spec. x","infraspecificNames":{"isolate":"i 1"}}}\n')
    got = S.read_assembly_report(spark, str(tmp_path / "r.jsonl")).first()
    assert (got["genus"], got["species"], got["strain"]) == ("Genus", "spec", "i1")
    (tmp_path / "pre.tsv").write_text("#assembly_accession\tgenus\tspecies\tassemblyPath\tgffPath\tsource\trestriction\nA1\tG\t\tx\ty\tjgi\tyes\nA2\tG\ts\tx\ty\tzzz\tno\n")
    ok, bad = S.read_predb(spark, str(tmp_path / "pre.tsv"))
    assert ok.first()["species"] == "sp." and bad.first()["reason"] == "source"


def test_hmmsearch(spark, tmp_path):
    text = """Query:       PF1  [M=50]
Scores for complete sequences (score includes all domains):
   --- full sequence ---   --- best 1 domain ---    -#dom-
    E-value  score  bias    E-value  score  bias    exp  N  Sequence Description
    ------- ------ -----    ------- ------ -----   ---- --  -------- -----------
    1e-20   70.1   0.1    2e-20   69.0   0.0    1.1  1  ome1_1   desc

Domain annotation for each sequence (and alignments):
>> ome1_1  desc
   #    score  bias  c-Evalue  i-Evalue hmmfrom  hmm to    alifrom  ali to    envfrom  env to     acc
 ---   ------ ----- --------- --------- ------- -------    ------- -------    ------- -------    ----
   1 !   69.0   0.0   1e-22   2e-20       2      49 ..      10      60 ..       9      61 .. 0.95

Internal pipeline statistics summary:
//
"""
    (tmp_path / "out.txt").write_text(text)
    hits, domains = S.read_hmmsearch(spark, str(tmp_path / "out.txt"))
    h, d = hits.first(), domains.first()
    assert (h["query"], h["model_len"], h["seq"], h["seq_e"], h["seq_score"], h["n"]) == ("PF1", 50, "ome1_1", 1e-20, 70.1, 1)
    assert (d["seq"], d["dom_num"], d["hmm_from"], d["hmm_to"], d["ali_to"], d["env_from"], d["acc"]) == ("ome1_1", 1, 2, 49, 60, 9, 0.95)


def test_phylip_and_ledger(spark, tmp_path):
    S.write_phylip(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "ome string, hg int"), "ome", "hg", str(tmp_path / "p"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*"))) == "2 2\na 10\nb 11\n"
    S.write_nexus_partitions(spark.createDataFrame([("f1", 1, 2), ("f2", 3, 5)], "file string, start long, end long"), str(tmp_path / "n"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "n").glob("part-*"))) == "#nexus\nbegin sets;\n    charset f1 = 1-2;\n    charset f2 = 3-5;\nend;\n"
    S.write_taxonomy(spark.createDataFrame([("B", {"order": "x"}), ("A", {"order": "y", "other": "z"})], "genus string, taxonomy map<string,string>"), str(tmp_path / "t"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "t").glob("part-*"))) == 'A\t{"order":"y"}\nB\t{"order":"x"}\n'
    old = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, v string")
    got = S.upsert_ledger(old, spark.createDataFrame([("y", "2")], "k string, v string"), "k")
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("x", "1"), ("y", "2")]
