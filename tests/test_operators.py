from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from genomeloom.operators import catalog as K
from genomeloom.operators import curate as Q
from genomeloom.operators import features as X
from genomeloom.operators import graph as G
from genomeloom.operators import groups as A
from genomeloom.operators import hits as H
from genomeloom.operators import phylo as T
from genomeloom.operators import sequences as S
from genomeloom.operators.components import connected_components

GFF = "ome string, row int, seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def gff(spark, *rows):
    return spark.createDataFrame([("o", k, "c", "x", t, s, e, ".", strand, ".", a) for k, (t, s, e, strand, a) in enumerate(rows)], GFF)


def test_median_is_the_even_rounded_element(spark):
    rows = gff(spark, *(("gene", 1, 1 + n, "+", f"ID=g{n}") for n in (5, 1, 9, 3, 7)))
    r = X.annotation_stats(rows).first()
    assert (r["gene_total"], r["gene_n"], r["gene_median"], r["cds_n"]) == (25, 5, 3, None)
    assert X.annotation_stats(rows.limit(1)).first()["gene_median"] == 5


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """A chain that one task holds is written once; contracted in tasks of few edges, or with texts as nodes, it gives the same."""
    from genomeloom.operators import components

    written, plain = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or plain(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(400 + i, 401) for i in range(9)], "src long, dst int").coalesce(1)
    found = lambda edges: {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = {i: 0 for i in range(301)} | {400 + i: 400 for i in range(9)}
    assert found(chain) == want and len(written) == 1
    assert found(chain.limit(0)) == {}
    monkeypatch.setattr(components, "HELD", 8)
    assert found(chain.repartition(4)) == want
    texts = chain.limit(20).select(F.format_string("%03d", "src").alias("src"), F.format_string("%03d", "dst").alias("dst"))
    assert found(texts) == {f"{i:03d}": "000" for i in range(21)}


def test_linkage(spark):
    e = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.3), (1, 3, 0.9), (8, 9, 0.2)], "src int, dst int, dist double")
    of = lambda m: {r["node"]: r["cluster"] for r in G.linkage_clusters(e, 0.5, m).collect()}
    assert of("complete") == {1: 1, 2: 1, 3: 3, 8: 8, 9: 8}
    assert of("average") == {1: 1, 2: 1, 3: 3, 8: 8, 9: 8}
    found, log = G.focal_cluster(G.distance_edges(spark.createDataFrame([(1, 2, 90.0), (2, 3, 70.0)], "src int, dst int, pident double")), 1, 3, 5, start=0.1, interval=0.1)
    assert sorted(r["node"] for r in found.collect()) == [1, 2, 3] and log[-1][1] == 3


@pytest.mark.parametrize("few", [G.FEW, 1])
def test_kmer_edges_against_brute_force(spark, monkeypatch, few):
    """Copies, changed copies and longer texts that hold parts of them; components as of all pairs."""
    monkeypatch.setattr(G, "FEW", few)
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("acgtnkry") for _ in range(n))
    base = [text(120) for _ in range(12)]
    texts = [*base, *base[:6], *(x.upper() for x in base[6:8])]
    for x in base:
        texts += [x[:60] + text(3) + x[63:], x[4:] + text(4)]
    for _ in range(40):
        texts.append(text(200).join(x[i : i + 40] for x in rng.sample(base, 4) for i in [rng.randrange(80)]))
    texts += ["acg", "acg", "", "acgtn"]
    table = spark.createDataFrame([(f"s{i:03}", x) for i, x in enumerate(texts)], "seqid string, sequence string")
    k, m, least = 5, 20, 0.5
    grams = sorted({x.upper()[i : i + k] for x in texts for i in range(len(x) - k + 1)})
    hashes = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    lists = [set(sorted({hashes[x.upper()[i : i + k]] for i in range(len(x) - k + 1)})[:m]) for x in texts]
    want = {}
    for i, x in enumerate(lists):
        for j in range(i):
            share = 1.0 if texts[i].upper() == texts[j].upper() else len(x & lists[j]) / max(1, min(len(x), len(lists[j])))
            if share >= least:
                want[f"s{j:03}", f"s{i:03}"] = 1 - share
    low = list(range(len(texts)))
    for _ in texts:
        for a, b in want:
            i, j = int(a[1:]), int(b[1:])
            low[i] = low[j] = min(low[i], low[j])
    edges = G.kmer_edges(table, k, m, least).collect()
    assert edges and all(abs(want[tuple(sorted((r["src"], r["dst"])))] - r["dist"]) < 1e-9 for r in edges)
    assert len({(r["src"], r["dst"]) for r in edges}) == len(edges)
    assert {r["member"]: r["rep"] for r in G.homology_pairs(table, k, m, least).collect()} == {f"s{i:03}": f"s{c:03}" for i, c in enumerate(low)}
    assert G.kmer_edges(table.limit(0)).count() == 0


def test_codon_sequences(spark):
    rows = gff(
        spark,
        ("gene", 1, 9, "+", "ID=g;Alias=o_1"), ("mRNA", 1, 9, "+", "ID=r;Parent=g;Alias=o_1"), ("CDS", 1, 3, "+", "ID=c1;Parent=r;Alias=o_1"), ("CDS", 7, 9, "+", "ID=c2;Parent=r;Alias=o_1"),
        ("gene", 10, 15, "-", "ID=h;Alias=o_2"), ("mRNA", 10, 15, "-", "ID=s;Parent=h;Alias=o_2"), ("CDS", 10, 15, "-", "ID=d;Parent=s;Alias=o_2"),
    )
    contig = spark.createDataFrame([("o", "c", "ATGCCCTAATTACAT")], "ome string, seqid string, sequence string")
    assert {r["alias"]: r["sequence"] for r in S.cds_from_gff(rows, contig).collect()} == {"o_1": "ATGTAA", "o_2": "ATGTAA"}
    assert {r["sequence"] for r in S.proteins_from_gff(rows, contig).collect()} == {"M*"}
    spans = {r["alias"]: (r["sequence"], r["before"], r["after"]) for r in S.gene_spans(rows, contig, 2).collect()}
    assert spans["o_1"] == ("ATGCCCTAATT", 0, 2) and spans["o_2"] == ("ATGTAATT", 2, 0)
    cut = S.extract_regions(spark.createDataFrame([("o", "c", 0, 3, "+", "n"), ("o", "c", 6, 9, "+", "n"), ("o", "c", 12, -1, "-", "m"), ("o", "c", 10, 99, "+", "k")], "ome string, seqid string, start int, end int, strand string, name string"), contig)
    assert {r["name"]: (r["sequence"], r["overrun"]) for r in cut.collect()} == {"n": ("ATGTAA", False), "m": ("TG", False), "k": ("TACAT", True)}
    qc = S.proteome_qc(spark.createDataFrame([("o", "*"), ("p", "M"), ("p", "")], "ome string, sequence string"))
    assert {r["ome"]: r["rejected"] for r in qc.collect()} == {"o": True, "p": False}


def test_hit_limits_after_choice(spark):
    rows = spark.createDataFrame([("q", "o_1", 90.0, 95.0, 0.0, 10.0, 1), ("q", "o_2", 90.0, 95.0, 0.0, 99.0, 2), ("q", "o_3", 80.0, 85.0, 0.0, 99.0, 3)], "qseqid string, sseqid string, pident double, ppos double, evalue double, bitscore double, row int")
    assert [r["sseqid"] for r in H.select_hits(rows, 1, bitscore=50).collect()] == []
    assert [r["sseqid"] for r in H.select_hits_global(rows, 1, bitscore=50).collect()] == ["o_2"]


def test_hmm_selection(spark):
    hits = spark.createDataFrame([("q", 100, "a", 1e-9, 50.0), ("q", 100, "b", 1e-9, 60.0), ("q", 100, "c", 1.0, 90.0)], "query string, model_len int, seq string, seq_e double, seq_score double")
    domains = spark.createDataFrame([("q", "a", 1, 60), ("q", "b", 1, 20), ("q", "c", 1, 90)], "query string, seq string, hmm_from int, hmm_to int")
    kept, parts = H.select_hmm_hits(hits, domains, 0.5, 0.1, 10, 5)
    assert [r["seq"] for r in kept.collect()] == ["a"] and parts.count() == 1


def test_hg_pairs_against_windows(spark):
    rng = random.Random(5)
    pos, hg = [], []
    for contig in range(12):
        for p in range(1, rng.randrange(3, 15)):
            gene = f"o_{contig}x{p}"
            pos.append(("o", f"c{contig}", gene, p))
            if rng.random() < 0.8:
                hg.append((rng.randrange(9), gene, "o"))
    got = {(r["hg0"], r["hg1"]) for r in A.hg_pairs(spark.createDataFrame(pos, "ome string, seqid string, alias string, pos int"), spark.createDataFrame(hg, "hg int, gene string, ome string"), 2).collect()}
    of = {g: h for h, g, _ in hg}
    want = set()
    for contig in {x[1] for x in pos}:
        genes = [of.get(x[2]) for x in pos if x[1] == contig]
        for i in range(len(genes) - 5 + 1):
            window = genes[i : i + 6]
            want |= {tuple(sorted((a, b))) for k, a in enumerate(window) for b in window[k + 1 :] if a is not None and b is not None and a != b}
    assert got == want


def test_codes_and_merge(spark):
    cat = spark.createDataFrame([("genspe1", "A1"), ("genspe2.1", "A2")], "ome string, assembly_acc string")
    new = spark.createDataFrame([("A2", "Genus", "species"), ("B1", "Genus", "species"), ("B2", "Ge", "sp.")], "assembly_acc string, genus string, species string")
    got = {r["assembly_acc"]: r["ome"] for r in K.generate_codes(new, cat, spark.createDataFrame([("genspe7",)], "ome string")).collect()}
    assert got == {"A2": "genspe2.2", "B1": "genspe8", "B2": "gesp..1"}
    ref = spark.createDataFrame([("abcdef1", "x"), ("abcdef2.1", "y")], "ome string, v string")
    now, old = K.promote(ref, spark.createDataFrame([("abcdef1.1", "z")], "ome string, v string"))
    assert sorted(r["ome"] for r in now.collect()) == ["abcdef1.1", "abcdef2.1"] and old.first()["ome"] == "abcdef1"


def test_overlap_rules(spark):
    ncbi = spark.createDataFrame([("G1", "P1", "s", "g", "a", ""), ("G2", "", "JGI", "g", "b", ""), ("G3", "", "s", "h", "c", "x"), ("G4", "", "s", "z", "z", "z"), ("G5", "", "s", "h", "c", "")], "assembly_acc string, assembly_name string, submitter string, genus string, species string, strain string")
    jgi = spark.createDataFrame([("P1", "q", "q", ""), ("P2", "h", "c", "x")], "portal string, genus string, species string, strain string")
    only, both = K.cross_source_overlap(ncbi, jgi, spark.createDataFrame([("G2", "P9")], "assembly_acc string, portal string"))
    assert {r["assembly_acc"]: r["rule"] for r in both.collect()} == {"G1": "name", "G2": "pair", "G3": "strain", "G5": "species"}
    assert [r["assembly_acc"] for r in only.collect()] == ["G4"]


def test_curation(spark):
    rows = gff(spark, ("gene", 1, 100, "+", "ID=g"), ("CDS", 1, 40, "+", "ID=c;Parent=g;proteinId=p1"), ("tRNA", 200, 250, "+", "ID=t;Parent=u"), ("start_codon", 1, 3, "+", "ID=z"))
    done = Q.curate(rows)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 60
    done = done.collect()
    assert sorted(r["type"] for r in done) == ["CDS", "exon", "gene", "gene", "mRNA", "tRNA"]
    assert {r["attributes"] for r in done if r["type"] == "mRNA"} == {"Alias=o_p1;ID=RNA_o_p1;Parent=gene_o_p1"}
    introns = gff(spark, ("gene", 1, 100, "+", "ID=g"), ("mRNA", 1, 100, "+", "ID=r;Parent=g"), ("intron", 20, 30, "+", "ID=i;Parent=r"), ("intron", 50, 60, "+", "ID=j;Parent=r"))
    assert sorted((r["start"], r["end"]) for r in Q.exons_from_introns(introns).collect()) == [(1, 19), (31, 49), (61, 100)]
    gtf = gff(spark, ("exon", 9, 1, "+", 'gene_id "g"; transcript_id "t"'), ("CDS", 1, 9, "+", 'gene_id "g"; transcript_id "t"'))
    assert sorted((r["type"], r["start"], r["end"]) for r in Q.curate(gtf, 2.5).collect()) == [("CDS", 1, 9), ("exon", 1, 9), ("gene", 1, 9), ("mRNA", 1, 9)]


def test_curation_of_genomes(spark):
    """One genome in each of two dialects, one whose proteins are all empty, one without any dialect."""
    row = lambda ome, k, t, s, e, a: (ome, k, "c", "x", t, s, e, ".", "+", ".", a)
    rows = [row("a1", 0, "gene", 1, 9, "ID=g"), row("a1", 1, "mRNA", 1, 9, "ID=r;Parent=g"), row("a1", 2, "CDS", 1, 9, "ID=c;Parent=r;protein_id=p"), row("b1", 0, "CDS", 1, 6, 'gene_id "g"; transcript_id "t"'), row("c1", 0, "gene", 1, 3, "ID=g"), row("c1", 1, "CDS", 1, 3, "ID=c;Parent=g;protein_id=q"), row("d1", 0, "gene", 1, 3, "none")]
    contigs = spark.createDataFrame([("a1", "c", "ATGCCCTAA"), ("b1", "c", "ATGTTT"), ("c1", "c", "TAA"), ("d1", "c", "A"), ("e1", "c", "ATG")], "ome string, seqid string, sequence string")
    rows += [row("f1", 0, "gene", 1, 9, "ID=g"), row("f1", 1, "CDS", 1, 9, "ID=c;Parent=g;protein_id=p")]
    models, bases, proteins, failed = Q.curate_genomes(spark.createDataFrame(rows, GFF), contigs)
    assert {(r["ome"], r["reason"]) for r in failed.collect()} == {("c1", "empty proteins"), ("d1", "unknown dialect"), ("e1", "no annotation"), ("f1", "no assembly")}
    assert {(r["ome"], r["alias"], r["sequence"]) for r in proteins.collect()} == {("a1", "a1_p", "MP*"), ("b1", "b1_mtdb1", "MF")}
    assert {r["seqid"] for r in models.collect()} == {"a1_c", "b1_c"} == {r["seqid"] for r in bases.collect()}


def test_genbank(spark, tmp_path):
    from genomeloom.operators import genbank

    rows = gff(spark, ("gene", 4, 12, "+", "ID=g;Alias=o_1;product=p"), ("mRNA", 4, 12, "+", "ID=r;Parent=g;Alias=o_1"), ("CDS", 4, 6, "+", "ID=c;Parent=r;Alias=o_1"), ("CDS", 10, 12, "+", "ID=d;Parent=r;Alias=o_1"), ("gene", 14, 16, "-", "ID=h;Alias=o_2"))
    contig = spark.createDataFrame([("o", "c", "TTTATGCCCTAAGCATT")], "ome string, seqid string, sequence string")
    proteins = spark.createDataFrame([("o", "o_1", "M" * 50)], "ome string, alias string, sequence string")
    catalog = spark.createDataFrame([("o", "Gen", "sp", "st", "jgi")], "ome string, genus string, species string, strain string, source string")
    blocks = genbank.genbank_blocks(rows, contig, proteins, catalog)
    text = "\n".join(r["block"] for r in blocks.orderBy("ome", "seqid", "section", "place").collect()).split("\n")
    genbank.write_genbank(blocks, str(tmp_path / "gbk"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "gbk" / "ome=o").glob("part-*"))) == "\n".join(text) + "\n"
    assert text[0] == "LOCUS       o_c" and "  ORGANISM  Gen_sp_st_o" in text and '                     /contig_edge=3-;1+' in text
    assert "     gene            1..9" in text and "     mRNA            join(1..3,7..9)" in text and "     CDS             join(1..3,7..9)" in text and "     gene            complement(11..13)" in text
    at = text.index('                     /translation="' + "M" * 45)
    assert text[at + 1] == " " * 21 + 'MMMMM"' and text[-3:] == ["ORIGIN", "        1 atgccctaag cat", "//"]


def test_genbank_long_contig(spark):
    """Bases in several tiles are numbered on, and their lines are as those of one text."""
    from genomeloom.operators import genbank

    size = 2 * genbank.TILE + 77
    bases = "".join(random.Random(3).choices("ACGT", k=size))
    rows = gff(spark, ("gene", 1, size, "+", "ID=g;Alias=o_1"))
    contig = spark.createDataFrame([("o", "c", bases)], "ome string, seqid string, sequence string")
    blocks = genbank.genbank_blocks(rows, contig, contig.limit(0).withColumnRenamed("seqid", "alias"), spark.createDataFrame([], "ome string, genus string, species string, strain string, source string"))
    held = blocks.where("section = 2").orderBy("place").collect()
    lines = "\n".join(r["block"] for r in held).split("\n")
    want = [f"{i + 1:>9} " + " ".join(bases[i : i + 60].lower()[k : k + 10] for k in range(0, 60, 10)).rstrip() for i in range(0, size, 60)]
    assert len(held) == 3 and lines == ["ORIGIN", *want]


def test_linkage_against_brute_force(spark):
    rng = random.Random(31)
    names = list(range(40))
    dist = {(a, b): rng.randrange(1, 10**6) / 10**6 for a in names for b in names if a < b and rng.random() < 0.35}
    table = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "src int, dst int, dist double")
    for method in ("average", "complete", "weighted"):
        groups = {x: [x] for x in names}
        d = {(a, b): dist.get((a, b), 1.0) for a in names for b in names if a < b}
        while d and min(d.values()) <= 0.6:
            a, b = min(d, key=lambda k: (d[k], k))
            for c in groups:
                if c not in (a, b):
                    x, y = d[min(a, c), max(a, c)], d[min(b, c), max(b, c)]
                    na, nb = len(groups[a]), len(groups[b])
                    d[min(a, c), max(a, c)] = max(x, y) if method == "complete" else (na * x + nb * y) / (na + nb) if method == "average" else (x + y) / 2
            groups[a] += groups.pop(b)
            d = {k: v for k, v in d.items() if b not in k}
        linked = {x for e, v in dist.items() if v <= 0.6 for x in e}
        want = {x: min(g) for g in groups.values() for x in g if x in linked}
        assert {r["node"]: r["cluster"] for r in G.linkage_clusters(table, 0.6, method).collect()} == want


def test_edges_stay(spark, monkeypatch):
    """Edges given once are not moved; the forest of what tasks leave is that of all edges, however few a task holds; small components end in a task as by rounds."""
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))): rng.randrange(0, 8) / 10 for _ in range(700)}
    hits = spark.createDataFrame([(*e, 100 * (1 - v)) for e, v in pairs.items()], "src long, dst long, pident double").repartition(5)
    edges = G.distance_edges(hits, once=True)
    moved = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert moved(edges) == moved(hits)
    left = G.thinned(edges)
    assert left.count() < edges.count() / 2
    whole = {frozenset((r["src"], r["dst"])) for r in G.spanning_forest(edges).collect()}
    monkeypatch.setattr(G, "HELD", 10)
    assert {frozenset((r["src"], r["dst"])) for r in G.spanning_forest(edges).collect()} == whole and len(whole) == 59
    for method in ("average", "complete", "weighted"):
        monkeypatch.setattr(G, "WITHIN", 1_000)
        inside = {(r["node"], r["cluster"]) for r in G.linkage_clusters(edges, 0.3, method).collect()}
        monkeypatch.setattr(G, "WITHIN", 1)
        assert {(r["node"], r["cluster"]) for r in G.linkage_clusters(edges, 0.3, method).collect()} == inside and len(inside) > 50


def test_supermatrix(spark):
    rows = spark.createDataFrame([("f1", "a", "AC"), ("f2", "a", "GGG"), ("f1", "b", "TT"), ("f2", "b", "CCC"), ("f1", "c", "AA")], "file string, ome string, sequence string")
    missing, many = T.alignment_completeness(rows)
    assert missing.first()["missing"] == "c" and many.count() == 0
    concat, parts = T.supermatrix(T.complete_genomes(rows))
    assert {r["ome"]: r["sequence"] for r in concat.collect()} == {"a": "ACGGG", "b": "TTCCC"}
    assert "charset f2 = 3-5;" in T.nexus_partitions(parts)
    with pytest.raises(Exception, match="unequal"):
        T.supermatrix(rows.union(spark.createDataFrame([("f1", "d", "A")], rows.schema)))[1].collect()


def test_supermatrix_digests(spark):
    """Length and SHA-256 of rows that are never gathered; pieces beyond ASCII, null pieces and a genome of null count as in the row."""
    rows = [(f"f{k:03}", ome, f"{ome}{k}é") for k in range(300) for ome in ("a", "b", "c")] + [("f000", None, "AC"), ("f001", "a", None), ("f001", "a", "a0")]
    table = spark.createDataFrame(rows, "file string, ome string, sequence string").repartition(7)
    whole = T.supermatrix(table)[0]
    want = {tuple(r) for r in whole.select("ome", F.length("sequence"), F.sha2("sequence", 256)).collect()}
    got = T.supermatrix_digests(table)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 4
    assert T.supermatrix_digests(table.limit(0)).count() == 0
    from genomeloom.jobs import registry

    assert "collect_list" not in registry.QUERIES["t2_supermatrix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_compare_loci(spark):
    """Two equal loci are merged, a locus of one query does not count, genes without a hit are listed without queries."""
    from genomeloom.operators.workflows import compare_loci

    at = [("a", "c", "a_1", 1, 10, 1), ("a", "c", "a_2", 20, 30, 2), ("a", "c", "a_3", 35, 40, 3), ("a", "d", "a_4", 1, 10, 1), ("a", "d", "a_5", 15, 30, 2), ("a", "e", "a_6", 1, 9, 1), ("b", "c", "b_1", 1, 9, 1)]
    pos = spark.createDataFrame(at, "ome string, seqid string, alias string, start long, end long, pos int")
    hits = [("q1", "a_1", 90.0), ("q2", "a_3", 70.0), ("q1", "a_4", 80.0), ("q2", "a_5", 80.0), ("q3", "a_5", 1.0), ("q1", "a_6", 99.0), ("q1", "b_1", 99.0), ("q1", "a_1", 30.0)]
    table = spark.createDataFrame([(*h, None, 0.0, 50.0, k) for k, h in enumerate(hits)], "qseqid string, sseqid string, pident double, ppos double, evalue double, bitscore double, row int")
    got = {(r["gene"], r["pos"], r["queries"], round(r["similarity"], 6)) for r in compare_loci(table, pos, 100, pident=0.2).collect()}
    share = round(2 / 3 * 0.8, 6)
    assert got == {("a_1", 1, "q1", share), ("a_2", 2, None, share), ("a_3", 3, "q2", share), ("a_4", 1, "q1", share), ("a_5", 2, "q2", share)}
    assert compare_loci(table.limit(0), pos, 100).count() == 0


def test_placed_groups(spark):
    """Genes get their groups in the move that brings a genome's rows together: the same rows as by a join, a gene of two groups twice, and no more moves for pairs."""
    gff = spark.createDataFrame([(f"o{g}", f"c{k % 2}", "gene" if k % 3 else "mRNA", k * 10, k * 10 + 5, f"ID=x;Alias=o{g}_{k}") for g in range(3) for k in range(20)], "ome string, seqid string, type string, start long, end long, attributes string")
    hg = spark.createDataFrame([(k % 4, f"o{g}_{k}", f"o{g}") for g in range(3) for k in range(0, 20, 2)] + [(9, "o1_2", "o1"), (9, "none_1", "none"), (None, "o1_3", "o1")], "hg long, gene string, ome string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    plain = X.gene_positions(gff)
    placed = A.placed_groups(gff, hg, 3)
    want = plain.join(hg.select("ome", F.col("gene").alias("alias"), "hg"), ["ome", "alias"], "left").select(*placed.columns)
    assert rows(placed) == rows(want) and ("o1", "c0", "o1_2", 20, 25, 2, 9) in rows(placed)
    pairs = A.hg_pairs(placed, None, 2)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(pairs) == rows(A.hg_pairs(plain, hg, 2)) and rows(A.supported(hg, 2)) == rows(hg.where("hg < 4"))


def test_update_catalog(spark):
    """A new version takes the place of the old one; what failed before, gets no code or has no files is told apart."""
    from genomeloom.operators.workflows import update_catalog

    catalog = spark.createDataFrame([("genspe1", "A1", "Gen", "spe", "jgi", "1"), ("genspe2", "A2", "Gen", "spe", "jgi", "1")], "ome string, assembly_acc string, genus string, species string, source string, version string")
    new = spark.createDataFrame([("A1", "Gen", "spe", "jgi", "2"), ("A3", "Gen", "spe", "jgi", "2"), ("A4", "Gen", "spe", "jgi", "2"), ("A5", None, "x", "jgi", "2"), ("A6", "Gen", "spe", "jgi", "2")], "assembly_acc string, genus string, species string, source string, version string")
    row = lambda acc, k, t, e, a: (acc, k, "c", "x", t, 1, e, ".", "+", ".", a)
    models = [row(acc, k, t, 9, a) for acc in ("A1", "A3") for k, (t, a) in enumerate((("gene", "ID=g"), ("mRNA", "ID=r;Parent=g"), ("CDS", "ID=c;Parent=r;protein_id=p")))]
    gff = spark.createDataFrame(models, "assembly_acc string, row long, seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string")
    contigs = spark.createDataFrame([("A1", "c", "ATGCCCTAA"), ("A3", "c", "ATGCCCTAA"), ("A6", "c", "ATG")], "assembly_acc string, seqid string, sequence string")
    ledger = spark.createDataFrame([("A9", "jgi", "1", "d"), ("A6", "jgi", "1", "d")], "code string, source string, version string, attempt_date string")
    done = update_catalog(catalog, new, catalog.select("ome").limit(0), ledger, gff, contigs, "now")
    assert {(r["ome"], r["assembly_acc"], r["version"]) for r in done.catalog.collect()} == {("genspe1.1", "A1", "2"), ("genspe2", "A2", "1"), ("genspe3", "A3", "2")}
    assert [r["ome"] for r in done.replaced.collect()] == ["genspe1"]
    assert {tuple(r) for r in done.failed.select("assembly_acc", "reason").collect()} == {("A4", "no assembly"), ("A5", "no name"), ("A6", "no annotation")}
    assert {(r["ome"], r["alias"], r["sequence"]) for r in done.proteins.collect()} == {("genspe1.1", "genspe1.1_p", "MP*"), ("genspe3", "genspe3_p", "MP*")}
    assert {(r["code"], r["attempt_date"]) for r in done.ledger.collect()} == {("A9", "d"), ("A4", "now"), ("A5", "now"), ("A6", "now")}
    again = update_catalog(done.catalog, new.where("assembly_acc = 'A4'"), catalog.select("ome").limit(0), done.ledger, gff, contigs, "later")
    assert again.failed.count() == 0 and again.catalog.count() == 3
