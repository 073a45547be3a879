"""Storage by genome, range look-ups, presence bitmaps, pruning and spanning forests against brute force and plans."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from genomeloom.operators import catalog as K
from genomeloom.operators import features as X
from genomeloom.operators import graph as G
from genomeloom.operators import groups as A
from genomeloom.operators import presence as P
from genomeloom.sources import formats as S
from genomeloom.sources import store

GFF = "ome string, seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def gff(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ome, at = f"ome{rng.randrange(5)}", rng.randrange(3000)
        rows.append((ome, f"{ome}_{rng.randrange(2)}", "x", rng.choice(["gene", "mRNA", "CDS"]), at, at + rng.randrange(200), ".", "+", ".", f"ID=i{k};Alias={ome}_{k // 3}"))
    return spark.createDataFrame(rows, GFF)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_needs_no_exchange(spark, tmp_path):
    rows = gff(spark)
    held = store.write_store(rows, str(tmp_path / "gff"), ["seqid", "start"], 4)
    again = store.read_store(spark, str(tmp_path / "gff"))
    for table in (held, again):
        for job in (X.annotation_stats, X.gene_positions):
            got = job(table)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, job(rows).collect()))
            assert "Exchange" not in plan(got)
    assert "Exchange" in plan(X.gene_positions(rows))
    files = [f for f in (tmp_path / "gff" / "data").iterdir() if f.suffix == ".parquet"]
    assert 0 < len(files) <= 4


def test_commits_of_genomes(spark, tmp_path):
    path, rows = str(tmp_path / "done"), gff(spark)
    store.commit_genomes(rows.where("ome <> 'ome4'"), path)
    store.commit_genomes(rows.where("ome IN ('ome3', 'ome4')"), path)
    store.commit_genomes(rows.where("ome = 'ome4'"), path)
    assert sorted(map(repr, store.read_committed(spark, path, GFF).collect())) == sorted(map(repr, rows.collect()))


@pytest.mark.parametrize("n", [0, 150])
def test_locus_look_ups(spark, n):
    pos = X.gene_positions(gff(spark, seed=2)).cache()
    genes = [r.asDict() for r in pos.collect()]
    focus = {g["alias"] for g in genes[::7]}
    want = set()
    for f in genes:
        if f["alias"] in focus:
            own = [g for g in genes if g["seqid"] == f["seqid"]]
            lo = min(g["pos"] for g in own if g["end"] >= f["start"] - n)
            hi = max(g["pos"] for g in own if g["start"] <= f["end"] + n)
            want |= {(f["alias"], f["seqid"], g["alias"]) for g in own if lo <= g["pos"] <= hi}
    got = X.locus_by_bases(pos, spark.createDataFrame([(a,) for a in focus], "alias string"), n)
    rows = [(r["focus"], r["seqid"], r["alias"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    a, b = sorted((g for g in genes if g["seqid"] == "ome1_0"), key=lambda g: g["pos"])[2:9:6]
    between = X.locus_between(pos, spark.createDataFrame([(b["alias"], a["alias"])], "a string, b string"))
    assert sorted(r["pos"] for r in between.where("seqid = 'ome1_0'").collect()) == list(range(3, 10))


def test_presence_blocks(spark, tmp_path):
    rng = random.Random(3)
    members = [f"m{k:03d}" for k in range(131)]
    pairs = {(k, m) for k in range(8) for m in members if rng.random() < k / 7} | {(3, "unknown"), (99, "unknown")}
    table = spark.createDataFrame(sorted(pairs), "hg int, ome string")
    want = {}
    for k in {k for k, _ in pairs}:
        if lost := [m for m in members if (k, m) not in pairs]:
            want[k] = (len(lost), ",".join(lost))
    every = spark.createDataFrame([(m,) for m in members], "ome string")
    assert {r["hg"]: (r["n_missing"], r["missing"]) for r in P.lacking(table, "hg", "ome", every).collect()} == want
    assert P.lacking(table, "hg", "ome", every.limit(0)).count() == 0 and P.lacking(table.limit(0), "hg", "ome", every).count() == 0
    S.write_phylip(table, "hg", "ome", str(tmp_path / "p"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*"))).splitlines()
    columns = sorted({m for _, m in pairs})
    keys = sorted({k for k, _ in pairs}, key=str)
    assert lines == [f"{len(keys)} {len(columns)}", *(f"{k} {''.join('1' if (k, m) in pairs else '0' for m in columns)}" for k in keys)]


def test_report_parts_are_ordered(spark, tmp_path):
    S.write_report(spark.range(50).selectExpr("concat('o', id) AS ome", "id AS n", "CAST(NULL AS STRING) AS x"), str(tmp_path / "r"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*"))).splitlines()
    assert lines[0] == "#ome\tn\tx" and lines[1:] == sorted(f"o{k}\t{k}\t" for k in range(50))


def test_pruned_pairs(spark):
    rng = random.Random(4)
    pos = spark.createDataFrame([(f"o{g}", f"o{g}_c", f"o{g}_{k}", k + 1) for g in range(6) for k in range(40)], "ome string, seqid string, alias string, pos int")
    hg = spark.createDataFrame([(rng.randrange(25), f"o{g}_{k}", f"o{g}") for g in range(6) for k in range(40) if rng.random() < 0.8], "hg int, gene string, ome string")
    whole = A.hg_pairs(pos, hg, 2)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(A.frequent_pairs(pos, hg, 2, 3)) == rows(A.cooccurrence(whole, 3))
    focal = hg.where("hg < 3").select("hg")
    assert rows(A.hg_pairs(pos, hg, 2, focal)) == rows(whole.where("hg0 < 3 OR hg1 < 3"))
    assert rows(A.microsynteny_matrix(A.hg_pairs(pos, hg, 2, focal), focal, 6)) == rows(A.microsynteny_matrix(whole, focal, 6))


def minimax(edges, focus):
    best = {focus: 0.0}
    todo = [focus]
    while todo:
        u = todo.pop()
        for a, b, d in edges:
            for x, y in ((a, b), (b, a)):
                if x == u and max(best[u], d) < best.get(y, 9):
                    best[y] = max(best[u], d)
                    todo.append(y)
    return best


def test_spanning_forest_and_merge_distances(spark):
    rng = random.Random(5)
    chain = [(k, k + 1, 0.5) for k in range(13)]
    star = [(0, k, 0.1 * (k % 3)) for k in range(1, 12)]
    mixed = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), rng.randrange(6) / 10) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a != b}.values())
    for edges in (chain, star, mixed):
        table = spark.createDataFrame(edges, "src int, dst int, dist double")
        forest = [tuple(r) for r in G.spanning_forest(table).collect()]
        nodes = {x for a, b, _ in edges for x in (a, b)}
        reach = {n: minimax(edges, n) for n in nodes}
        assert len(forest) == len(nodes) - len({min(reach[n]) for n in nodes})
        assert all(minimax(forest, n) == reach[n] for n in list(nodes)[:5])
        focus = edges[3][0]
        assert {r["node"]: r["dist"] for r in G.merge_distances(table, focus).collect()} == reach[focus]
    assert G.spanning_forest(table.limit(0)).count() == 0
    assert [tuple(r) for r in G.merge_distances(table.limit(0), 7).collect()] == [(7, 0.0)]


def test_codes_share_prefixes(spark):
    cat = spark.createDataFrame([("genspe1", "A1"), ("genspe8", "A8")], "ome string, assembly_acc string")
    rows = [("N1", "Genus", "species", "genspe9"), ("N2", "Genus", "species", ""), ("N3", "Genus", "species", "genspe1"), ("N4", "Genus", "species", "genspe1"), ("N5", "Ge", "sp.", None), ("N6", None, "x", ""), ("N7", "Genus", "species", "genspe9"), ("N8", "G e", "s(p", ""), ("N9", "Genus", "species", "gen"), ("A8", "Genus", "species", "")]
    new = spark.createDataFrame(rows, "assembly_acc string, genus string, species string, ome string")
    none = spark.createDataFrame([], "ome string")
    got = {r["assembly_acc"]: r["ome"] for r in K.generate_codes(new, cat, none).collect()}
    assert got == {"N1": "genspe9", "N2": "genspe10", "N3": "genspe1.1", "N4": "genspe1.2", "N5": "gesp..1", "N8": "gesp..2", "A8": "genspe8.1"}
    assert {r["assembly_acc"]: r["failure"] for r in K.failed_codes(new, cat, none).collect()} == {"N6": "no name", "N7": "given twice", "N9": "malformed"}


def test_nothing_imports_the_training_data_folder():
    root = Path(__file__).resolve().parents[1] / "genomeloom"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and re.search(r"genomeloom\.llm|import llm", f.read_text())]


def test_lists_of_what_is_lacking_are_not_moved(spark):
    from genomeloom.operators import presence as P

    omes = spark.range(300).selectExpr("concat('g', lpad(id, 3, '0')) AS ome")
    held = spark.range(40).selectExpr("id % 4 AS hg", "concat('g', lpad(id * 7, 3, '0')) AS ome")
    lists = P.lacking(held, "hg", "ome", omes)
    # the names come in after the last exchange of groups, and no group is spread over its blocks
    assert "Generate" not in plan(lists)
    own = {hg: {f"g{i * 7:03d}" for i in range(40) if i % 4 == hg} for hg in range(4)}
    every = [f"g{i:03d}" for i in range(300)]
    assert {r["hg"]: r["missing"] for r in lists.collect()} == {hg: ",".join(x for x in every if x not in own[hg]) for hg in range(4)}


def test_gc_is_printed_as_c_prints_it(spark):
    from genomeloom.functions import columns as C

    pairs = [(g, n) for n in (1, 7, 64, 160, 800, 1600, 2000, 20000) for g in range(0, n + 1, max(1, n // 97))]
    rows = spark.createDataFrame([("G" * g + "A" * (n - g), 100.0 * g / n) for g, n in pairs], "sequence string, x double")
    got = rows.select(C.gc_percent(F.col("sequence")).alias("gc"), "x").collect()
    assert [r["gc"] for r in got] == [f"{r['x']:.2f}%" for r in got]


def test_curation_moves_rows_once(spark):
    from genomeloom.operators import curate as Q

    cols = "ome string, row int, seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
    made = [("g1", 0, "c", "x", "gene", 1, 90, ".", "+", ".", "ID=a"), ("g1", 1, "c", "x", "mRNA", 1, 90, ".", "+", ".", "ID=r;Parent=a"), ("g1", 2, "c", "x", "CDS", 1, 30, ".", "+", "0", "ID=c1;Parent=r;protein_id=p1"), ("g1", 3, "c", "x", "CDS", 50, 90, ".", "+", "0", "ID=c2;Parent=r;protein_id=p2"), ("g1", 4, "c", "x", "tRNA", 200, 290, ".", "+", ".", "ID=t")]
    rows = spark.createDataFrame(made, cols)
    steps = [Q.resolve_parents, Q.complete_models, Q.exons_from_introns, Q.split_isoforms, Q.assign_aliases, Q.rename_and_organise]
    for step in steps:
        text = plan(step(rows)).split("Initial Plan")[0]
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text, step
    text = plan(Q.tag_query_features(rows, spark.createDataFrame([("c1",)], "id string"))).split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(ome#\d+, 4\)", text)) == 1
    tagged = Q.tag_query_features(rows, spark.createDataFrame([("p2",), ("c1",), ("c1",)], "id string")).collect()
    assert {r["row"]: r["tag"] for r in tagged} == {0: "c1", 1: "c1", 2: "c1", 3: "p2", 4: None}
    assert sorted((r["type"], r["attributes"]) for r in Q.complete_models(rows).collect() if "exon" in r["type"] or r["attributes"] == "ID=t") == [("exon", "ID=exon_c1_1;Parent=r"), ("exon", "ID=exon_c2_50;Parent=r"), ("gene", "ID=t"), ("tRNA", "ID=t")]
    split = sorted(r["attributes"] for r in Q.split_isoforms(rows).collect() if r["type"] == "mRNA")
    assert split == ["ID=a-T0;Parent=a;protein_id=p1", "ID=a-T1;Parent=a;protein_id=p2"]


def test_loci_are_read_from_the_order_of_their_contig(spark):
    pos = spark.createDataFrame([("g", "c", f"a{i}", 10 * i, 10 * i + 5, i) for i in range(1, 41)] + [("h", "d", "a2", 1, 5, 1), ("h", "d", "b", 11, 15, 2)], "ome string, seqid string, alias string, start long, end long, pos int")
    asked = spark.createDataFrame([("a2",), ("a30",), ("a30",)], "alias string")
    labels = spark.createDataFrame([("a4", "k"), ("a29", "k"), ("a31", "m"), ("a31", "n")], "alias string, label string")
    near = X.locus_by_genes(pos, asked, 2)
    # a place is nowhere joined
    assert "pos#" not in " ".join(re.findall(r"Join .*", plan(near)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = sorted((f, o, s, a, p) for f in ("a2", "a30") for o, s, _, _, at in [("g", "c", 0, 0, int(f[1:]))] + ([("h", "d", 0, 0, 1)] if f == "a2" else []) for o2, s2, a, _, _, p in map(tuple, pos.collect()) if (o2, s2) == (o, s) and abs(p - at) <= 2)
    assert rows(near) == want
    assert rows(X.trimmed_loci(pos, asked, labels, 2)) == rows(X.trim_locus(near, labels))


def test_features_are_made_where_their_genes_lie(spark):
    """What reads features of a genome together makes them from genes that were dealt by genome: features are not moved."""
    from genomeloom.jobs import curation_jobs as J

    sf_dir = "/root/testdata/sf0.001"
    for name in "g2_resolve_parents g3_complete_models g4_exons_from_introns g5_split_isoforms g6_assign_aliases g7_rename_and_organise g8_gtf_to_gff3 g9_gff2_to_gff3".split():
        assert "Exchange hashpartitioning" not in plan(J.QUERIES[name](spark, sf_dir)), name


def test_accessions_are_looked_up_by_name_alone(spark):
    """Where features lie by genome, names go to the accessions and back; features, positions and loci are not moved."""
    from genomeloom.jobs import feature_jobs as J

    sf_dir = "/root/testdata/sf0.001"
    for name in ("p10_features_by_accession", "w5_locus_features"):
        text = plan(J.QUERIES[name](spark, sf_dir))
        assert not re.search(r"Exchange hashpartitioning\((ome#\d+, [a-z]|one#)", text) and "Window" in text, name


def test_shuffles_leave_the_disks_with_their_step(spark, monkeypatch):
    from genomeloom.operators import graph as G
    from genomeloom.operators import groups as A
    from genomeloom.operators import presence as P
    from genomeloom.sources.shared import staged

    seen = []
    for module in (G, A, P):
        monkeypatch.setattr(module, "staged", lambda df, name, tidy=False: seen.append((name, tidy)) or staged(df, name, tidy))
    seqs = spark.createDataFrame([("a_1", "ACGTACGGTTCA"), ("a_2", "ACGTACGGTTCC"), ("b_1", "TTTTGGGGCCCC")], "seqid string, sequence string")
    assert {(r["src"], r["dst"]) for r in G.kmer_edges(seqs, 4, 8, 0.5).collect()} == {("a_1", "a_2")}
    hg = A.build_homology_groups(spark.createDataFrame([("a_1", "a_1"), ("a_1", "b_1"), ("c_1", "c_1")], "rep string, member string"))
    got = {r["hg"]: r["missing"] for r in A.hg_missing(hg, spark.createDataFrame([("a",), ("b",), ("c",)], "ome string")).collect()}
    assert got == {0: "c", 1: "a,b"}
    assert {"sketches", "holders", "members", "held"} <= {name for name, _ in seen} and all(tidy for _, tidy in seen), seen
