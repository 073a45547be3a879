"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from genomeloom.jobs import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SAMPLE = "a1_annotation_stats a2_assembly_stats a4_hg_stats a9_hg_pairs w3_locus_by_bases w7_select_hits g10_merge_overlapping c2_single_linkage q1_proteins q3_gene_spans g6_assign_aliases g7_rename_and_organise w14_generate_codes j9_overlap_pairs f18_rename_codes t2_supermatrix compare_loci update_catalog".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert cols == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(repr([plain(v) for v in r]) for r in got.select(*cols).collect()) == sorted(repr([plain(v) for v in r]) for r in want)
