"""Registered queries against their SQL twins on the smallest supplied tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
FAST = (
    "document_frequency", "bm25_topk", "facet_filter_search", "bounded_candidates", "scalar_fusion_winner", "scalar_fusion_conflicts", "list_fusion_union",
    "reference_resolution", "alias_lookup", "orphans", "hierarchy_closure", "active_edge", "co_class_guard", "coverage_assess", "identity_binding", "candidate_binding",
    "classification_normalize", "quality_checks", "feature_neighbors", "fact_merge", "carry_forward_rows", "case_difficulty", "template_tables", "inventory_diff",
    "snapshot_fingerprint", "latest_changes", "query_route", "retrieval_strategy", "phrase_mentions", "element_search", "greedy_rerank", "token_budget_select", "path_motifs", "breadcrumb",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {n for n in queries if n not in sql} == {"diverse_sample"} | {n for n in queries if n[:2] == "op" and n[2].isdigit() or n == "pipeline"} - set(sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "score", "channels"]
    assert df.count() > 0
