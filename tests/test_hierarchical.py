"""Filters that the organisation may satisfy, and search through branches, against plain versions."""

import pytest
from pyspark.sql import functions as F

from metaloom.operators import branches as BR
from metaloom.operators import hierarchical as HS
from metaloom.operators import search as S

PAGE = "path string, canonical_id string, context_type string, name string, topic_domain string, topic string, l0 string, l1 string, identity_status string"
NODES = [("v/radio", "Radio", "topic-domain"), ("v/core", "Core", "topic-domain"), ("v/cells", "Cells", "topic"), ("v/fake", "Radio", "layer")]
CLOSED = [("domain", "v/radio", "v/cells", 1), ("domain", "v/cells", "m1", 1), ("domain", "v/radio", "m1", 2), ("domain", "v/core", "m2", 1), ("domain", "v/radio", "m3", 1), ("domain", "v/fake", "m4", 1), ("domain", "v/radio", "m5", 1)]
PAGES = [
    ("m1", "c1", "logical-model", "One", None, None, "cell load", "deep text", "EXPLICIT"),  # below the node
    ("m2", "c2", "physical-model", "Two", "", None, "cell load", "", "EXPLICIT"),  # below another
    ("m3", "c3", "logical-model", "Three", "core", None, "cell", "", "EXPLICIT"),  # says otherwise itself
    ("m4", "c4", "logical-model", "Four", None, None, "cell", "", "EXPLICIT"),  # below a node of another kind
    ("m5", "c5", "logical-model", "Five", None, None, "cell", "", "CANDIDATE"),  # not trusted
    ("m6", "c6", "physical-model", "Six", " RADIO ", None, "load", "", "EXPLICIT"),  # says so itself
    ("k1", "c7", "metric", "Seven", None, None, "cell load", "", "EXPLICIT"),  # no model
]


@pytest.fixture(scope="module")
def world(spark):
    pages = spark.createDataFrame(PAGES, PAGE)
    closed = spark.createDataFrame(CLOSED, "view string, ancestor string, node string, depth long")
    return pages, closed, spark.createDataFrame(NODES, "path string, name string, context_type string")


@pytest.mark.parametrize(
    "types, scope, want",
    [
        (None, {"domain": " radio"}, {"m1", "m6", "k1"}),
        (["logical-model"], {"topic_domain": "Radio"}, {"m1"}),
        (None, {"topic_domain": "radio", "topic": "cells"}, {"m1", "k1"}),
        (None, {"technology": "lte"}, {"m1", "m2", "m3", "m4", "m6", "k1"}),
        (None, None, {"m1", "m2", "m3", "m4", "m6", "k1"}),
        (None, {"topic_domain": ""}, {"k1"}),
    ],
)
def test_organisation_may_satisfy_a_filter(world, types, scope, want):
    rows = HS.organisation_allowed(*world, types, scope).select("path").collect()
    assert sorted(r.path for r in rows) == sorted(want)


def test_search_goes_through_branches(spark, world):
    pages, closed, nodes = world
    branch = [("domain", p, n.lower(), p, "", "cell load" if n != "Core" else "cell", "EXPLICIT", 1.0) for p, n, _ in NODES[:3]]
    branches = spark.createDataFrame(branch, "view string, path string, name string, canonical_id string, l0 string, l1 string, identity_status string, quality double")
    queries = spark.createDataFrame([(1, "cell load"), (2, "cell load")], "query_id long, text string")
    index = S.build_index(pages, materialize=False)
    seeds = spark.createDataFrame([(1, "k1", 0.4), (2, "k1", 0.4)], "query_id long, path string, score double")
    routes = spark.createDataFrame([(1, "domain")], "query_id long, view string")
    anchors = spark.createDataFrame([(1, "m6", True), (1, "m3", True)], "query_id long, path string, page_anchor boolean")
    hits, used = HS.hierarchical_search(index, queries, seeds, routes, branches, closed, nodes, anchors, scope={"topic_domain": "radio"})
    got = {(r.query_id, r.path): r.score for r in hits.collect()}
    # m1 is found in two branches (base 0.4, first place in each), the anchor is raised, the rejected ones are nowhere.
    assert got == {(1, "m1"): pytest.approx(0.4 + 0.08), (1, "m6"): pytest.approx(0.6), (1, "k1"): pytest.approx(0.4), (2, "k1"): pytest.approx(0.4)}
    assert {(r.query_id, r.branch) for r in used.collect()} == {(1, "v/radio"), (1, "v/cells")}
    direct, none = HS.hierarchical_search(index, queries, seeds, routes.limit(0), branches, closed, nodes)
    assert direct.count() == 2 and none.count() == 0
    assert BR.discover(seeds, hits.select("query_id", F.lit(1).cast("long").alias("branch_rank"), "path", "rank").limit(0), 5).count() == 2
