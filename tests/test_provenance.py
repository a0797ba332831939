"""Provenance of edges against plain dictionaries: shared sets, missing evidence, wide edges, stored pages."""

import random

from metaloom.operators import provenance as P

SCHEMA = "view string, parent string, child string, parent_kind string, child_kind string, status string, method string, rule_id string, confidence double, owner string, evidence string, source string"


def contribution(parent, child, owner, evidence, source, confidence=0.9, rule=None):
    return ("domain", parent, child, "topic", "business-object", "DERIVED" if rule else "CONFIRMED", "domain_rule" if rule else "explicit", rule, confidence, owner, evidence, source)


def test_provenance_equals_plain_sets(spark):
    rnd = random.Random(3)
    rows = [contribution(f"p{rnd.randrange(4)}", f"c{rnd.randrange(8)}", f"o{rnd.randrange(5)}", rnd.choice([None, "e1", "e2", "e3"]), rnd.choice([None, "s1", "s2"]), rnd.random(), rnd.choice([None, "r"])) for _ in range(300)]
    rows += rows[:20]  # repeated contributions
    merged, sets = P.merge_provenance(spark.createDataFrame(rows, SCHEMA))
    want, best = {}, {}
    for r in rows:
        edge = (r[1], r[2], r[7])
        best[edge] = max(best.get(edge, 0), r[8])
        for kind, item in zip(P.KINDS, r[9:], strict=True):
            want.setdefault((edge, kind), set()).update([item] if item else [])
    edges = {r.edge_id: (r.parent, r.child, r.rule_id) for r in merged.collect()}
    assert {edges[r.edge_id]: r.confidence for r in merged.collect()} == best
    got = {key: set() for key in want}
    expanded = P.provenance_rows(merged, sets).collect()
    for r in expanded:
        got[edges[r.edge_id], r.kind].add(r["item"])
    assert got == want and len(expanded) == sum(map(len, want.values()))
    for kind in P.KINDS:
        counts = {edges[r.edge_id]: r[f"{kind}_count"] for r in merged.collect()}
        assert counts == {edge: len(items) for (edge, k), items in want.items() if k == kind}
        stored = {}
        for r in sets.where(f"kind = '{kind}'").collect():
            stored.setdefault(r.set_id, set()).add(r["item"])
        distinct = {frozenset(items) for (_, k), items in want.items() if k == kind and items}
        assert len(stored) == len(distinct) and set(map(frozenset, stored.values())) == distinct  # each set once
    known = spark.createDataFrame([("e1",), ("e3",), ("e3",)], "evidence string")
    issues = {edges[r.subject]: r.missing for r in P.evidence_issues(merged, sets, known).collect()}
    assert issues == {edge: 1 for (edge, k), items in want.items() if k == "evidence" and "e2" in items} and issues


def test_provenance_of_nothing(spark):
    merged, sets = P.merge_provenance(spark.createDataFrame([], SCHEMA))
    assert merged.count() == sets.count() == 0
    merged, sets = P.merge_provenance(spark.createDataFrame([contribution("p", "c", "o", None, None)], SCHEMA))
    row = merged.collect()[0]
    assert (row.owner_count, row.evidence_count, row.source_count, row.evidence_set) == (1, 0, 0, None)
    assert P.evidence_issues(merged, sets, spark.createDataFrame([], "evidence string")).count() == 0


def test_wide_derived_edges_need_a_pair(spark):
    schema = "edge_id string, view string, parent string, child string, status string, source_relation string, parent_cardinality int, child_cardinality int"
    rows = [
        ("wide", "domain", "a", "b", "DERIVED", "co_classification", 2, 3),
        ("proved", "domain", "a", "c", "DERIVED", "co_classification", 2, 3),
        ("narrow", "domain", "a", "d", "DERIVED", "co_classification", 1, 3),
        ("unknown", "domain", "a", "e", "DERIVED", "co_classification", None, None),
        ("confirmed", "domain", "a", "f", "CONFIRMED", "co_classification", 2, 3),
        ("other", "domain", "a", "g", "DERIVED", "tags", 2, 3),
    ]
    pairs = spark.createDataFrame([("domain", "a", "c"), ("analysis", "a", "b")], "view string, parent string, child string")
    got = P.ambiguous_edges(spark.createDataFrame(rows, schema), pairs).collect()
    assert {r.subject for r in got} == {"wide", "unknown"} and {r.code for r in got} == {"ambiguous_derived_edge"}


def test_stored_pages(spark):
    closure = spark.createDataFrame([("domain", "t", "x", 1), ("domain", "t", "y", 1), ("domain", "t", "v", 1), ("domain", "u", "x", 1)], "view string, ancestor string, node string, depth long")
    contexts = spark.createDataFrame([("x",), ("y",), ("t",)], "path string")
    good, bad = "data://views/domain/topic/t", "data://views/domain/topic/u"
    pages = spark.createDataFrame([(good, "domain", "t"), (bad, "domain", "u"), ("t", "domain", "none"), ("data://views/analysis/w", "domain", "none")], "path string, view string, node string")
    members = spark.createDataFrame([(good, "y"), (good, "x"), (good, "x"), (bad, "y")], "path string, member string")
    got = {tuple(r) for r in P.page_issues(pages, members, closure, contexts).collect()}
    assert got == {("page_path_collision", "t"), ("view_uri_mismatch", "t"), ("view_uri_mismatch", "data://views/analysis/w"), ("aggregate_member_mismatch", bad)}
