"""Operators against brute force and known cardinalities on small fixtures."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from metaloom.functions import text as T
from metaloom.operators import branches as BR
from metaloom.operators import bundle as BU
from metaloom.operators import casebuild as CB
from metaloom.operators import classification as CL
from metaloom.operators import coverage as C
from metaloom.operators import elements as E
from metaloom.operators import evaluation as EV
from metaloom.operators import fusion as FU
from metaloom.operators import graph as G
from metaloom.operators import hierarchy as H
from metaloom.operators import identity as I
from metaloom.operators import mentions as M
from metaloom.operators import search as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("RSRP_1 弱覆盖 a"))) == ["rsrp_1", "弱覆", "覆盖", "a"]
    assert one(spark, T.tokens(F.lit("网 x"))) == ["网", "x"]
    assert one(spark, T.normalize(F.lit(" A_b-c：（D）/e".replace("：", ":")))) == "abcde"
    assert one(spark, T.slug(F.lit(" Weak  Coverage_区! "))) == "weak-coverage-区"
    assert one(spark, T.slug(F.lit("!!!"))) == "unknown"
    assert one(spark, T.token_estimate(F.lit("覆盖 abcde"))) == 4
    assert one(spark, T.billing_estimate(F.lit(""))) == 0 and one(spark, T.billing_estimate(F.lit("覆盖 abcde"))) == 4
    assert one(spark, T.split_values(F.lit("a，b; c|"))) == ["a", "b", "c"]
    assert one(spark, T.bracket_terms(F.lit("[A  b] / [c] * [A b]"))) == ["A b", "c"]
    assert one(spark, T.fact_tokens(F.lit("无线覆盖指标 kpi.x a"))) == ["kpi.x", "无线覆盖指标", "无线", "线覆", "覆盖", "盖指", "指标"]
    assert one(spark, T.percent_encode(F.lit("a b/~*"))) == "a%20b%2F~%2A"


def test_scalar_fold_equals_sequential_merge(spark):
    rng = random.Random(3)
    auth = {"formula": ("a", "b", "c")}
    rows = [("hot" if i % 3 else f"x{i % 5}", "formula", i, rng.choice("pqr"), rng.choice("abcd"), "EXPLICIT") for i in range(400)]
    df = spark.createDataFrame(rows, "ctx_id string, section string, seq long, value string, source_type string, status string")
    rank = {"a": 3, "b": 2, "c": 1}
    state, conflicts = {}, []
    for ctx, _, seq, v, s, _ in rows:
        if ctx not in state:
            state[ctx] = (v, s)
        elif state[ctx][0] != v:
            cur, src = state[ctx]
            if rank.get(s, 0) > rank.get(src, 0):
                conflicts.append((ctx, seq, v, cur, s, src))
                state[ctx] = (v, s)
            else:
                conflicts.append((ctx, seq, cur, v, src, s))
    states = FU.scalar_states(df, auth)
    got = {r["ctx_id"]: (r["value"], r["source_type"]) for r in FU.fuse_scalars(states).collect()}
    assert got == state
    cols = ["ctx_id", "seq", "kept", "discarded", "kept_source", "discarded_source"]
    assert sorted(tuple(r) for r in FU.scalar_conflicts(df, states, auth).select(*cols).collect()) == sorted(conflicts)


def test_equal_value_with_higher_rank_does_not_raise_the_bar(spark):
    rows = [("c", "formula", 1, "A", "c", "EXPLICIT"), ("c", "formula", 2, "A", "a", "EXPLICIT"), ("c", "formula", 3, "B", "b", "EXPLICIT")]
    df = spark.createDataFrame(rows, "ctx_id string, section string, seq long, value string, source_type string, status string")
    assert FU.fuse_scalars(FU.scalar_states(df, {"formula": ("a", "b", "c")})).first()["value"] == "B"


@pytest.mark.parametrize("parents,children,supported,pairs", [(1, 3, 0, 3), (3, 1, 0, 3), (2, 2, 0, 0), (2, 2, 2, 2)])
def test_co_classification_guard(spark, parents, children, supported, pairs):
    rows = [("m", "domain", 2, "topic-domain", f"P{i}") for i in range(parents)] + [("m", "domain", 3, "topic", f"C{i}") for i in range(children)]
    nodes = spark.createDataFrame(rows, "owner string, view string, step int, kind string, node string")
    sup = spark.createDataFrame([("domain", f"P{i}", f"C{i}") for i in range(supported)], "view string, parent string, child string")
    assert H.co_classification(nodes, sup).count() == pairs


def test_greedy_rerank_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(q, f"p{i}", rng.random(), i < 3, rng.choice("ABC"), rng.sample(["a", "b", "c", "d"], 2), rng.randrange(10, 900)) for q in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, path string, score double, is_seed boolean, context_type string, aspects array<string>, l1_length int")
    got = defaultdict(list)
    for r in BU.greedy_rerank(df).orderBy("query_id", "position").collect():
        got[r["query_id"]].append(r["path"])
    for q in (1, 2):
        pool, out, cov, kinds = [r for r in rows if r[0] == q], [], set(), set()
        top = max(r[2] for r in pool)
        while pool:
            if out:
                pick = max(pool, key=lambda r: (r[2] / top + 0.18 * len(set(r[5]) - cov) / (1 + math.log1p(r[6]) / 10) + 0.12 * (r[4] not in kinds), r[1]))
            else:
                pick = max(pool, key=lambda r: (r[3], r[2] / top, r[1]))
            pool.remove(pick)
            out.append(pick[1])
            cov |= set(pick[5])
            kinds.add(pick[4])
        assert got[q] == out


def test_budget_prefers_l1_then_l0_and_lets_smaller_items_in(spark):
    rows = [(1, "a", 1, "m", 50, 10, False), (1, "b", 2, "m", 60, 40, False), (1, "c", 3, "m", 30, 5, True), (1, "d", 4, "d", 45, 9, False), (1, "e", 5, "m", 9, 2, False)]
    df = spark.createDataFrame(rows, "query_id long, path string, position long, context_type string, l1_tokens long, l0_tokens long, seen boolean")
    got = [(r["path"], r["level"], r["tokens"]) for r in BU.budgeted_select(df, 8, 100, 2).orderBy("position").collect()]
    assert got == [("a", "L1", 50), ("b", "L0", 40), ("d", "L0", 9)]


def test_mentions_respect_identifier_borders(spark):
    q = spark.createDataFrame([(1, "RSRP and weak coverage, x_rsrp"), (2, "preweak coverage 弱覆盖分析"), (3, "a")], "query_id long, text string")
    keys = spark.createDataFrame([("rsrp", "page", "m1", "metric"), ("weak coverage", "page", "p1", "purpose"), ("弱覆盖", "page", "p2", "purpose"), ("a", "page", "z", "x")], "key string, source string, target string, kind string")
    got = {(r["query_id"], r["target"]) for r in M.resolve_mentions(q, keys).collect()}
    assert got == {(1, "m1"), (1, "p1"), (2, "p2"), (3, "z")}


def test_bounded_reads_charge_rejected_members(spark):
    pages = spark.createDataFrame([(f"p{i:03d}", f"n{i}", "common", "", "EXPLICIT", f"c{i}") for i in range(30)], "path string, name string, l0 string, l1 string, identity_status string, canonical_id string")
    q = spark.createDataFrame([(1, "common")], "query_id long, text string")
    index = S.build_index(pages)
    allowed = spark.createDataFrame([(1, "p004"), (1, "p020")], "query_id long, path string")
    assert [r["path"] for r in S.bounded_candidates(index, q, 10, allowed).collect()] == ["p004"]


def test_identifier_gate_and_governed_facets(spark):
    pages = spark.createDataFrame(
        [("a", "RSRP", "metric", "", "about RSRP_AVG", "EXPLICIT", "m:a", None), ("b", "Model", "physical-model", "", "x", "EXPLICIT", "m:b", "SDL"), ("c", "Other", "physical-model", "", "RSRP_AVG", "EXPLICIT", "m:c", "ODS"),
         ("d", "Hidden", "metric", "", "RSRP_AVG", "CANDIDATE", "m:d", None)],
        "path string, name string, context_type string, l0 string, l1 string, identity_status string, canonical_id string, layer string",
    )
    kept = S.identifier_gate(S.eligible_pages(pages, scope={"layer": "sdl"}), "RSRP_AVG")
    assert [r["path"] for r in kept.collect()] == ["a"]


def test_elements_drop_untrusted_parts(spark):
    rows = [("p", "EXPLICIT", "joins", 0, '{"left_key":"a","right":{"name":"b","status":"CANDIDATE"}}', "EXPLICIT", True), ("p", "EXPLICIT", "grain", 0, "day", "EXPLICIT", False),
            ("p", "EXPLICIT", "joins", 1, '{"status":"INFERRED","key":"z"}', "EXPLICIT", True)]
    df = spark.createDataFrame(rows, "path string, identity_status string, section string, offset int, value string, status string, is_json boolean")
    got = {(r["section"], r["value"], r["kind"]) for r in E.build_elements(df).collect()}
    assert got == {("joins", '{"left_key": "a"}', "JoinKey"), ("grain", '"day"', "ContextElement")}


def test_find_paths_equals_depth_first_search(spark):
    rng = random.Random(2)
    edges = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(26)})
    edges = [(f"e{i}", a, b, round(rng.random(), 3), rng.random() < 0.3) for i, (a, b) in enumerate(edges) if a != b]
    df = spark.createDataFrame(edges, "edge_id string, src string, dst string, confidence double, inferred boolean")
    starts, targets = spark.createDataFrame([("n0",), ("n1",)], "id string"), spark.createDataFrame([("n5",)], "id string")
    got = sorted((r["start"], r["nodes"], r["score"]) for r in G.find_paths(df, starts, targets, max_depth=4, limit=50).collect())
    want = []

    def walk(start, at, nodes, used):
        if used and at == "n5":
            mean = sum(e[3] for e in used) / len(used)
            want.append((start, ">".join(nodes), round(mean - 0.1 * sum(e[4] for e in used) - 0.01 * len(used), 4)))
            return
        if len(used) == 4:
            return
        for e in edges:
            nxt = e[2] if e[1] == at else e[1] if e[2] == at else None
            if nxt and nxt not in nodes:
                walk(start, nxt, nodes + [nxt], used + [e])

    for s in ("n0", "n1"):
        walk(s, s, [s], [])
    best = defaultdict(list)
    for w in want:
        best[w[0]].append(w)
    if all(len(v) <= 50 for v in best.values()):
        assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in want)
        assert all(abs(x[2] - y[2]) < 2e-4 for x, y in zip(got, sorted(want)))


def test_two_hop_completion_is_capped(spark):
    edges = spark.createDataFrame([("s", "uses_metric", f"m{i}") for i in range(9)] + [("m0", "supported_by", "t")], "src string, relation string, dst string")
    seeds = spark.createDataFrame([(1, "s", 1.0, 1)], "query_id long, path string, score double, position long")
    allowed = spark.createDataFrame([(f"m{i}",) for i in range(9)] + [("t",)], "path string")
    rows = G.complete_bundles(seeds, edges, allowed, "analysis_data_requirement", top_k=1).collect()
    assert len(rows) == 8 and all(abs(r["score"] - 0.75) < 1e-9 for r in rows if r["reason"] != "seed")


def test_fragment_groups_follow_long_chains(spark):
    links = [(i, f"k{i}") for i in range(40)] + [(i, f"k{i + 1}") for i in range(39)] + [(100, "z"), (101, "z")]
    got = {r["seq"]: r["group"] for r in I.group_fragments(spark.createDataFrame(links, "seq long, key string")).collect()}
    assert set(got.values()) == {0, 100} and got[39] == 0 and got[101] == 100


def test_coverage_declarations_need_authority(spark):
    reqs = spark.createDataFrame([("r1", "p", "p", "grain", "REFERENCE", None), ("r2", "q", "q", "grain", "REFERENCE", None)], "req_id string, entity string, entity_name string, aspect string, layer string, selector string")
    cols = "path string, aspect string, section string, status string, conflicted boolean, truncated boolean, coverage_status string, authoritative boolean, complete boolean, selector string, reason string"
    facts = spark.createDataFrame([("p", "grain", "grain", "EXPLICIT", False, False, "MISSING", True, False, None, "why"), ("q", "grain", "grain", "EXPLICIT", False, False, "MISSING", True, True, None, "why")], cols)
    rel = spark.createDataFrame([], "src string, relation string, dst string")
    got = {r["req_id"]: r["status"] for r in C.assess(reqs, C.proofs(reqs, facts, rel)).collect()}
    assert got == {"r1": "UNKNOWN", "r2": "MISSING"}


def test_classification_statuses(spark):
    rows = [(1, "DWD", "Performance", "Wireless Coverage"), (2, "SDL", "规划", "楼宇"), (3, "", None, None), (4, "ADS", "free", "text")]
    got = {r["id"]: (r["layer"], r["topic"], r["status"], r["issues"]) for r in CL.classify(spark.createDataFrame(rows, "id int, layer_raw string, domain_raw string, topic_raw string")).collect()}
    assert got[1] == ("SDL", "无线覆盖", "NORMALIZED", "")
    assert got[2] == ("SDL", None, "REVIEW", "topic_catalog_incomplete")
    assert got[3][3] == "missing_model_layer" and got[4] == ("ADS", "text", "VALID", "")


def test_view_arbitration_prior_breaks_ties_only(spark):
    ranked = spark.createDataFrame([(1, "analysis", "a", 0.5, 1), (1, "domain", "d", 0.5, 1), (1, "asset", "x", 0.1, 1)], "query_id long, view string, path string, score double, rank long")
    first = spark.createDataFrame([(1, "domain")], "query_id long, view string")
    got = [r["view"] for r in BR.arbitrate_views(ranked, first).orderBy("position").collect()]
    assert got == ["domain", "analysis"]


def test_discover_adds_for_repeated_branches(spark):
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, path string, score double")
    hits = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "a", 2), (1, 1, "b", 2)], "query_id long, branch_rank long, path string, rank long")
    got = {r["path"]: round(r["score"], 6) for r in BR.discover(seeds, hits).collect()}
    assert got == {"a": 1.4, "b": 0.95}


def test_nearby_and_paths_on_a_hub(spark):
    rec = [(f"r{i:02d}", "hub", f"l{i}") for i in range(20)] + [("r99", "l0", "deep")]
    df = spark.createDataFrame(rec, "evidence_id string, subject string, object string")
    got = sorted(r["evidence_id"] for r in CB.nearby_records(df, spark.createDataFrame([("deep",)], "id string"), k=3).collect())
    assert got == ["r00", "r01", "r02"]
    starts = spark.createDataFrame([("deep",)], "id string")
    assert {r["signature"] for r in CB.path_motifs(df, starts, 3, 3, 100).collect()} == {f"r00|r{i:02d}|r99" for i in range(1, 20)}


def test_long_paths_equal_depth_first_search(spark):
    edges = [(f"r{i}", *e) for i, e in enumerate([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 2), (1, 2), (6, 5), (6, 7)])]
    starts = [0, 6, 9]
    want = {}

    def walk(start, at, nodes, used):
        if 3 <= len(used) <= 6:
            key = "|".join(sorted(used))
            want[key] = min(want.get(key, ("z",)), (str(start), str(at), len(used)))
        for e, a, b in edges if len(used) < 6 else []:
            for x, y in ((a, b), (b, a)):
                if x == at and y not in nodes:
                    walk(start, y, [*nodes, y], [*used, e])

    for s in starts:
        walk(s, s, [s], [])
    assert {v[2] for v in want.values()} == {3, 4, 5, 6}
    df = spark.createDataFrame([(e, str(a), str(b)) for e, a, b in edges], "evidence_id string, subject string, object string")
    got = CB.path_motifs(df, spark.createDataFrame([(str(s),) for s in starts], "id string")).collect()
    assert {r["signature"]: (r["start"], r["end"], r["edges"]) for r in got} == want


def test_diverse_sample_respects_caps(spark):
    rows = [(f"c{i}", "A" if i < 4 else "B", f"query {i}", [f"t{i % 3}"], [f"e{i % 2}"], ["d"], [], f"m{i % 2}") for i in range(8)]
    df = spark.createDataFrame(rows, "case_id string, category string, query string, traits array<string>, entities array<string>, source_documents array<string>, topics array<string>, motif string")
    got = CB.sample_diverse(df, 6, {"entity": 2, "document": 3}, {"A": 2, "B": 2}).orderBy("pick").collect()
    assert [r["case_id"] for r in got][:2] == ["c0", "c4"] and len(got) == 3


def test_usage_disagreement_is_unknown(spark):
    rows = [(1, "a", 5, 2), (1, "a", 5, 2), (1, "b", 1, 1), (2, "a", 5, 2), (2, "a", 6, 2), (3, "a", None, 1)]
    got = {r["run"]: r["total_tokens"] for r in EV.token_usage(spark.createDataFrame(rows, "run int, call_id string, input_tokens long, output_tokens long")).collect()}
    assert got == {1: 9, 2: None, 3: None}


def test_hierarchies_of_any_depth(spark):
    n = 37
    edges = [("v", f"n{i:02d}", f"n{i + 1:02d}", True) for i in range(n)] + [("v", "n05", "n09", True), ("w", "a", "b", True), ("w", "b", "a", True)]
    active = spark.createDataFrame(edges, "view string, parent string, child string, active boolean")
    got = {(r.view, r.ancestor, r.node): r.depth for r in H.closure(active).collect()}
    for i in range(n):
        for j in range(i + 1, n + 1):
            assert got["v", f"n{i:02d}", f"n{j:02d}"] == j - i - (3 if i <= 5 and j >= 9 else 0)
    assert got["w", "a", "b"] == got["w", "b", "a"] == 1
    nodes = spark.createDataFrame([(f"n{i:02d}", f"N{i}", False) for i in range(n + 1)], "path string, name string, virtual boolean")
    chain = active.where("view = 'v' AND NOT (parent = 'n05' AND child = 'n09')")
    assert {r.node: r.depth for r in H.breadcrumbs(chain, nodes).collect()} == {f"n{i:02d}": i + 1 for i in range(n + 1)}
    assert {(r.view, r.node) for r in H.cyclic_nodes(active).collect()} == {("w", "a"), ("w", "b")}


def test_diverse_sample_equals_plain_greedy(spark, monkeypatch):
    monkeypatch.setattr(CB, "SAMPLE_BATCH", 7)
    rnd = random.Random(12)
    rows = [
        (f"c{i:03d}", rnd.choice("AB"), f"query {rnd.randrange(70)}", sorted({rnd.choice("pqrstuvw") for _ in range(3)}), [rnd.choice("xyz")], [rnd.choice("de")], [], rnd.choice("mn"))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "case_id string, category string, query string, traits array<string>, entities array<string>, source_documents array<string>, topics array<string>, motif string")
    caps, targets = {"entity": 5, "document": 6, "motif": 7}, {"A": 4, "B": 5}
    left, order = list(rows), []
    while left and len(order) < 11:
        used = [r for r in rows if r[0] in order]
        count = lambda i, v: sum(v in (r[i] if isinstance(r[i], list) else [r[i]]) for r in used)
        fits = [r for r in left if all(count(4, v) < 5 for v in r[4]) and all(count(5, v) < 6 for v in r[5]) and count(7, r[7]) < 7 and r[2] not in {u[2] for u in used}]
        if not fits:
            break
        seen = {t for r in used for t in r[3]}
        best = min(fits, key=lambda r: (-round(len(set(r[3]) - seen) + 5 * max(0.0, 1 - count(1, r[1]) / targets[r[1]]), 9), r[0]))
        order.append(best[0])
        left.remove(best)
    assert [r.case_id for r in CB.sample_diverse(df, 11, caps, targets).orderBy("pick").collect()] == order


def test_exact_search_scores_every_page_that_shares_a_word(spark):
    words = ["alpha", "beta", "gamma", "delta", "common"]
    rnd = random.Random(3)
    pages = [(f"p{i:03d}", "metric", f"name{i}", f"id{i}", "", " ".join(rnd.choice(words) for _ in range(12)) + " common", "EXPLICIT", [f"alias{i}"]) for i in range(150)]
    pg = spark.createDataFrame(pages, "path string, context_type string, name string, canonical_id string, l0 string, l1 string, identity_status string, aliases array<string>")
    index = S.build_index(pg)
    queries = spark.createDataFrame([("a", "common alpha"), ("b", "alias7")], "query_id string, text string")
    assert S.score_all(index, queries).groupBy("query_id").count().collect() and S.score_all(index, queries).where("query_id = 'a'").count() == 150
    assert [r.path for r in S.search_many(index, queries).where("query_id = 'b'").collect()] == ["p007"]
    assert [r.path for r in S.exact_channel(S.eligible_pages(pg), "alias7").collect()] == ["p007"]
    listed = pg.withColumn("topic_domain", F.array(F.lit("Radio"), F.lit("Core")))
    assert S.facet_channel(S.eligible_pages(listed), {"topic_domain": "core"}).count() == 150
