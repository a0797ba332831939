"""Steps whose work must not grow faster than their input."""

import collections
import random

from metaloom.operators import binding as B
from metaloom.operators import branches as BR
from metaloom.operators import casebuild as CB
from metaloom.operators import graph as G
from metaloom.operators import hierarchy as H
from metaloom.operators import identity as ID
from metaloom.operators import inference as N
from metaloom.operators import search as S


def _watch(monkeypatch, module):
    calls, join = [], module.salted_join

    def watched(left, right, *args, **kwargs):
        calls.append((left, right))
        return join(left, right, *args, **kwargs)

    monkeypatch.setattr(module, "salted_join", watched)
    return calls


def test_path_search_reads_its_edges_once(spark, tmp_path, monkeypatch):
    rows = [("e1", "a", "m", 0.5, False), ("e2", "a", "m", 0.9, True), ("e3", "m", "z", 0.7, False), ("e4", "b", "a", 0.1, False), ("e5", "y", "z", 0.1, False)]
    spark.createDataFrame(rows, "edge_id string, src string, dst string, confidence double, inferred boolean").write.parquet(f"{tmp_path}/edges")
    calls = _watch(monkeypatch, G)
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    found = G.find_paths(spark.read.parquet(f"{tmp_path}/edges"), ids("a", "b"), ids("z"), max_depth=3)
    got = {(r["start"], r["nodes"], r["hops"], r["score"]) for r in found.collect()}
    # Two edges between the same nodes are two paths.
    assert got == {("a", "a>m>z", 2, 0.58), ("a", "a>m>z", 2, 0.68), ("b", "b>a>m>z", 3, 0.4033), ("b", "b>a>m>z", 3, 0.4367)} and len(found.collect()) == 4
    assert calls and not any(f"{tmp_path}/edges" in f for left, _ in calls for f in left.inputFiles())


def test_hints_meet_one_row_per_value(spark, monkeypatch):
    hints = [("t", "h", "Shared", f"c{i}") for i in range(50)] + [("t", "h", "own", "c7"), ("t", "h", "OWN", "c7"), ("t", "n", "9", None)]
    known = spark.createDataFrame(hints, "context_type string, hint string, value string, path string")
    asked = [(1, "t", "h", "shared"), (2, "t", "h", "own"), (3, "t", "n", "9"), (4, "t", "h", None), (5, "t", "h", "own"), (5, "t", "h", "shared")]
    calls = _watch(monkeypatch, ID)
    got = ID.lookup_hints(spark.createDataFrame(asked, "id int, context_type string, hint string, value string"), known).collect()
    assert [tuple(r) for r in got] == [(2, "c7")]
    assert calls[0][1].count() == 3


def test_nearby_records_travel_to_anchors_only_in_the_last_hop(spark, monkeypatch):
    rows = [(f"r{i:02d}", f"p{i % 5}", f"s{i % 4}") for i in range(20)] * 2 + [("r99", "p0", None)]
    near = {}
    for _, s, o in rows:
        if o:
            near.setdefault(s, set()).add(o)
            near.setdefault(o, set()).add(s)
    one = {"s1"} | near["s1"]
    two = one | {b for a in one for b in near[a]}
    want = sorted({e for e, s, o in rows if s in two or o in two})[:3]
    calls = _watch(monkeypatch, CB)
    records = spark.createDataFrame(rows, "evidence_id string, subject string, object string")
    got = CB.nearby_records(records, spark.createDataFrame([("s1",)], "id string"), k=3, depth=2).collect()
    assert sorted(r["evidence_id"] for r in got) == want and len(got) == 3
    assert {r["node"] for r in calls[-1][0].collect()} == {"s1"}


def test_cases_are_made_once(spark, tmp_path, monkeypatch):
    rows = [("o:1", "supported_by", "s:1"), ("o:1", "supported_by", "s:2"), ("c:1", "requires_metric", "o:1"), ("s:1", "belongs_to_object", "n:1")]
    spark.createDataFrame(rows, "source string, relation string, target string").write.parquet(f"{tmp_path}/edges")
    kinds = {"c": "purposes", "o": "metrics", "s": "physical_models", "n": "business_objects"}
    ids = ("c:1", "o:1", "s:1", "s:2", "n:1")
    entities = spark.createDataFrame([(i, kinds[i[0]], f"name {i}") for i in ids], "id string, type string, name string")
    documents = spark.createDataFrame([("o:1", "a"), ("o:1", "b"), ("s:1", "a"), ("c:1", None)], "id string, document string")
    calls = _watch(monkeypatch, CB)
    edges = spark.read.parquet(f"{tmp_path}/edges")
    cases = CB.motif_cases(CB.motifs(edges, entities), entities, documents)
    got = {(r["category"], r["anchor"]): (r["hops"], r["edges"], r["documents"], r["difficulty"]) for r in cases.collect()}
    assert got == {
        ("metric_to_model", "o:1"): (1, 2, 2, "medium"), ("purpose_to_data", "c:1"): (2, 3, 3, "hard"), ("model_to_analysis", "s:1"): (2, 2, 3, "hard"),
        ("model_to_analysis", "s:2"): (2, 2, 3, "hard"), ("model_to_business", "s:1"): (1, 1, 1, "easy"),
    }
    inputs = [f for frame in (cases, CB.describe_cases(cases), *[left for left, _ in calls]) for f in frame.inputFiles()]
    assert inputs and not any(f"{tmp_path}/edges" in f for f in inputs)


def test_chains_read_their_records_once(spark, tmp_path, monkeypatch):
    rows = [("r1", "o1", "a"), ("r2", "o1", "b"), ("r3", "o2", "b"), ("r4", "o2", "c"), ("r5", "o2", None)]
    spark.createDataFrame(rows, "evidence_id string, subject string, object string").write.parquet(f"{tmp_path}/records")
    calls = _watch(monkeypatch, CB)
    starts = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = CB.path_motifs(spark.read.parquet(f"{tmp_path}/records"), starts, low=2, high=4).collect()
    ends = {r["signature"]: (r["start"], r["end"], r["edges"]) for r in got}
    assert ends["r1|r2"] == ("a", "b", 2) and ends["r3|r4"] == ("b", "c", 2) and ends["r1|r2|r3|r4"] == ("a", "c", 4) and len(got) == len(ends)
    assert calls and not any(f"{tmp_path}/records" in f for left, _ in calls for f in left.inputFiles())


def test_closure_shuffles_no_leaves_upwards(spark, monkeypatch):
    rows = [("v", f"n{i // 2}", f"n{i}", True) for i in range(2, 40)] + [("v", "n3", "n20", True), ("v", "n39", "x", False), ("v", "c", "d", True), ("v", "d", "c", True)]
    want, frontier = {}, [(p, c, 1) for _, p, c, on in rows if on]
    below = {}
    for _, p, c, on in rows:
        if on:
            below.setdefault(p, []).append(c)
    while frontier:
        a, n, d = frontier.pop(0)
        if a != n and want.get((a, n), d + 1) > d:
            want[a, n] = d
            frontier += [(a, c, d + 1) for c in below.get(n, [])]
    calls = _watch(monkeypatch, H)
    got = H.closure(spark.createDataFrame(rows, "view string, parent string, child string, active boolean"))
    assert {(r["ancestor"], r["node"]): r["depth"] for r in got.collect()} == want and got.count() == len(want)
    met = [right for left, right in calls if "top" in right.columns]
    assert met and all(r["ancestor"] in below for right in met for r in right.collect())


def test_bindings_of_a_shared_key_are_neither_grouped_nor_listed_to_confirm(spark):
    kind = "asset_id string, type string, reference_path string, identity_namespace string, stable_id string, strong_key string"
    assets = [(f"a{i}", "m", "r1" if i == 1 else None, "n", "k", f"s.{i}") for i in range(30)]
    assets += [("one", "m", None, "n", "own", "s.99"), ("two", "m", "r3", "n", " ", None), ("twice", "m", None, "n", "t1", None), ("twice", "m", None, "n", "t2", "s.77"), (None, "m", "r9", "n", "z", None), ("sole", "m", None, "n", "z2", None)]
    refs = [(f"r{i}", "m", "n", "e", "k" if i < 20 else None, f"s.{i}", i != 7) for i in range(30)]
    refs += [("own", "m", "n", "e", "own", "s.99", True), ("t", "m", "n", "e", "t1", "s.77", True), ("t", "m", "n", "e", "t2", None, True), ("r9", "m", "n", "e", "z", None, True), (None, "m", "n", "e", "z2", None, True), ("z2", "m", "n", "e", "z2", None, True)]
    want = {}
    for a, at, ref, ns, stable, strong in assets:
        for p, pt, pn, _, other, key, explicit in refs:
            same = at == pt and ns == pn and explicit
            orders = [1] * (ref is not None and ref == p and at == pt) + [2] * (same and stable == other and stable is not None and stable.strip() != "") + [3] * (same and strong == key and strong is not None)
            if orders:
                want[a, p] = min(orders + [want.get((a, p), 9)])
    sole = {k for k in want if sum(k[0] == a for a, _ in want) == 1 and sum(k[1] == p for _, p in want) == 1 and None not in k}
    frames = spark.createDataFrame(assets, kind), spark.createDataFrame(refs, "path string, type string, identity_namespace string, environment_id string, stable_id string, strong_key string, explicit_identity boolean")
    rules = {"provider_explicit_crosswalk/v3": 1, "same_type_scoped_stable_id/v3": 2, "same_type_scoped_strong_key/v3": 3}
    got = B.identity_bindings(*frames, "e").collect()
    assert {(r["asset_id"], r["path"]): rules[r["rule"]] for r in got} == {k: v for k, v in want.items() if None not in k} and len(got) == sum(None not in k for k in want)
    assert {(r["asset_id"], r["path"]) for r in got if r["confirmed"]} == sole
    assert {(r["asset_id"], r["path"]) for r in B.confirmed_bindings(*frames, "e").collect()} == sole and ("one", "own") in sole


def test_literals_travel_as_digests(spark):
    rows = [(1, " Alpha  beta"), (1, None), (2, "gamma"), (3, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (None, "x")]
    entities = spark.createDataFrame(rows, "id long, name string")
    units = spark.createDataFrame([("d", "ALPHA beta "), ("d", "ALPHA beta "), ("e", "gamma"), (None, "x")], "document string, literal string")
    cited = spark.createDataFrame([(1, "d"), (2, "d"), (3, None), (4, "d"), (4, "e"), (None, "d")], "id long, document string")
    found = CB.verify_literals(entities, units, cited)
    assert {(r["id"], r["located"]) for r in found.collect()} == {(1, True), (2, False), (3, False), (4, True), (None, False)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "digest" in plan and "hashpartitioning(document" in plan and "key#" not in plan


def test_targets_are_scored_in_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_SOURCES", 4)
    monkeypatch.setattr(N, "CELL_TARGETS", 8)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    page = lambda side, i: (f"{side}{i:02d}", rnd.choice(["metric", "model", None]), rnd.choice([f"s{i}", "Same", None]), " ".join(rnd.choices(words, k=rnd.randrange(14))), rnd.choice(["X", "x", "y", None]))
    sources, targets = [page("s", i) for i in range(11)], [page("t", i) for i in range(40)]
    sources, targets = [*sources, sources[0]], [*targets, targets[1], targets[1]]
    explicit = [("s01", "same"), ("s01", "SAME"), ("s02", "s7"), ("zz", "same")]
    want, kind = collections.Counter(), {t[0]: t[1] for t in targets}
    terms, bonus = collections.Counter(), collections.Counter()
    for t in targets:
        for s in sources:
            terms[s[0], t[0]] += len(set(s[3].split()) & set(t[3].split()))
            bonus[s[0], t[0]] += 15 * (s[4] is not None and t[4] is not None and s[4].lower() == t[4].lower())
        for path, name in {(p, n.lower()) for p, n in explicit if any(p == s[0] for s in sources)}:
            bonus[path, t[0]] += 35 * (t[2] is not None and t[2].lower() == name)
    times = collections.Counter(t[0] for t in targets)
    groups = collections.defaultdict(list)
    for pair in terms:
        score = min(100, min(60, 6 * terms[pair]) + bonus[pair])
        if score:
            groups[pair[0], kind[pair[1]]] += [(-score / 100, pair[1])] * times[pair[1]]
    want = sorted((s, str(k), p, -v, n) for (s, k), g in groups.items() for n, (v, p) in enumerate(sorted(g)[:5], 1))
    schema = "path string, context_type string, name string, text string, facet string"
    ranked = N.rank_targets(spark.createDataFrame(sources, schema), spark.createDataFrame(targets, schema), spark.createDataFrame(explicit, "path string, name string"), ["facet"], top=5)
    assert sorted((r["source"], str(r["context_type"]), r["path"], r["score"], r["rank"]) for r in ranked.collect()) == want


def test_members_of_branches_are_scored_in_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choices(["in", *[f"w{i}" for i in range(12)]], k=n))
    pages = [(f"p{i:02d}", f"p{i}", text(4), text(9), "EXPLICIT") for i in range(30)]
    pages = spark.createDataFrame([*pages, pages[0]], "path string, name string, l0 string, l1 string, identity_status string")
    index = S.build_index(pages)
    queries = spark.createDataFrame([(q, text(3)) for q in range(6)], "query_id long, text string")
    chosen = spark.createDataFrame([(q, f"b{(q + n) % 4}", n) for q in range(6) for n in range(1, 3)], "query_id long, branch string, branch_rank long")
    members = spark.createDataFrame([(f"b{b}", f"p{i:02d}") for b in range(4) for i in range(30) if i % (b + 2) == 0] + [("b1", "p03")], "branch string, path string")
    monkeypatch.setattr(BR, "ENTITY_CANDIDATE_K", 4)
    assert S.top_in_groups(index, queries, chosen, members, 4) is not None
    got = {tuple(r) for r in BR.branch_entities(index, queries, chosen, members).collect()}
    monkeypatch.setattr(S, "top_in_groups", lambda *args: None)
    assert got == {tuple(r) for r in BR.branch_entities(index, queries, chosen, members).collect()} and len(got) > 30


def test_fusion_counts_the_pages_before_its_heads(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    pages = [(f"p{i:03d}", "page", text(3), text(rnd.randrange(1, 9)), "EXPLICIT") for i in range(160)]
    pages += [*pages[5:9], ("q1", "page", "seldom", "", "EXPLICIT"), (None, "page", text(3), "", "EXPLICIT")]
    index = S.build_index(spark.createDataFrame(pages, "path string, name string, l0 string, l1 string, identity_status string"))
    asked = [(q, text(rnd.randrange(2, 6))) for q in range(8)] + [(8, "seldom"), (9, "nowhere"), (0, "w1"), (None, "w2 w3")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    key = lambda rows: sorted(map(str, rows.collect()))
    got, want = S.fuse_all(index, queries, 5), S.fuse_many({"bm25": S.score_all(index, queries), "facet": S.overlap_all(index, queries)}, ["query_id"], 5)
    assert key(got) == key(want) and got.where("query_id = 8").count() == 1
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
