"""Searches of the stored block index against those that read the texts, and exact against budgeted serving."""

import random

import pytest
from pyspark.sql import functions as F

from metaloom.operators import blockindex as BX
from metaloom.operators import branches as BR
from metaloom.operators import elements as E
from metaloom.operators import mentions as M
from metaloom.operators import search as S

PAGE = "path string, canonical_id string, context_type string, name string, aliases array<string>, topic_domain string, layer string, l0 string, l1 string, identity_status string"
WORDS = [f"w{i}" for i in range(40)] + ["弱覆盖", "rsrp", "packet loss", "cell_id"]


def corpus(n=90):
    rnd = random.Random(8)
    # Few common and many rare words, equal texts, empty texts.
    text = lambda k: " ".join(WORDS[min(int(rnd.expovariate(0.12)), len(WORDS) - 1)] for _ in range(k))
    rows = []
    for i in range(n):
        body = "" if i % 17 == 5 else rows[-1][8] if i % 13 == 7 else text(rnd.randrange(1, 60))
        kind = ("metric", "physical-model", "logical-model")[i % 3]
        rows.append((f"p{i:03d}", f"c:{i}", kind, f"Page W{i % 9}", [f"alias {i % 5}"] if i % 2 else None, f"d{i % 4}", f"l{i % 2}", body[:20], body, "CANDIDATE" if i % 19 == 3 else "EXPLICIT"))
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(corpus(), PAGE)


@pytest.fixture(scope="module")
def index(pages):
    small = pytest.MonkeyPatch()
    small.setattr(BX, "RANGE_BITS", 2)
    yield BX.build_blocks(pages)
    small.undo()


def rows_of(df):
    return [tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in df.collect()]


@pytest.mark.parametrize("query, k", [("w0 w3 w30", 5), ("w39 w38", 4), ("nothing here", 3), ("w0 w1 w2 弱覆盖", 200)])
def test_bm25_equals_scan(pages, index, monkeypatch, query, k):
    monkeypatch.setattr(BX, "FIRST_RANGES", 2)
    want = S.bm25_channel(pages, query).orderBy(F.desc("score"), "path").limit(k)
    assert sorted(rows_of(BX.bm25_topk(index, query, k))) == sorted(rows_of(want))


@pytest.mark.parametrize("query, scope", [("page w3 with w0 w1 rsrp", {"topic_domain": "d1", "technology": "x"}), ("alias 2 w5", {}), ("CELL_ID", {"symbol": "cell_id", "layer": "l1"}), ("zzz", None)])
@pytest.mark.parametrize("head", [2, 64])
def test_hybrid_equals_scan(pages, index, monkeypatch, query, scope, head):
    monkeypatch.setattr(BX, "CHANNEL_HEAD", head)
    got = rows_of(BX.hybrid_top(index, query, scope=scope, top_k=6 if head > 2 else 1))
    assert got == rows_of(S.hybrid_search(pages, query, scope=scope, top_k=6 if head > 2 else 1))


@pytest.mark.parametrize("query, scope", [("w0 w0 w7", {"topic_domain": "d2", "technology": "w1"}), ("alias 3", {"technology": "packet loss"}), ("", {"layer": "l0"})])
def test_baseline_equals_scan(pages, index, query, scope):
    assert rows_of(BX.baseline_topk(index, query, scope=scope, top_k=12, pages=pages)) == rows_of(S.baseline_search(pages, query, scope=scope, top_k=12))


def test_gate_and_index_tables_equal_scan(spark, pages, index):
    got = sorted(r.path for r in BX.gate(index, index.docs, "CELL_ID").select("path").collect())
    assert got == sorted(r.path for r in S.identifier_gate(S.indexable(pages), "CELL_ID").select("path").collect())
    stored, scanned = index.as_page_index(pages), S.build_index(pages, materialize=False)
    assert sorted(rows_of(stored.postings)) == sorted(rows_of(scanned.postings))
    queries = spark.createDataFrame([(1, "w0 w3"), (2, "弱覆盖 w9")], "query_id long, text string")
    assert sorted(rows_of(S.search_many(stored, queries))) == sorted(rows_of(S.search_many(scanned, queries)))
    with pytest.raises(ValueError, match="texts"):
        BX.pages_holding(index, "packet loss")


def test_empty_index(spark):
    none = BX.build_blocks(spark.createDataFrame([], PAGE))
    assert none.n == 0 and BX.bm25_topk(none, "w0", 3).count() == BX.hybrid_top(none, "w0", scope={"layer": "l1"}).count() == BX.baseline_topk(none, "w0").count() == 0


ELEMENT = "element_id string, path string, section string, texts array<string>, names array<string>"


def test_element_search_is_exact_without_a_budget(spark):
    els = spark.createDataFrame([(f"e{i:03d}", f"p{i % 7}", "important_fields", [f"common field{i}"], [f"name {i}"]) for i in range(300)], ELEMENT)
    queries = spark.createDataFrame([(1, "common field299"), (2, "Name 7"), (3, "absent")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): (r.element_id, r.score, r.match) for r in E.search_elements(els, queries, top_k=2).collect()}
    assert got == {(1, 1): ("e299", 1.0, "TEXT"), (1, 2): ("e000", 0.5, "TEXT"), (2, 1): ("e007", 2.0, "EXACT_IDENTIFIER")}
    cut = E.search_elements(els, queries, top_k=2, limit=100).collect()
    assert {(r.query_id, r["rank"], r.element_id, r.truncated) for r in cut} == {(1, 1, "e000", True), (1, 2, "e001", True), (2, 1, "e007", False)}


def test_mentions_are_whole_without_a_budget(spark):
    keys = spark.createDataFrame([("shared alias", "page", f"t{i:03d}", "metric") for i in range(150)] + [("sym", "page", "s", "metric")], "key string, source string, target string, kind string")
    queries = spark.createDataFrame([(1, "the Shared Alias and sym"), (2, "sym")], "query_id long, text string")
    assert M.resolve_mentions(queries, keys).groupBy("query_id").count().orderBy("query_id").collect() == [(1, 151), (2, 1)]
    some = M.resolve_mentions(queries, keys, 100).groupBy("query_id", "truncated").count().orderBy("query_id").collect()
    assert [tuple(r) for r in some] == [(1, True, 100), (2, False, 1)]


def test_branches_and_members_are_exact_without_a_budget(spark):
    branch = [("domain", f"b{i:03d}", f"branch {i}", f"c{i}", "word common", f"rare{i}", "EXPLICIT", 1.0) for i in range(40)]
    branches = spark.createDataFrame(branch, "view string, path string, name string, canonical_id string, l0 string, l1 string, identity_status string, quality double")
    queries = spark.createDataFrame([(1, "common word rare39")], "query_id long, text string")
    assert {r.path for r in BR.rank_branches(queries, branches, top_k=50).collect()} == {b[1] for b in branch}
    few = BR.rank_branches(queries, branches, top_k=50, limit=5).collect()
    assert {r.path for r in few} == {"b000", "b001", "b002", "b003", "b039"} and all(r.truncated for r in few)  # the rare word is read first
    pages = spark.createDataFrame([(f"m{i:03d}", "x", "common text" + " rare" * (i == 149), "EXPLICIT") for i in range(150)], "path string, name string, l0 string, identity_status string")
    index = S.build_index(pages.withColumn("l1", F.lit("")).withColumn("canonical_id", F.col("path")), materialize=False)
    chosen = spark.createDataFrame([(1, "b", 1)], "query_id long, branch string, branch_rank long")
    members = pages.select(F.lit("b").alias("branch"), "path").where("path >= 'm120'")
    asked = spark.createDataFrame([(1, "common")], "query_id long, text string")
    assert BR.branch_entities(index, asked, chosen, members).count() == 30
    assert BR.branch_entities(index, asked, chosen, members, limit=125).select("truncated").distinct().collect() == [(True,)]
