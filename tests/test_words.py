"""Words counted in Arrow batches against the column expression, and blocks of scores against the join."""

import random

import pytest
from pyspark.sql import functions as F

from metaloom.functions import text as T
from metaloom.functions.words import words
from metaloom.operators import search as S

TEXTS = ["", None, "Ab_9 x-Y İstanbul K 5K ΑΣ", "弱覆盖 rsrp弱 覆盖9 盖", "弱 a 弱b", "𠀀弱覆 ǅ ﬀ ß É_é", "a" * 300, "one\u0000two\ntwo"]


def test_words_equal_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("t", T.tokens(F.col("t")).alias("k")).collect()
    assert [words(r.t) for r in rows] == [r.k for r in rows]


@pytest.mark.parametrize("top_k", [1, 4, 60])
def test_blocks_of_scores_equal_the_join(spark, monkeypatch, top_k):
    rnd = random.Random(4)
    monkeypatch.setattr(S, "PAGE_BLOCK", 7)
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    text = lambda n: " ".join(f"w{min(int(rnd.expovariate(0.3)), 12)}" for _ in range(n))
    pages = [(f"p{i % 45:02d}", "n", None, text(rnd.randrange(0, 9)), "EXPLICIT") for i in range(50)] + [(None, "n", "", "w1 w2", "EXPLICIT"), ("p99", "n", "", "w0", "CANDIDATE")]
    index = S.build_index(spark.createDataFrame(pages, "path string, name string, l0 string, l1 string, identity_status string"))
    asked = [(q, text(3)) for q in (1, 2, 3, 4, 5, 5, 7)] + [(None, "w0 w1"), (8, None), (9, "zzz")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    order = [F.desc("score"), F.asc("path")]
    want = S.top_per_group(S.score_all(index, queries), ["query_id"], order, top_k).collect()
    got = S.search_many(index, queries, top_k)
    plan = got._jdf.queryExecution().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and "MapInArrow" in plan
