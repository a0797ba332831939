"""Two-step retrieval: rank summary pages (branches) per view, then search inside their members."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ARBITRATION, BRANCH_K, ENTITY_CANDIDATE_K
from ..functions import text as T
from ..scale import cut_lineage, salted_join, top_per_group
from . import search as S
from .mentions import resolve_mentions


def branch_postings(branches: DataFrame) -> DataFrame:
    toks = S.indexable(branches).select("view", "path", F.explode(T.tokens(S.index_text(branches))).alias("token"))
    return cut_lineage(toks.groupBy("view", "path", "token").agg(F.count("*").alias("tf")))


def rank_branches(queries: DataFrame, branches: DataFrame, top_k: int = 9, limit: int | None = None) -> DataFrame:
    """(query_id, view, path, score, rank): branch ranking inside each view.

    ``branches``: (view, path, name, canonical_id, l0, l1, identity_status, quality). Term
    statistics are kept per view, so views never mix; a branch that matches by view only is
    dropped; the score is damped by the share of supported placements. Every branch that shares
    a word with a query or is named in it is scored; the view itself ranks all its branches in
    path order, for all queries alike. With ``limit`` each (query, view) pair reads so many
    postings at most, and a column ``truncated`` tells whether there were more.
    """
    pair = ["query_id", "view"]
    posts = branch_postings(branches)
    lengths = posts.groupBy("view", "path").agg(F.sum("tf").alias("dl"))
    stats = lengths.groupBy("view").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row per view
    terms = posts.groupBy("view", "token").agg(F.count("*").alias("df"))
    words = cut_lineage(salted_join(S.query_words(queries), terms, ["token"], ["query_id"]))
    held = S.wanted_postings(posts, words, ["view", "token"])
    cands = None
    if limit is not None:
        cands = _budgeted_branches(words, held, lengths, limit)
        held = held.join(cands.select("view", "path").distinct(), ["view", "path"], "left_semi")
    hit = salted_join(salted_join(held, lengths, ["view", "path"], ["token"]), words, ["view", "token"], ["path"]).join(F.broadcast(stats), "view")
    part = S.bm25_expr(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    bm = hit.groupBy(*pair, "path").agg(F.round(F.sum(part), S.SCORE_DIGITS).alias("score"))
    keys = branches.select(T.fold(F.col("name")).alias("key"), F.col("view").alias("source"), F.col("path").alias("target"), F.lit("branch").alias("kind"))
    exact = resolve_mentions(queries, keys).select("query_id", F.col("source").alias("view"), F.col("target").alias("path")).distinct().withColumn("score", F.lit(1.0))
    if cands is None:
        # All branches of a view tie in it, so their rank is that of their path and no query lists them.
        facet = lengths.select("view", "path", F.row_number().over(Window.partitionBy("view").orderBy("path")).alias("place"))
    else:
        bm, exact = (c.join(cands.select(*pair, "path"), [*pair, "path"], "left_semi") for c in (bm, exact))
        facet = cands.select(*pair, "path", F.row_number().over(Window.partitionBy(*pair).orderBy("path")).alias("place"))
    parts = None
    for name, frame in (("exact", exact), ("bm25", bm.where("score > 0"))):
        w = Window.partitionBy(*pair).orderBy(F.desc("score"), F.asc("path"))
        ranked = frame.select(*pair, "path", (F.lit(S.CHANNEL_WEIGHTS[name]) / (S.RRF_OFFSET + F.row_number().over(w))).alias("part"))
        parts = ranked if parts is None else parts.unionByName(ranked)
    fused = parts.groupBy(*pair, "path").agg(F.sum("part").alias("part"))
    placed = salted_join(fused, facet, [c for c in facet.columns if c != "place"], ["query_id"])
    scored = salted_join(placed, branches.select("view", "path", "quality"), ["view", "path"], ["query_id"])
    rrf = F.round(F.col("part") + F.lit(S.CHANNEL_WEIGHTS["facet"]) / (S.RRF_OFFSET + F.col("place")), 12)
    scored = scored.select(*pair, "path", F.round(rrf * (0.9 + 0.1 * F.col("quality")), 12).alias("score"))
    best = top_per_group(scored, pair, [F.desc("score"), F.asc("path")], top_k)
    return best if cands is None else best.join(cands.select(*pair, "truncated").distinct(), pair)


def _budgeted_branches(words: DataFrame, held: DataFrame, lengths: DataFrame, limit: int) -> DataFrame:
    """(query_id, view, path, truncated): branches of the first ``limit`` postings of each pair, rare words first, topped up in path order."""
    pair = ["query_id", "view"]
    heads = top_per_group(held.select("view", "token", "path"), ["view", "token"], [F.asc("path")], limit + 1, "pos").drop("pos")
    reads = salted_join(words, heads, ["view", "token"], ["query_id"])
    order = Window.partitionBy(*pair).orderBy("df", "token", "path")
    reads = reads.withColumn("read", F.row_number().over(order)).where(F.col("read") <= limit + 1)
    reads = reads.withColumn("truncated", F.max("read").over(Window.partitionBy(*pair)) > limit).where(F.col("read") <= limit)
    recalled = reads.groupBy(*pair, "path").agg(F.min("read").alias("first"))
    cut = reads.groupBy(*pair).agg(F.max("truncated").alias("truncated"))
    first_paths = top_per_group(lengths.select("view", "path"), ["view"], [F.asc("path")], limit, "pos")
    filler = first_paths.groupBy("view").agg(F.collect_list(F.struct("pos", "path")).alias("filler"))  # at most ``limit`` each
    extra = words.select(*pair).distinct().join(F.broadcast(filler), "view").select(*pair, F.explode("filler").alias("f"))
    extra = extra.select(*pair, F.col("f.path").alias("path"), (F.col("f.pos") + limit).cast("int").alias("first"))
    both = recalled.unionByName(extra).groupBy(*pair, "path").agg(F.min("first").alias("first"))
    return cut_lineage(top_per_group(both, pair, [F.asc("first")], limit, "n").select(*pair, "path").join(cut, pair))


def arbitrate_views(ranked: DataFrame, initial: DataFrame) -> DataFrame:
    """Choose at most two views per query from branch evidence.

    ``initial``: (query_id, view) the first routed view, which gets a small prior.
    """
    top = ranked.where(F.col("rank") <= ARBITRATION["branch_k"])
    per_view = top.groupBy("query_id", "view").agg((F.max("score") * 0.7 + F.avg("score") * 0.3).alias("evidence"))
    first = initial.select("query_id", "view", F.lit(True).alias("first"))
    per_view = per_view.join(first, ["query_id", "view"], "left").withColumn(
        "evidence", F.round(F.col("evidence") * F.when(F.col("first"), ARBITRATION["prior"]).otherwise(1.0), 12)
    )
    best = per_view.groupBy("query_id").agg(F.max("evidence").alias("best"))
    kept = per_view.join(best, "query_id").where((F.col("best") > 0) & (F.col("evidence") >= F.col("best") * ARBITRATION["keep_ratio"]))
    return top_per_group(kept, ["query_id"], [F.desc("evidence"), F.asc("view")], ARBITRATION["max_views"], "position").select(
        "query_id", "view", "evidence", "position"
    )


def branch_entities(index: S.PageIndex, queries: DataFrame, chosen: DataFrame, members: DataFrame, limit: int | None = None) -> DataFrame:
    """Search inside the chosen branches: (query_id, branch_rank, path, rank).

    ``chosen``: (query_id, branch, branch_rank); ``members``: (branch, path). Every member that
    shares a word with the query is scored. With ``limit`` each (query, branch) pair reads so many
    postings at most, reads rejected by membership still use it, and a column ``truncated`` tells
    whether there were more. Without it members meet the words of their branch's queries in
    blocks; pages whose path repeats, and long tables of queries, meet them in joins.
    """
    best = S.top_in_groups(index, queries, chosen, members, ENTITY_CANDIDATE_K) if limit is None else None
    if best is not None:
        best, again = best
        if not again.isEmpty():
            part = replace(index, postings=index.postings.join(again, "path", "left_semi"), lengths=index.lengths.join(again, "path", "left_semi"))
            best = best.unionByName(_joined_entities(part, queries, chosen, members.join(again, "path", "left_semi"))[0])
        best = top_per_group(best.where("score > 0"), ["query_id", "branch_rank"], [F.desc("score"), F.asc("path")], ENTITY_CANDIDATE_K)
        return best.select("query_id", "branch_rank", "path", "rank")
    found, cut = _joined_entities(index, queries, chosen, members, limit)
    top = top_per_group(found, ["query_id", "branch_rank"], [F.desc("score"), F.asc("path")], ENTITY_CANDIDATE_K)
    if cut is not None:
        top = top.join(cut, ["query_id", "branch_rank"])
    return top.select("query_id", "branch_rank", "path", "rank", *["truncated"] * (cut is not None))


def _joined_entities(index: S.PageIndex, queries: DataFrame, chosen: DataFrame, members: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, branch_rank, path, score) of every member read, and (query_id, branch_rank, truncated) under a limit, by joins."""
    pairs = chosen.withColumn("pair_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("branch_rank").cast("string")))
    asked = pairs.join(queries, "query_id").select(F.col("pair_id").alias("query_id"), "text")
    owner = pairs.select(F.col("pair_id").alias("query_id"), "branch")
    words = cut_lineage(salted_join(S.query_words(asked), index.terms, ["token"], ["query_id"]))
    posts, cut = S.wanted_postings(index.postings, words, ["token"]), None
    if limit is None:
        reads = salted_join(posts.select("token", "path"), words, ["token"], ["path"]).select("query_id", "path").distinct()
    else:
        heads = S.posting_heads(posts, limit + 1)
        order = Window.partitionBy("query_id").orderBy("df", "token", "path")
        reads = salted_join(words, heads, ["token"], ["query_id"]).withColumn("read", F.row_number().over(order)).where(F.col("read") <= limit + 1)
        cut = reads.groupBy("query_id").agg((F.max("read") > limit).alias("truncated"))
        reads = reads.where(F.col("read") <= limit).select("query_id", "path").distinct()
    # Membership is tested per read, never listed per branch.
    cands = cut_lineage(salted_join(salted_join(reads, owner, ["query_id"], ["path"]), members, ["branch", "path"], ["query_id"]).select("query_id", "path"))
    names = pairs.select(F.col("pair_id").alias("p"), F.col("query_id").alias("q"), "branch_rank")
    named = lambda rows, *columns: rows.join(names, F.col("query_id") == F.col("p")).select(F.col("q").alias("query_id"), "branch_rank", *columns)
    return named(S.score_candidates(index, asked, cands), "path", "score"), None if cut is None else named(cut, "truncated")


def discover(seeds: DataFrame, hits: DataFrame, top_k: int = ENTITY_CANDIDATE_K, base: DataFrame | None = None) -> DataFrame:
    """Merge seed scores with branch hits, branch by branch.

    A hit scores base x (.9 + .1/rank); a page already chosen keeps the larger score plus .2 x
    base. A page meets at most ``BRANCH_K`` branches, so the fold runs over a tiny array.
    """
    if base is None:
        base = seeds.groupBy("query_id").agg(F.max("score").alias("base"))
    rows = hits.where(F.col("branch_rank") <= BRANCH_K).groupBy("query_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("branch_rank", "rank"))).alias("steps")
    )
    merged = seeds.select("query_id", "path", "score").join(rows, ["query_id", "path"], "full_outer").join(base, "query_id", "left")
    merged = merged.withColumn("base", F.coalesce("base", F.lit(0.05)))
    folded = F.aggregate(
        F.coalesce("steps", F.array().cast("array<struct<branch_rank:bigint,rank:bigint>>")),
        F.col("score"),
        lambda acc, s: F.when(acc.isNull(), F.col("base") * (0.9 + 0.1 / s["rank"])).otherwise(
            F.greatest(F.col("base") * (0.9 + 0.1 / s["rank"]), acc) + F.col("base") * 0.2
        ),
    )
    scored = merged.select("query_id", "path", F.round(folded, 12).alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("path")], top_k)


def anchor_scores(seeds: DataFrame, anchors: DataFrame) -> DataFrame:
    """Seeds with exact anchors raised: page anchors 1.5 x best seed, element-only anchors .6 x.

    ``anchors``: (query_id, path, page_anchor).
    """
    base = seeds.groupBy("query_id").agg(F.max("score").alias("base"))
    any_page = anchors.groupBy("query_id").agg(F.bool_or("page_anchor").alias("has_page"))
    raised = anchors.join(base, "query_id", "left").join(any_page, "query_id").select(
        "query_id", "path",
        (F.coalesce("base", F.lit(0.05)) * F.when(F.col("page_anchor") | ~F.col("has_page"), 1.5).otherwise(0.6)).alias("score"),
    )
    rest = seeds.select("query_id", "path", "score").join(anchors.select("query_id", "path"), ["query_id", "path"], "left_anti")
    return rest.unionByName(raised)
