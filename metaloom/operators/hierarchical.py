"""Search through the organisation: branches first, then their members, under filters that the organisation may satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..constants import BRANCH_K, ENTITY_CANDIDATE_K, GOVERNED_FACETS, MODEL_TYPES
from ..scale import cut_lineage, salted_join, top_per_group
from . import branches as BR
from . import search as S

#: Facets that a node of the organisation can stand for, with its kind.
FACET_KINDS = {"topic_domain": "topic-domain", "topic": "topic", "layer": "layer"}


def _unset(pages: DataFrame, facet: str) -> Column:
    """Whether a page itself says nothing about a facet."""
    if facet not in pages.columns:
        return F.lit(True)
    kind = pages.schema[facet].dataType
    return F.coalesce(F.size(facet) == 0 if isinstance(kind, ArrayType) else F.col(facet).cast("string") == "", F.lit(True))


def organisation_allowed(pages: DataFrame, closed: DataFrame, nodes: DataFrame, types=None, scope=None) -> DataFrame:
    """Pages that pass the filters themselves or by where they stand.

    As ``eligible_pages``, but a model without a facet of its own also passes if some node above
    it, of the kind the facet stands for, bears the expected name. A facet of its own always
    decides alone. ``closed``: (ancestor, node) of the active edges, so proposals never let a
    page pass; ``nodes``: (path, name, context_type). Only the nodes with the name and what is
    below them are looked at, and a page is kept or not by one semi-join per facet.
    """
    kept = S.indexable(pages)
    if types:
        kept = kept.where(F.col("context_type").isin(*types))
    for key, value in (scope or {}).items():
        facet = S.facet_of(key)
        if facet not in GOVERNED_FACETS:
            continue
        own = ~F.col("context_type").isin(*MODEL_TYPES) | S.facet_matches(kept, facet, value)
        kind = FACET_KINDS.get(facet)
        if kind is None:
            kept = kept.where(own)
            continue
        bearing = nodes.where((F.col("context_type") == kind) & (F.lower(F.trim("name")) == (value or "").strip().lower())).select(F.col("path").alias("ancestor"))
        below = closed.join(bearing, "ancestor", "left_semi").select(F.col("node").alias("path"))
        kept = kept.where(own).unionByName(kept.where(~own & _unset(kept, facet)).join(below, "path", "left_semi"))
    return kept


def hierarchical_search(
    index: S.PageIndex,
    queries: DataFrame,
    seeds: DataFrame,
    routes: DataFrame,
    branches: DataFrame,
    closed: DataFrame,
    nodes: DataFrame,
    anchors: DataFrame | None = None,
    types=None,
    scope=None,
    top_k: int = ENTITY_CANDIDATE_K,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits (query_id, path, score, rank), branches (query_id, branch, view, branch_rank, score)) of a table of queries.

    ``routes`` (query_id, view) names the views a query goes through; queries without a row are
    answered directly from ``seeds`` (query_id, path, score). The others rank the branches of
    their views, take the best few over all of them, search inside the members of each, drop what
    ``organisation_allowed`` rejects and merge what is left into the seeds: a hit scores by the
    best seed and its place, and a page that is found again rises. ``anchors`` (query_id, path,
    page_anchor) are pages or owners of elements named in the query; they are raised above the
    seeds, but do not count as the best seed. ``limit`` bounds postings read, for branches and for
    members; without it both steps are exact.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    ways = routes.select("query_id", "view").distinct()
    walking = cut_lineage(queries.join(ways.select("query_id").distinct(), "query_id", "left_semi"))
    branches = cut_lineage(branches)  # read by every part of their ranking
    ranked = BR.rank_branches(walking, branches, top_k=3 * BRANCH_K, limit=limit).join(ways, ["query_id", "view"], "left_semi")
    best = top_per_group(ranked.drop("rank"), ["query_id"], [F.desc("score"), F.asc("path")], BRANCH_K, "branch_rank")
    chosen = cut_lineage(best.select("query_id", F.col("path").alias("branch"), "view", "branch_rank", "score"))
    members = closed.select(F.col("ancestor").alias("branch"), F.col("node").alias("path"))
    found = BR.branch_entities(index, walking, chosen, members.join(chosen.select("branch").distinct(), "branch", "left_semi"), limit)
    allowed = organisation_allowed(index.pages, closed, nodes, types, scope).select("path")
    fitting = cut_lineage(found.join(allowed, "path", "left_semi"))
    place = F.row_number().over(Window.partitionBy("query_id", "branch_rank").orderBy("rank")).cast("long")
    hits = fitting.select("query_id", "branch_rank", "path", place.alias("rank"))
    base = seeds.groupBy("query_id").agg(F.max("score").alias("base"))
    start = seeds.select("query_id", "path", "score") if anchors is None else BR.anchor_scores(seeds, anchors.join(allowed, "path", "left_semi"))
    merged = BR.discover(start, hits, top_k, base)
    used = salted_join(chosen, fitting.select("query_id", "branch_rank").distinct(), ["query_id", "branch_rank"], ["branch"], how="left_semi")
    return merged, used
