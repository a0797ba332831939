"""Provenance of the organisation: who contributed an edge, on what evidence, from which sources, and whether that holds.

Many edges rest on the same evidence, so every distinct set of owners, evidence or sources is
kept once (``intern``) and edges carry set ids. A set is told by a digest of its members that
adds up in any order; no member list is gathered anywhere, so an edge may have any number of
owners, and a check of evidence looks at every distinct set once instead of at every edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import BROADCAST_BYTES, cut_lineage, drop_cut, maybe_broadcast, salted_join
from .hierarchy import EDGE, edge_id

KINDS = ("owner", "evidence", "source")


def set_digests(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """(key, set_id, size) per key of distinct (key, item) rows: equal sets have equal ids, whatever their order."""
    one, two = F.xxhash64(item), F.xxhash64(F.lit("set"), F.col(item))
    sums = rows.groupBy(*key).agg(F.count("*").alias("size"), F.bit_xor(one).alias("x"), F.sum(two.cast("decimal(20,0)")).alias("s"))
    return sums.select(*key, F.substring(F.sha2(F.concat_ws(":", "size", "x", "s"), 256), 1, 32).alias("set_id"), "size")


def intern(rows: DataFrame, key: list[str], item: str) -> tuple[DataFrame, DataFrame]:
    """(key, set_id, size) and the distinct sets as (set_id, item), each stored once; null items belong to no set."""
    distinct = cut_lineage(rows.where(F.col(item).isNotNull()).select(*key, item).distinct(), packed=True)
    held = cut_lineage(set_digests(distinct, key, item), packed=True)
    shown = held.groupBy("set_id").agg(F.min(F.struct(*key)).alias("k")).select("set_id", *[F.col(f"k.{c}").alias(c) for c in key])
    shown = cut_lineage(shown)
    members = cut_lineage(distinct.join(maybe_broadcast(shown, BROADCAST_BYTES), key).select("set_id", item), packed=True)
    drop_cut(distinct, shown)
    return held, members


def merge_provenance(contributions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges merged by id with the ids of their sets, and those sets as (kind, set_id, item).

    ``contributions``: one row per owner, evidence and source of an edge: view, parent, child,
    parent_kind, child_kind, status, method, rule_id, confidence, owner, evidence, source. The
    merged edge has the highest confidence, and per kind (owner, evidence, source) ``kind_set``
    and ``kind_count``; an edge without evidence has a null set and count 0.
    """
    keyed, written = cut_lineage(contributions.withColumn("edge_id", edge_id()), packed=True), []
    merged = keyed.groupBy("edge_id", *EDGE, "parent_kind", "child_kind", "status", "method", "rule_id").agg(F.max("confidence").alias("confidence"))
    sets = None
    for kind in KINDS:
        held, members = intern(keyed, ["edge_id"], kind)
        written += [held, members]
        merged = merged.join(held.select("edge_id", F.col("set_id").alias(f"{kind}_set"), F.col("size").alias(f"{kind}_count")), "edge_id", "left")
        merged = merged.withColumn(f"{kind}_count", F.coalesce(f"{kind}_count", F.lit(0)).cast("long"))
        members = members.select(F.lit(kind).alias("kind"), "set_id", F.col(kind).alias("item"))
        sets = members if sets is None else sets.unionByName(members)
    merged, sets = cut_lineage(merged, packed=True), cut_lineage(sets, packed=True)
    drop_cut(keyed, *written)
    return merged, sets


def provenance_rows(merged: DataFrame, sets: DataFrame) -> DataFrame:
    """(edge_id, kind, item): the full provenance of edges, expanded from their sets. A set may serve very many edges."""
    held = merged.select("edge_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_set").alias("set_id")) for k in KINDS])).alias("h"))
    held = held.select("edge_id", "h.kind", "h.set_id").where("set_id IS NOT NULL")
    return salted_join(held, sets, ["kind", "set_id"], ["edge_id"]).select("edge_id", "kind", "item")


def evidence_issues(merged: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """(code, subject, missing): edges whose evidence is not among ``known`` (evidence), with the number of unknown pieces.

    Each distinct set is looked up once; edges only meet the sets that miss something.
    """
    evidence = sets.where("kind = 'evidence'").select("set_id", F.col("item").alias("evidence"))
    missing = evidence.join(known.select("evidence").distinct(), "evidence", "left_anti").groupBy("set_id").agg(F.count("*").alias("missing"))
    bad = salted_join(merged.select("edge_id", F.col("evidence_set").alias("set_id")), cut_lineage(missing), ["set_id"], ["edge_id"])
    return bad.select(F.lit("evidence_not_found").alias("code"), F.col("edge_id").alias("subject"), "missing")


def ambiguous_edges(edges: DataFrame, supported: DataFrame) -> DataFrame:
    """(code, subject): derived M x N edges of co-classification that no single pair of ``supported`` (view, parent, child) proves.

    ``edges`` carry source_relation, parent_cardinality and child_cardinality; a missing cardinality counts as many.
    """
    many = (F.coalesce("parent_cardinality", F.lit(2)) > 1) & (F.coalesce("child_cardinality", F.lit(2)) > 1)
    wide = edges.where((F.col("status") == "DERIVED") & (F.col("source_relation") == "co_classification") & many)
    return wide.join(supported.select(*EDGE).distinct(), EDGE, "left_anti").select(F.lit("ambiguous_derived_edge").alias("code"), F.col("edge_id").alias("subject"))


def page_issues(pages: DataFrame, members: DataFrame, closure: DataFrame, contexts: DataFrame) -> DataFrame:
    """(code, subject) of stored branch pages that no longer agree with the organisation.

    ``pages``: path, view, node; ``members``: path, member as stored with the page; ``closure``:
    view, ancestor, node; ``contexts``: path. Codes: ``page_path_collision`` (a context has the
    page's path), ``view_uri_mismatch`` (the path is not below its view), ``aggregate_member_mismatch``
    (the stored members are not the contexts below the node). Members are compared by set
    digests, two sums per page, so a page of all contexts costs no more than its rows.
    """
    below = closure.join(contexts.select(F.col("path").alias("node")).distinct(), "node", "left_semi").select("view", "ancestor", F.col("node").alias("member"))
    wanted = set_digests(below.distinct(), ["view", "ancestor"], "member").select("view", F.col("ancestor").alias("node"), F.col("set_id").alias("wanted"))
    stored = set_digests(members.select("path", "member").distinct(), ["path"], "member").select("path", F.col("set_id").alias("stored"))
    compared = pages.join(wanted, ["view", "node"], "left").join(stored, "path", "left")
    parts = [
        pages.join(contexts.select("path").distinct(), "path", "left_semi").select(F.lit("page_path_collision").alias("code"), F.col("path").alias("subject")),
        pages.where(~F.col("path").startswith(F.concat(F.lit("data://views/"), "view", F.lit("/")))).select(F.lit("view_uri_mismatch"), "path"),
        compared.where(~F.col("wanted").eqNullSafe(F.col("stored"))).select(F.lit("aggregate_member_mismatch"), "path"),
    ]
    return parts[0].union(parts[1]).union(parts[2])
