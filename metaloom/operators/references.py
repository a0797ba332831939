"""Typed references: resolution, reverse links, organisation report and isolation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import STANDARD_SOURCE_PREFIXES, TRUSTED, UNTRUSTED
from ..functions import text as T
from ..scale import salted_join
from .identity import name_keys, unique_owner


def resolve_references(refs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Bind (target_type, raw_target) to the one trusted context of that name.

    Proposals get a path for review but are never promoted.
    """
    owners = unique_owner(name_keys(contexts), ["context_type", "key"], "path")
    trusted = contexts.where(F.col("identity_status").isin(*TRUSTED)).select("path")
    owners = owners.join(trusted, "path", "left_semi").select(
        F.col("context_type").alias("target_type"), "key", F.col("path").alias("found")
    )
    keyed = refs.withColumn("key", T.normalize(F.col("raw_target")))
    bound = salted_join(keyed, owners, ["target_type", "key"], ["source"], how="left")
    confirmed = (F.col("status") != "CANDIDATE") & F.col("found").isNotNull()
    return bound.select(
        "source", "relation", "raw_target", "target_type",
        F.when(F.col("status") == "CANDIDATE", "CANDIDATE").when(confirmed, "CONFIRMED").otherwise("UNRESOLVED").alias("status"),
        F.col("found").alias("target_path"),
        F.when(confirmed, F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def confirmed(refs: DataFrame) -> DataFrame:
    return refs.where((F.col("status") == "CONFIRMED") & F.col("target_path").isNotNull())


def backrefs(refs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Reverse links of trusted contexts: (target, source, relation)."""
    sources = contexts.where(~F.col("identity_status").isin(*UNTRUSTED)).select(F.col("path").alias("source"))
    linked = confirmed(refs).join(sources, "source", "left_semi")
    return linked.select(F.col("target_path").alias("target"), "source", "relation")


def graph_edges(refs: DataFrame, contexts: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Distinct (src, relation, dst): confirmed references plus path-valued lineage sections."""
    edges = backrefs(refs, contexts).select(F.col("source").alias("src"), "relation", F.col("target").alias("dst"))
    if lineage is not None:
        sources = contexts.where(~F.col("identity_status").isin(*UNTRUSTED)).select("path")
        extra = lineage.where(F.col("value").startswith("data://")).join(sources, "path", "left_semi")
        extra = extra.select(
            F.col("path").alias("src"), F.regexp_replace("section", "^lineage\\.", "").alias("relation"), F.col("value").alias("dst")
        )
        edges = edges.unionByName(extra)
    return edges.distinct()


def missing_targets(refs: DataFrame, contexts: DataFrame) -> DataFrame:
    known = contexts.select(F.col("path").alias("target_path"))
    return refs.where(F.col("status") == "CONFIRMED").join(known, "target_path", "left_anti")


def orphans(refs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Active contexts that are no end of any confirmed reference."""
    links = confirmed(refs)
    ends = links.select(F.col("source").alias("path")).union(links.select("target_path")).distinct()
    return contexts.where(~F.col("identity_status").isin(*UNTRUSTED)).join(ends, "path", "left_anti")


def material_sources(sources: DataFrame) -> DataFrame:
    """Drop standard sources of a context unless it has no other; ``sources``: (path, source_id)."""
    standard = F.lit(False)
    for prefix in STANDARD_SOURCE_PREFIXES:
        standard = standard | F.col("source_id").startswith(prefix)
    marked = sources.distinct().withColumn("standard", standard)
    has_other = marked.groupBy("path").agg(F.bool_or(~F.col("standard")).alias("has_other"))
    return marked.join(has_other, "path").where(~F.col("standard") | ~F.col("has_other")).select("path", "source_id")


def cross_source(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Confirmed references whose ends share no source; ends without any source do not count.

    Sharing is decided by counting equal source ids per reference, so no source list is collected.
    """
    material = material_sources(sources)
    have = material.select("path").distinct()
    links = confirmed(refs).select("source", "relation", "target_path").distinct()
    links = links.join(have.withColumnRenamed("path", "source"), "source", "left_semi")
    links = links.join(have.withColumnRenamed("path", "target_path"), "target_path", "left_semi")
    left = salted_join(links, material.select(F.col("path").alias("source"), "source_id"), ["source"], ["target_path"])
    shared = salted_join(
        left, material.select(F.col("path").alias("target_path"), "source_id"), ["target_path", "source_id"], ["source"]
    ).select("source", "relation", "target_path")
    return links.join(shared.distinct(), ["source", "relation", "target_path"], "left_anti").select(
        "source", "relation", F.col("target_path").alias("target")
    )


def association_counts(refs: DataFrame) -> DataFrame:
    """References by relation and status with both subtotals: (relation, status, level, refs)."""
    rolled = refs.rollup("relation", "status").agg(F.count("*").alias("refs"), F.grouping_id().alias("level"))
    by_status = refs.groupBy("status").agg(F.count("*").alias("refs")).select(
        F.lit(None).cast("string").alias("relation"), "status", "refs", F.lit(2).cast("long").alias("level")
    )
    return rolled.select("relation", "status", "refs", F.col("level").cast("long").alias("level")).unionByName(by_status)


def candidate_leaks(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed references that also appear as facts (must be empty)."""
    proposed = refs.where((F.col("status") == "CANDIDATE") & F.col("target_path").isNotNull())
    proposed = proposed.select(F.col("source").alias("src"), "relation", F.col("target_path").alias("dst"))
    return proposed.intersect(edges.select("src", "relation", "dst"))
