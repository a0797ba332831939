"""Coverage: what each requirement is proven by, in the reference corpus and in an environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ASPECT_SECTIONS, COVERAGE_RESOLVED, ENVIRONMENT_ASPECTS, ENVIRONMENT_TYPES, LINEAGE_RELATIONS, RELATION_ASPECTS, TRUSTED, TYPE_ASPECTS,
)
from ..functions import text as T
from ..scale import salted_join


def support_facts(sections: DataFrame, contexts: DataFrame) -> DataFrame:
    """(path, aspect, section, status, conflicted, truncated, coverage_status, …) evidenced facts.

    ``sections``: (path, section, status, evidenced, conflicted, truncated, coverage_status,
    authoritative, complete, selector, reason). A context's kind itself supports one aspect when
    its identity has evidence.
    """
    table = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sec")) for a, secs in ASPECT_SECTIONS.items() for s in secs])
    kept = sections.where(F.col("status").isin(*TRUSTED) & F.col("evidenced"))
    rows = kept.withColumn("d", F.explode(F.filter(table, lambda d: d["sec"] == F.col("section"))))
    facts = rows.select(
        "path", F.col("d.aspect").alias("aspect"), "section", "status", "conflicted", "truncated", "coverage_status",
        "authoritative", "complete", "selector", "reason",
    )
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_ASPECTS.items() for x in kv]), F.col("context_type"))
    none = F.lit(None).cast("string")
    identity = contexts.where(F.col("evidenced")).select(
        "path", own.alias("aspect"), F.lit("identity").alias("section"), F.col("identity_status").alias("status"), F.lit(False).alias("conflicted"),
        F.lit(False).alias("truncated"), none.alias("coverage_status"), F.lit(False).alias("authoritative"), F.lit(False).alias("complete"),
        none.alias("selector"), none.alias("reason"),
    ).where(F.col("aspect").isNotNull())
    return facts.unionByName(identity)


def requirement_id(layer: Column, entity: Column, aspect: Column) -> Column:
    return F.concat_ws(":", F.lower(layer), T.short_hash(entity, 12), aspect)


def infer_requirements(entities: DataFrame, aspects: list[str], environment: bool = False) -> DataFrame:
    """One requirement per entity and aspect, plus an environment twin for aspects that have one."""
    kinds = [F.struct(F.lit(a).alias("aspect"), F.lit("REFERENCE").alias("layer")) for a in aspects]
    if environment:
        kinds += [F.struct(F.lit(a).alias("aspect"), F.lit("ENVIRONMENT").alias("layer")) for a in aspects if a in ENVIRONMENT_ASPECTS]
    rows = entities.select("entity", "entity_name", F.explode(F.array(*kinds)).alias("k")).select("entity", "entity_name", "k.aspect", "k.layer")
    return rows.withColumn("req_id", requirement_id(F.col("layer"), F.col("entity"), F.col("aspect"))).withColumn("selector", F.lit(None).cast("string"))


def proofs(reqs: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Direct, one-hop, composed two-hop and lineage proofs of REFERENCE requirements.

    ``relations``: evidenced (src, relation, dst).
    """
    wanted = reqs.where("layer = 'REFERENCE'").select("req_id", "entity", "aspect", F.col("selector").alias("req_selector"))
    direct = salted_join(facts, wanted.select("req_id", F.col("entity").alias("path"), "aspect", "req_selector"), ["path", "aspect"], ["section"])
    direct = direct.withColumn("hops", F.lit(0))
    pairs = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(r).alias("rel")) for a, rels in RELATION_ASPECTS.items() for r in rels])
    typed = relations.withColumn("d", F.explode(F.filter(pairs, lambda d: d["rel"] == F.col("relation")))).select(
        "src", "dst", F.col("d.aspect").alias("aspect")
    )
    near = salted_join(typed, wanted.select("req_id", F.col("entity").alias("src"), "aspect", "req_selector"), ["src", "aspect"], ["dst"])
    near = near.select("req_id", "req_selector", "aspect", F.col("dst").alias("path")).distinct()
    one = salted_join(near, facts, ["path", "aspect"], ["req_id"]).withColumn("hops", F.lit(1))
    first = relations.where("relation = 'uses_metric'").select("src", F.col("dst").alias("mid"))
    second = relations.where("relation IN ('supported_by', 'uses_model')").select(F.col("src").alias("mid"), F.col("dst").alias("path"))
    models = wanted.where("aspect = 'models'").select("req_id", "req_selector", "aspect", F.col("entity").alias("src"))
    far = salted_join(salted_join(first, models, ["src"], ["mid"]), second.distinct(), ["mid"], ["req_id"])
    far = far.select("req_id", "req_selector", "aspect", "path").distinct()
    two = salted_join(far, facts, ["path", "aspect"], ["req_id"]).withColumn("hops", F.lit(2))
    out = direct
    for part in (one, two):
        out = out.unionByName(part)
    links = relations.where(F.col("relation").isin(*LINEAGE_RELATIONS))
    ends = links.select(F.col("src").alias("path")).unionByName(links.select(F.col("dst").alias("path")))
    asked = wanted.where("aspect = 'lineage'").select("req_id", "req_selector", "aspect", F.col("entity").alias("path"))
    none = F.lit(None).cast("string")
    lineage = asked.join(ends.distinct(), "path", "left_semi").select(
        "req_id", "req_selector", "aspect", "path", F.lit("lineage").alias("section"), F.lit("EXPLICIT").alias("status"), F.lit(False).alias("conflicted"),
        F.lit(False).alias("truncated"), none.alias("coverage_status"), F.lit(False).alias("authoritative"), F.lit(False).alias("complete"),
        none.alias("selector"), none.alias("reason"), F.lit(1).alias("hops"),
    )
    return out.unionByName(lineage)


def valid_proofs(rows: DataFrame) -> DataFrame:
    """Trusted proofs; explicit applicability statements also need authority, a reason and the same selector."""
    declared = F.col("coverage_status").isNotNull()
    fine = (
        (F.col("status") == "EXPLICIT") & F.col("authoritative") & F.col("reason").isNotNull() & F.col("selector").eqNullSafe(F.col("req_selector"))
        & ((F.col("coverage_status") != "MISSING") | F.col("complete"))
    )
    return rows.where(F.col("status").isin(*TRUSTED) & (~declared | fine))


def assess(reqs: DataFrame, rows: DataFrame) -> DataFrame:
    """(req_id, status, reason, proofs) for REFERENCE requirements; no proof is UNKNOWN, never MISSING."""
    state = F.coalesce("coverage_status", F.lit("SATISFIED"))
    per = valid_proofs(rows).groupBy("req_id").agg(
        F.count("*").alias("proofs"), F.min(state).alias("lo"), F.max(state).alias("hi"), F.bool_or(F.col("conflicted") | F.col("truncated")).alias("mixed")
    )
    joined = reqs.where("layer = 'REFERENCE'").join(per, "req_id", "left")
    partial = (F.col("lo") != F.col("hi")) | F.col("mixed")
    status = F.when(F.col("proofs").isNull(), "UNKNOWN").when(partial, "PARTIAL").otherwise(F.col("lo"))
    reason = (
        F.when(F.col("proofs").isNull(), "no_evidence_in_partial_corpus").when(partial, "conflicting_or_incomplete_evidence").otherwise("entity_scoped_evidence")
    )
    return joined.select(
        "req_id", "entity", "aspect", "layer", status.alias("status"), reason.alias("reason"), F.coalesce("proofs", F.lit(0)).cast("long").alias("proofs")
    )


def assess_environment(reqs: DataFrame, assets: DataFrame, declarations: DataFrame, relations: DataFrame, state: str = "FOUND") -> DataFrame:
    """ENVIRONMENT requirements from provider statements, else from the one matching asset.

    ``assets``: (asset_id, type, name, code, reference_path) explicit, evidenced; ``declarations``:
    (entity, aspect, status, complete, authoritative, reason); ``relations``: (source_id, predicate).
    MISSING needs a complete, authoritative statement; NOT_APPLICABLE an authoritative reason.
    """
    wanted = reqs.where("layer = 'ENVIRONMENT'")
    usable = declarations.where(
        "NOT (status = 'MISSING' AND NOT (complete AND authoritative)) AND NOT (status = 'NOT_APPLICABLE' AND (NOT authoritative OR reason IS NULL))"
    )
    said = usable.groupBy("entity", "aspect").agg(F.min("status").alias("lo"), F.max("status").alias("hi"), F.count("*").alias("said"))
    rows = salted_join(wanted, said, ["entity", "aspect"], ["req_id"], how="left")
    keys = assets.select("asset_id", "type", F.explode(F.array_distinct(F.array("asset_id", "reference_path"))).alias("entity")).where("entity IS NOT NULL")
    matched = salted_join(wanted.select("req_id", "entity", "aspect"), keys.distinct(), ["entity"], ["req_id"])
    types = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(t).alias("t")) for a, ts in ENVIRONMENT_TYPES.items() for t in ts])
    proves = F.exists(types, lambda d: (d["a"] == F.col("aspect")) & (d["t"] == F.col("type")))
    flows = relations.where("predicate IN ('UPSTREAM_OF', 'DOWNSTREAM_OF', 'USES', 'DERIVED_FROM')").select(F.col("source_id").alias("asset_id")).distinct()
    matched = salted_join(matched, flows.withColumn("flows", F.lit(True)), ["asset_id"], ["req_id"], how="left")
    proven = proves | ((F.col("aspect") == "lineage") & F.coalesce("flows", F.lit(False)))
    per = matched.groupBy("req_id").agg(F.count_distinct("asset_id").alias("assets"), F.bool_or(proven).alias("proven"))
    rows = rows.join(per, "req_id", "left")
    status = (
        F.when(F.col("said").isNotNull(), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("PARTIAL"))
        .when(F.col("assets") > 1, "PARTIAL").when(F.col("proven"), "SATISFIED").otherwise("UNKNOWN")
    )
    reason = (
        F.when(F.col("said").isNotNull(), "provider_scoped_assessment").when(F.col("assets") > 1, "ambiguous_environment_identity")
        .when(F.col("proven"), "authoritative_entity_evidence").otherwise("environment_" + state.lower())
    )
    return rows.select("req_id", "entity", "aspect", "layer", status.alias("status"), reason.alias("reason"))


def coverage_summary(assessed: DataFrame) -> DataFrame:
    """Per layer and aspect: whether every requirement is resolved."""
    return assessed.groupBy("layer", "aspect").agg(
        F.bool_and(F.col("status").isin(*COVERAGE_RESOLVED)).alias("resolved"), F.count("*").alias("requirements")
    )
