"""Binding of environment assets to reference contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENVIRONMENT_BACKED, TYPE_GROUPS
from ..functions import text as T
from ..scale import SALTS, cut_lineage, salted_join

ASSET_KEYS = ["type", "reference_path", "identity_namespace", "stable_id", "strong_key"]
REF_KEYS = ["type", "identity_namespace", "environment_id", "stable_id", "strong_key", "explicit_identity"]
STRONG_KEY = r"^[^.\s]+\.[^.\s]+(\.[^.\s]+)*$"


def snapshot_valid(evidence: Column, environment_id: str, token: str) -> Column:
    """Every proof must come from this environment and this snapshot."""
    same = F.forall(evidence, lambda e: (e["environment_id"] == environment_id) & (e["snapshot_token"] == token))
    return F.coalesce((F.size(evidence) > 0) & same, F.lit(False))


def _rules(assets: DataFrame, refs: DataFrame, environment_id: str) -> list[tuple[int, str, list[str], DataFrame, DataFrame]]:
    """(order, rule, key columns, asset rows, reference rows) of the three ways an asset and a reference meet by equal keys."""
    crossed = assets.where("reference_path IS NOT NULL").withColumn("key", F.col("reference_path"))
    rules = [(1, "provider_explicit_crosswalk/v3", ["type", "key"], crossed, refs.where("path IS NOT NULL").withColumn("key", F.col("path")))]
    scoped = refs.where(F.col("explicit_identity") & (F.col("environment_id") == environment_id))
    for order, key in ((2, "stable_id"), (3, "strong_key")):
        left = assets.where(F.col(key).isNotNull() & (F.trim(key) != ""))
        if key == "strong_key":
            left = left.where(F.col(key).rlike(STRONG_KEY))
        keys = ["type", "identity_namespace", "key"]
        rules.append((order, f"same_type_scoped_{key}/v3", keys, left.withColumn("key", F.col(key)), scoped.withColumn("key", F.col(key))))
    return rules


def _ends(column: str) -> list[Column]:
    """Least and greatest value of a group; an absent one makes them differ."""
    return [F.when(F.count(column) == F.count("*"), F.min(column)).alias("lo"), F.max(column).alias("hi")]


def confirmed_bindings(assets: DataFrame, refs: DataFrame, environment_id: str) -> DataFrame:
    """(asset_id, path, confirmed) of the pairs of ``identity_bindings`` that are confirmed.

    An asset has one path if the least and the greatest of all its keys are one, and a path
    one asset likewise, so a key that very many share is one row and its pairs are never listed.
    """
    sole_path = sole_asset = None
    for _, _, keys, left, right in _rules(assets, refs, environment_id):
        per_key = lambda rows, column: rows.groupBy(*keys).agg(*_ends(column))
        to_paths = salted_join(left.select("asset_id", *keys), per_key(right, "path"), keys, ["asset_id"]).select("asset_id", "lo", "hi")
        to_assets = salted_join(right.select("path", *keys), per_key(left, "asset_id"), keys, ["path"]).select("path", "lo", "hi")
        sole_path = to_paths if sole_path is None else sole_path.unionByName(to_paths)
        sole_asset = to_assets if sole_asset is None else sole_asset.unionByName(to_assets)

    def sole(rows: DataFrame, owner: str, other: str) -> DataFrame:
        lo = F.when(F.count("lo") == F.count("*"), F.min("lo"))
        return rows.where(f"{owner} IS NOT NULL").groupBy(owner).agg(lo.alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select(owner, F.col("lo").alias(other))

    both = sole(sole_path, "asset_id", "path").join(sole(sole_asset, "path", "asset_id"), ["asset_id", "path"])
    return both.select("asset_id", "path", F.lit(True).alias("confirmed"))


def identity_bindings(assets: DataFrame, refs: DataFrame, environment_id: str) -> DataFrame:
    """(asset_id, path, rule, confirmed): same kind, explicit, by crosswalk, stable id or strong key.

    ``assets``: (asset_id, type, reference_path, identity_namespace, stable_id, strong_key), already
    explicit and snapshot-valid; ``refs``: (path, type, identity_namespace, environment_id,
    stable_id, strong_key, explicit_identity). Only one-to-one pairs are confirmed.

    Every pair is a row, so a key of many assets and references has their product; its assets are
    scattered over buckets. Ids that stand once make a pair by a rule once, and the row itself
    tells whether an earlier rule makes it too, so these pairs are neither grouped nor shuffled.
    """
    sole = confirmed_bindings(assets, refs, environment_id).select("asset_id", F.col("path").alias("sole"))
    often = lambda rows, c: cut_lineage(rows.groupBy(c).agg((F.count("*") > 1).alias(f"many_{c}")).where(f"many_{c}"))
    marked = lambda rows, c: rows.join(often(rows, c), c, "left").withColumn(f"many_{c}", F.coalesce(f"many_{c}", F.lit(False)))
    marked_assets = cut_lineage(marked(assets.where("asset_id IS NOT NULL").select("asset_id", *ASSET_KEYS), "asset_id").join(sole, "asset_id", "left"))
    marked_refs = cut_lineage(marked(refs.where("path IS NOT NULL").select("path", *REF_KEYS), "path"))
    pairs = None
    for order, rule, keys, left, right in _rules(marked_assets, marked_refs, environment_id):
        right = right.select("path", "many_path", F.col("stable_id").alias("other_id"), *keys)
        met = salted_join(left, right, keys, ["asset_id"], salts=SALTS if order == 2 else 1)
        crossed = F.col("reference_path").eqNullSafe(F.col("path"))
        same_id = F.coalesce((F.trim("stable_id") != "") & (F.col("stable_id") == F.col("other_id")), F.lit(False))
        earlier = {1: F.lit(False), 2: crossed, 3: crossed | same_id}[order]
        part = met.select("asset_id", "path", F.lit(order).alias("order"), F.lit(rule).alias("rule"), "sole", (F.col("many_asset_id") | F.col("many_path")).alias("many"), earlier.alias("earlier"))
        pairs = part if pairs is None else pairs.unionByName(part)
    once = pairs.where("NOT many AND NOT earlier").select("asset_id", "path", "rule", "sole")
    again = pairs.where("many").groupBy("asset_id", "path").agg(F.min(F.struct("order", "rule")).alias("b"), F.first("sole").alias("sole"))
    every = once.unionByName(again.select("asset_id", "path", F.col("b.rule").alias("rule"), "sole"))
    return every.select("asset_id", "path", "rule", F.col("sole").eqNullSafe(F.col("path")).alias("confirmed"))


def candidate_bindings(assets: DataFrame, refs: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(asset_id, path): equal normalised id, code, name or alias against name or path tail; compatible kinds.

    Pages already bound for certain are left out.
    """
    group = F.create_map(*[F.lit(x) for kv in TYPE_GROUPS.items() for x in kv])
    kind = lambda c: F.coalesce(F.try_element_at(group, F.col(c)), F.col(c))
    names = F.concat(F.array("asset_id", "code", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    left = assets.select("asset_id", kind("type").alias("g"), F.explode(F.array_distinct(F.transform(names, T.binding_key))).alias("key")).where("key <> ''")
    right = refs.select("path", kind("type").alias("g"), F.explode(F.array_distinct(F.array(
        T.binding_key(F.col("name")), T.binding_key(F.element_at(F.split("path", "/"), -1))))).alias("key")).where("key <> ''")
    pairs = salted_join(left, right, ["g", "key"], ["asset_id"]).select("asset_id", "path").distinct()
    if confirmed is not None:
        pairs = pairs.join(confirmed.where("confirmed").select("path"), "path", "left_anti")
    return pairs


def reference_only(refs: DataFrame, bindings: DataFrame, state: str) -> DataFrame:
    """Environment-backed contexts without a confirmed binding, with the reason."""
    reason = "environment_absence_confirmed" if state == "NOT_FOUND_CONFIRMED" else "environment_identity_unverified"
    open_refs = refs.where(F.col("type").isin(*ENVIRONMENT_BACKED)).join(bindings.where("confirmed").select("path"), "path", "left_anti")
    return open_refs.select("path", "type", F.lit(state).alias("availability_state"), F.lit(reason).alias("candidate_reason"))


def classify_relations(relations: DataFrame, assets: DataFrame, refs: DataFrame) -> DataFrame:
    """Explicit environment relations: semantic mappings to contexts or assets, and structural ones between assets."""
    ids = assets.select(F.col("asset_id").alias("id")).distinct()
    rows = relations.where("assertion_status = 'EXPLICIT' AND trim(predicate) <> ''")
    rows = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    mapping = F.col("predicate").isin("MAPS_TO", "SEMANTIC_MAPPING")
    semantic = rows.where(mapping).join(ids.union(refs.select("path")).distinct().withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    structural = rows.where(~mapping).join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return semantic.withColumn("binding_kind", F.lit("SEMANTIC_MAPPING")).unionByName(structural.withColumn("binding_kind", F.lit("STRUCTURAL_RELATION")))


def availability_state(page: DataFrame) -> DataFrame:
    """State of each environment answer (query_id, records, complete, truncated, supported, available)."""
    state = (
        F.when(~F.col("available"), "UNAVAILABLE").when(~F.col("supported"), "UNSUPPORTED").when(F.col("truncated"), "TRUNCATED")
        .when((F.col("records") == 0) & F.col("complete"), "NOT_FOUND_CONFIRMED").when((F.col("records") == 0) | ~F.col("complete"), "PARTIAL").otherwise("FOUND")
    )
    return page.withColumn("state", state)


def aggregate_availability(disclosed: DataFrame, bindings: DataFrame) -> DataFrame:
    """Verified models among those a summary page disclosed: (branch, available_verified, identity_unverified, status).

    ``disclosed``: (branch, path, model_count) with the branch's full model count.
    """
    hit = disclosed.join(bindings.where("confirmed").select("path").withColumn("ok", F.lit(1)), "path", "left")
    per = hit.groupBy("branch").agg(F.count("ok").alias("available_verified"), F.max("model_count").alias("models"))
    return per.select(
        "branch", "available_verified", (F.col("models") - F.col("available_verified")).cast("long").alias("identity_unverified"),
        F.when(F.col("available_verified") > 0, "PARTIALLY_VERIFIED").otherwise("UNRESOLVED").alias("status"),
    )
