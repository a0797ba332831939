"""Canonical identity: lookups by hint, name and alias, fuzzy containment, grouping of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPECIAL_FOLDERS
from ..functions import text as T
from ..scale import cut_lineage, global_rank, salted_join


def folder(context_type: Column) -> Column:
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_FOLDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(special, context_type), F.concat(context_type, F.lit("s")))


def path_of(context_type: Column, name: Column) -> Column:
    return F.concat(F.lit("data://"), folder(context_type), F.lit("/"), T.slug(name))


def unique_owner(keys: DataFrame, by: list[str], owner: str) -> DataFrame:
    """Key -> owner where exactly one owner holds the key; min = max needs no distinct set."""
    return (
        keys.groupBy(*by)
        .agg(F.min(owner).alias(owner), F.max(owner).alias("_last"))
        .where(F.col(owner) == F.col("_last"))
        .drop("_last")
    )


def ambiguous_keys(keys: DataFrame, by: list[str], owner: str) -> DataFrame:
    """Keys held by more than one owner, with the number of owners."""
    return keys.select(*by, owner).distinct().groupBy(*by).agg(F.count("*").alias("owners")).where("owners > 1")


def name_keys(contexts: DataFrame) -> DataFrame:
    """(context_type, key, path) of names and, when present, aliases."""
    names = contexts.select("context_type", T.normalize(F.col("name")).alias("key"), "path")
    if "aliases" in contexts.columns:
        aliases = contexts.select("context_type", F.explode("aliases").alias("a"), "path")
        names = names.unionByName(aliases.select("context_type", T.normalize(F.col("a")).alias("key"), "path"))
    return names.where("key <> ''")


def lookup_names(wanted: DataFrame, contexts: DataFrame) -> DataFrame:
    """SAME / UNCERTAIN / DIFFERENT decision of (context_type, name) against known contexts."""
    keys = name_keys(contexts)
    facts = keys.groupBy("context_type", "key").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    asked = wanted.withColumn("key", T.normalize(F.col("name")))
    joined = salted_join(asked, facts, ["context_type", "key"], ["name"], how="left")
    return joined.select(
        *[c for c in wanted.columns],
        F.when(F.col("first").isNull(), "DIFFERENT").when(F.col("first") == F.col("last"), "SAME").otherwise("UNCERTAIN").alias("decision"),
        F.when(F.col("first") == F.col("last"), F.col("first")).alias("path"),
    )


def lookup_hints(wanted: DataFrame, hints: DataFrame) -> DataFrame:
    """Identity hints (id, context_type, hint, value) that point at exactly one context in total."""
    known = hints.select("context_type", "hint", T.normalize(F.col("value")).alias("value_key"), "path")
    # The smallest and the largest owner of a value tell whether there is only one.
    ends = known.groupBy("context_type", "hint", "value_key").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    asked = wanted.withColumn("value_key", T.normalize(F.col("value")))
    matched = salted_join(asked, ends, ["context_type", "hint", "value_key"], ["id"]).groupBy("id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return matched.where(F.col("first") == F.col("last")).select("id", F.col("first").alias("path"))


def fuzzy_containment(fragments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Same kind, one name inside the other, and at least one equal feature.

    ``fragments``: (id, context_type, name, feature, value); ``contexts``: (path, context_type,
    name, feature, value). Containment is an equi-join: every part of a (short) name is a key,
    together with the kind and the feature value, so no unrelated pair of names is compared.
    """
    f = fragments.withColumn("n", T.normalize(F.col("name"))).where("n <> ''")
    c = contexts.select(
        "path", "context_type", T.normalize(F.col("name")).alias("cn"), "feature", F.col("value")
    ).where("cn <> ''")

    def substrings(df: DataFrame, col: str) -> DataFrame:
        span = df.withColumn("_s", F.explode(F.sequence(F.lit(1), F.length(col))))
        span = span.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length(col) - F.col("_s") + 1)))
        return span.withColumn("part", F.substring(F.col(col), F.col("_s"), F.col("_n"))).drop("_s", "_n").distinct()

    inside = substrings(f, "n").join(
        c.withColumnRenamed("cn", "part"), ["context_type", "part", "feature", "value"]
    ).select("id", "path")
    around = substrings(c, "cn").join(
        f.withColumnRenamed("n", "part"), ["context_type", "part", "feature", "value"]
    ).select("id", "path")
    return inside.unionByName(around).distinct().withColumn("confidence", F.lit(0.88))


def group_fragments(links: DataFrame) -> DataFrame:
    """Connected groups of fragments that share any identity key.

    ``links``: (seq, key) rows. Returns (seq, group) with group = smallest seq of the component.
    Labels flow fragment -> key -> fragment until nothing changes; keys aggregate before the
    shuffle and hot keys join through salted buckets. Each round is checkpointed.
    """
    links = cut_lineage(links.distinct())
    labels = cut_lineage(links.select("seq").distinct().withColumn("group", F.col("seq")))
    while True:
        by_key = links.join(labels, "seq").groupBy("key").agg(F.min("group").alias("key_group"))
        by_seq = salted_join(links, by_key, ["key"], ["seq"]).groupBy("seq").agg(F.min("key_group").alias("via"))
        # Pointer jump: also take the current label of the label, so long chains halve each round.
        owner = labels.select(F.col("seq").alias("via"), F.col("group").alias("via_group"))
        moved = salted_join(by_seq, owner, ["via"], ["seq"]).join(labels, "seq").select(
            "seq", F.least("group", "via", "via_group").alias("new"), "group"
        )
        moved = cut_lineage(moved)
        changed = moved.where("new < group").limit(1).count()
        labels = moved.select("seq", F.col("new").alias("group"))
        if not changed:
            return labels


def canonical_ids(groups: DataFrame) -> DataFrame:
    """Stable ids ``kind:slug`` with -2, -3, … for later groups that share the base.

    ``groups``: (group, context_type, name). A base shared by very many groups is ranked with
    a distributed sort.
    """
    based = groups.withColumn("base", F.concat_ws(":", "context_type", T.slug(F.col("name"))))
    ranked = global_rank(based, ["base"], [F.asc("group")], "ordinal")
    return ranked.select(
        *groups.columns,
        F.when(F.col("ordinal") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "ordinal")).alias("canonical_id"),
        path_of(F.col("context_type"), F.col("name")).alias("path"),
    )
