"""Business semantics of contexts: objects, topic proposals, object references, coverage flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELD_OBJECT_RULES, TOPIC_RULE_CONFIDENCE, TOPIC_RULES


def matched_objects(text: Column, rules=FIELD_OBJECT_RULES) -> Column:
    """Business objects whose field pattern occurs in the text, in rule order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + pattern), F.lit(name)) for pattern, name in rules]))


def map_objects(contexts: DataFrame, rules=FIELD_OBJECT_RULES) -> DataFrame:
    """(path, section, value, position, status): primary and related objects of contexts without explicit ones.

    ``contexts``: (path, text, has_objects).
    """
    rows = contexts.where("NOT has_objects").withColumn("objects", matched_objects(F.col("text"), rules)).where(F.size("objects") > 0)
    parts = rows.select("path", F.posexplode("objects").alias("position", "value"))
    return parts.select(
        "path", F.when(F.col("position") == 0, "primary_objects").otherwise("related_objects").alias("section"), "value",
        F.col("position").cast("long").alias("position"), F.lit("DERIVED").alias("status"),
    )


def propose_topics(contexts: DataFrame, rules=TOPIC_RULES) -> DataFrame:
    """First matching topic rule as a candidate, never a fact: contexts (path, text, has_topic)."""
    pick = reduce(
        lambda rest, r: F.when(F.col("text").rlike("(?i)" + r[0]), F.struct(F.lit(r[1][0]).alias("d"), F.lit(r[1][1]).alias("t"))).otherwise(rest),
        reversed(rules), F.lit(None).cast("struct<d:string,t:string>"),
    )
    rows = contexts.where("NOT has_topic").withColumn("p", pick).where("p IS NOT NULL")
    return rows.select(
        "path", F.col("p.d").alias("topic_domain"), F.col("p.t").alias("topic"), F.lit("CANDIDATE").alias("status"), F.lit(TOPIC_RULE_CONFIDENCE).alias("confidence")
    )


def object_references(objects: DataFrame, existing: DataFrame) -> DataFrame:
    """References to business objects for object sections not referenced yet.

    ``objects``: (path, section, value, status); ``existing``: (source, relation, raw_target).
    """
    relation = F.when(F.col("section") == "primary_objects", "maps_to_business_object").otherwise("relates_to_business_object")
    rows = objects.where("trim(value) <> ''").select(
        F.col("path").alias("source"), relation.alias("relation"), F.trim("value").alias("raw_target"), F.lit("business-object").alias("target_type"),
        F.when(F.col("status").isin("INFERRED", "CANDIDATE"), "CANDIDATE").otherwise("UNRESOLVED").alias("status"),
        F.when(F.col("status") == "EXPLICIT", 1.0).otherwise(0.8).alias("confidence"),
    )
    rows = rows.dropDuplicates(["source", "relation", "raw_target"])
    return rows.join(existing.select("source", "relation", "raw_target"), ["source", "relation", "raw_target"], "left_anti")


def coverage_flags(contexts: DataFrame, sections: DataFrame) -> DataFrame:
    """Nine booleans per context: contexts (path, context_type), sections (path, section) that hold a value."""
    has = lambda *s: F.coalesce(F.bool_or(F.col("section").isin(*s)), F.lit(False))
    per = sections.groupBy("path").agg(
        has("summary").alias("s"), has("analysis_purposes").alias("p"), has("primary_objects").alias("o"), has("metrics").alias("m"),
        has("dimensions").alias("d"), has("important_fields").alias("f"), has("grain").alias("g"), has("lineage.upstream", "lineage.downstream").alias("l"),
    )
    rows = contexts.select("path", "context_type").join(per, "path", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.col("context_type")
    return rows.select(
        "path", flag("s").alias("business_meaning"), ((kind == "analysis-purpose") | flag("p")).alias("purpose"),
        (flag("o") | (kind == "business-object")).alias("business_object"), ((kind == "metric") | flag("m")).alias("metrics"), flag("d").alias("dimensions"),
        kind.isin("physical-model", "logical-model").alias("models"), flag("f").alias("fields"), flag("g").alias("grain"), flag("l").alias("lineage"),
    )
