"""Fact graph built from extracted entities and facts: merging, checks, extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PROVENANCE_RANK
from ..functions import text as T
from ..scale import carry_forward


def entity_key(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_key", F.concat_ws(":", "type", T.fact_key(F.coalesce(F.nullif(F.col("code"), F.lit("")), F.col("name")))))


def merge_entities(mentions: DataFrame) -> dict[str, DataFrame]:
    """Entities by (type, normalised code or name) from mentions in ``seq`` order.

    ``mentions``: (seq, type, code, name, description, aliases, properties, evidence_id). The
    first name and first non-empty description stay, later properties win. Aliases, properties
    and evidence stay rows, so an entity mentioned a billion times is never one value.
    """
    keyed = entity_key(mentions)
    entities = keyed.groupBy("entity_key", "type").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("code", "seq").alias("code"),
        F.coalesce(F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("seq"))), F.lit("")).alias("description"),
        F.count("*").alias("mentions"),
    )
    aliases = keyed.select("entity_key", F.explode("aliases").alias("alias")).where("trim(alias) <> ''").distinct()
    props = keyed.select("entity_key", "seq", F.explode("properties").alias("property", "value"))
    props = props.groupBy("entity_key", "property").agg(F.max_by("value", "seq").alias("value"))
    evidence = keyed.select("entity_key", "evidence_id").where("evidence_id IS NOT NULL").distinct()
    return {"entities": entities, "aliases": aliases, "properties": props, "evidence": evidence}


def merge_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """Facts by (subject, predicate, object, qualifiers): highest confidence, strongest assertion."""
    key = ["subject", "predicate", "object", "qualifiers"]
    rank = F.create_map(*[F.lit(x) for kv in PROVENANCE_RANK.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, v in PROVENANCE_RANK.items() for x in (v, k)])
    merged = facts.groupBy(*key).agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("confidence"))).alias("confidence"),
        F.try_element_at(name, F.max(F.try_element_at(rank, F.col("assertion")))).alias("assertion"),
    )
    merged = merged.withColumn("status", F.when(F.col("assertion").isin("EXPLICIT", "DERIVED"), "VERIFIED").otherwise("CANDIDATE"))
    merged = merged.withColumn("fact_id", F.concat(F.lit("fact:"), T.short_hash(T.pair_key(*key))))
    return {"facts": merged, "evidence": facts.select(*key, "evidence_id").distinct()}


def dangling(facts: DataFrame, entities: DataFrame, fact_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """(code, subject) of facts with unknown ends or evidence."""
    known = entities.select("entity_key")
    ends = facts.select("fact_id", F.col("subject").alias("entity_key")).unionByName(facts.select("fact_id", F.col("object").alias("entity_key")))
    broken = ends.join(known, "entity_key", "left_anti").select(F.lit("dangling_endpoint").alias("code"), F.col("fact_id").alias("subject"))
    proofless = fact_evidence.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select(F.lit("missing_evidence").alias("code"), "evidence_id")
    return broken.union(proofless).distinct()


def definition(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity with the facts it takes part in: (entity_key, fact_id, role)."""
    sides = facts.select(F.col("subject").alias("entity_key"), "fact_id", F.lit("subject").alias("role")).unionByName(
        facts.select(F.col("object").alias("entity_key"), "fact_id", F.lit("object").alias("role"))
    )
    return sides.join(entities.select("entity_key"), "entity_key", "left_semi")


def catalog_rows(rows: DataFrame) -> DataFrame:
    """Model catalogue sheet: layer, domain and subject cells hold until replaced.

    ``rows``: (sheet, seq, layer, domain, subject, model). A header row (no model) that gives a
    layer clears domain and subject below it; one that gives a domain clears the subject.
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    r = rows.select("sheet", "seq", *[blank(c).alias(c) for c in ("layer", "domain", "subject", "model")])
    # "-" marks a cleared cell so that it, not an older value, is carried on.
    header = F.col("model").isNull()
    clear_domain = header & F.col("layer").isNotNull() & F.col("domain").isNull()
    clear_subject = header & (F.col("layer").isNotNull() | F.col("domain").isNotNull()) & F.col("subject").isNull()
    r = r.withColumn("domain", F.when(clear_domain, "\u0000").otherwise(F.col("domain"))).withColumn("subject", F.when(clear_subject, "\u0000").otherwise(F.col("subject")))
    filled = carry_forward(r, ["sheet"], "seq", ["layer", "domain", "subject"])
    out = lambda c: F.when(F.col(c) == "\u0000", F.lit("")).otherwise(F.coalesce(c, F.lit(""))).alias(c)
    return filled.where("model IS NOT NULL").select("sheet", "seq", "model", out("layer"), out("domain"), out("subject"))


def kpi_facts(rows: DataFrame) -> DataFrame:
    """Metric definition rows -> (subject, predicate, object, confidence): formula terms, dimensions, interface.

    ``rows``: (metric, formula, dimensions, interface).
    """
    terms = rows.select("metric", F.explode(T.bracket_terms(F.col("formula"))).alias("object"))
    terms = terms.where((T.fact_key(F.col("object")) != T.fact_key(F.col("metric"))) & ~F.col("object").contains("统计周期"))
    dims = F.filter(F.transform(F.split("dimensions", "[、,，/]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.endswith("维度"))
    dimensions = rows.select("metric", F.explode(dims).alias("object"))
    seen = rows.where("trim(interface) <> ''").select("metric", F.col("interface").alias("object"))

    def fact(df, predicate, confidence):
        return df.select(F.col("metric").alias("subject"), F.lit(predicate).alias("predicate"), "object", F.lit(confidence).alias("confidence"))

    return fact(terms, "USES_COUNTER", 0.96).unionByName(fact(dimensions, "HAS_DIMENSION", 0.96)).unionByName(fact(seen, "OBSERVED_ON", 0.95)).distinct()


def field_facts(rows: DataFrame) -> DataFrame:
    """Data dictionary rows (model, field, role) -> HAS_FIELD facts and candidate HAS_ROLE facts."""
    has = rows.select(F.col("model").alias("subject"), F.lit("HAS_FIELD").alias("predicate"), F.concat_ws(".", "model", "field").alias("object"),
                      F.lit("EXPLICIT").alias("assertion"), F.lit(0.99).alias("confidence"))
    kind = F.when(F.lower("role").contains("dimension"), "DIMENSION").when(F.lower("role").contains("counter"), "COUNTER").when(F.lower("role").contains("measure"), "MEASURE")
    role = rows.withColumn("kind", kind).where("kind IS NOT NULL").select(
        F.concat_ws(".", "model", "field").alias("subject"), F.lit("HAS_ROLE").alias("predicate"), F.concat_ws(":", "kind", "field").alias("object"),
        F.lit("CANDIDATE").alias("assertion"), F.lit(0.72).alias("confidence"),
    )
    return has.unionByName(role)


def classify_sources(files: DataFrame) -> DataFrame:
    """Source kind from the file name: files (path)."""
    name = F.lower(F.regexp_extract("path", r"([^/\\]+)$", 1))
    kind = (
        F.when(name.rlike("资产目录|model.asset.catalog|datacube-model-asset"), "MODEL_CATALOG").when(name.rlike("数据字典|data.dictionary"), "DATA_DICTIONARY")
        .when(name.rlike("建模文档|kpi|kqi|modeling-document"), "KPI_DEFINITION").when(name.rlike("售前|专题|usecase|use-case|metro"), "USE_CASE_SPECIFICATION")
        .when(name.rlike("etl|dataflow|数据流"), "ETL_SPECIFICATION").otherwise("UNKNOWN")
    )
    return files.withColumn("source_kind", kind)
