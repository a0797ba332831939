"""Delivered template JSON in five shapes, flattened to ordered fragments.

Every loader returns rows (source_id, pointer, context_type, name, source_type, section, value,
position, relation, target_type, status). One identity row per context, one row per section
member, one row per reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

COLUMNS = ("source_id", "pointer", "context_type", "name", "source_type", "section", "value", "position", "relation", "target_type", "status")
APPS = "apps array<struct<app_name:string,features:array<struct<feature_name:string,feature_summary:string,customer_value:string,feature_description:struct<metric_name:array<string>>>>>>"
KPI = (
    "metric_summaries array<struct<summary_type:string,metrics:array<struct<metric_name:string,metric_type:string,related_counters:array<string>,related_dimensions:array<string>,interface:string,"
    "description:string,metric_group:string,unit:string,calculation_formula:string,related_sdr_field_formula:string>>>>,"
    "counter_summaries array<struct<application:string,counters:array<struct<counter_name:string,counter_name_en:string,description:string,field_description:string,counter_formula:string,"
    "field:struct<field_name:string,field_type:string,data_type:string>,related_dimensions:array<string>>>>>,"
    "dimension array<struct<dimension_name:string,sdr_name:string,field_name:string,data_type:string,field_definition:string,description:string>>"
)
# Two misspelled keys are part of the delivery format.
TABLES = (
    "tables array<struct<table_name:string,table_description:string,logic_model_name:string,layer:string,model_type:string,granularity:string,storage:string,domain:string,topic:string,app_name:string,"
    "source:struct<source_tables:array<string>,processing_logic:string>,columns:array<struct<column_name:string,column_description:string,data_type:string,content_decription:string,catagory:string,"
    "corresponding_counter_or_dim:string,unit:string>>>>"
)
GROUPS = (
    "analysis_groups array<struct<analysis_name:string,analysis_summaries:array<struct<analysis_type:string,description:string,calculation_metric_tables:array<struct<table_name:string,"
    "calculation_metrics:array<struct<metric_name:string,calculation_formula:string,measurement_point:string,interfaces:string,probes:string,dimensions:string>>>>>>>>"
)
DOMAINS = (
    "domains map<string,struct<description:string,abes:map<string,struct<description:string,bes:map<string,struct<description:string,gb922_predefined:string,source:string,source_table:string,"
    "attributes:array<struct<name:string,description:string>>>>>>>>"
)


def read_templates(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row per data file of a shape; shape documents and the manifest are not data."""
    files = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/*.json")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = files.withColumn("source_id", F.concat(F.lit("template:"), name)).withColumn("_file", name)
    return rows.where(~F.lower("_file").contains("schema") & (F.col("_file") != "delivery-manifest")).drop("_file")


def broken_files(templates: DataFrame) -> DataFrame:
    return templates.where("_corrupt_record IS NOT NULL").select("source_id")


def _emit(df: DataFrame, context_type: str, source_type: str, sections: dict, refs: list | None = None, statuses: dict | None = None) -> DataFrame:
    """Fan a context row (source_id, pointer, name, …) out to identity, section and reference rows."""
    none = F.lit(None).cast("string")

    def members(value: Column, is_list: bool) -> Column:
        as_list = value if is_list else F.array(value.cast("string"))
        return F.filter(F.coalesce(as_list, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))

    packs = [F.struct(F.lit("identity").alias("section"), F.array(F.col("name")).alias("vals"), none.alias("relation"), none.alias("target"), F.lit("EXPLICIT").alias("status"))]
    for section, value in sections.items():
        is_list = isinstance(value, tuple)
        col = value[0] if is_list else value
        status = (statuses or {}).get(section, "EXPLICIT")
        packs.append(F.struct(F.lit(section).alias("section"), members(col, is_list).alias("vals"), none.alias("relation"), none.alias("target"), F.lit(status).alias("status")))
    for relation, value, target in refs or []:
        is_list = isinstance(value, tuple)
        packs.append(F.struct(F.lit("references").alias("section"), members(value[0] if is_list else value, is_list).alias("vals"), F.lit(relation).alias("relation"),
                              F.lit(target).alias("target"), F.lit("EXPLICIT").alias("status")))
    rows = df.select("source_id", "pointer", "name", F.explode(F.array(*packs)).alias("p"))
    rows = rows.select("source_id", "pointer", "name", "p.section", "p.relation", F.col("p.target").alias("target_type"), "p.status", F.posexplode("p.vals").alias("position", "value"))
    return rows.select("source_id", "pointer", F.lit(context_type).alias("context_type"), "name", F.lit(source_type).alias("source_type"), "section", F.trim("value").alias("value"),
                       F.col("position").cast("long").alias("position"), "relation", "target_type", "status")


def _each(df: DataFrame, array: str, alias: str, pointer: str) -> DataFrame:
    """Explode an array column, extending the JSON pointer."""
    keep = [c for c in df.columns if c not in ("pointer", alias)]
    rows = df.select(*keep, "pointer", F.posexplode(array).alias("_i", alias))
    return rows.withColumn("pointer", F.concat("pointer", F.lit(f"/{pointer}/"), "_i")).drop("_i")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def from_apps(t: DataFrame) -> DataFrame:
    apps = _each(t.select("source_id", F.lit("").alias("pointer"), "apps"), "apps", "a", "apps")
    apps = apps.withColumn("name", F.trim("a.app_name"))
    topics = _emit(apps, "topic", "presales_usecases", {
        "semantic_role": F.lit("application"), "application": F.col("name"), "scenarios": (F.transform("a.features", lambda f: f["feature_name"]),)})
    feats = _each(apps.withColumnRenamed("name", "app").withColumn("features", F.col("a.features")), "features", "f", "features").withColumn("name", F.trim("f.feature_name"))
    metrics = F.col("f.feature_description.metric_name")
    scenarios = _emit(feats, "scenario", "presales_usecases", {
        "semantic_role": F.lit("app-feature"), "scenario.kind": F.lit("APP_FEATURE"), "scenario.parent_name": F.col("app"), "application": F.col("app"),
        "summary": F.col("f.feature_summary"), "customer_value": F.col("f.customer_value"), "metrics": (metrics,),
    }, [("part_of", F.col("app"), "topic"), ("uses_metric", (metrics,), "metric")])
    return _union([topics, scenarios])


def from_kpi(t: DataFrame) -> DataFrame:
    base = t.select("source_id", F.lit("").alias("pointer"), "metric_summaries", "counter_summaries", "dimension")
    m = _each(base.select("source_id", "pointer", "metric_summaries"), "metric_summaries", "s", "metric_summaries").withColumn("metrics", F.col("s.metrics"))
    m = _each(m, "metrics", "m", "metrics").withColumn("name", F.trim("m.metric_name"))
    metrics = _emit(m, "metric", "kpi_definition", {
        "summary": F.col("m.description"), "formula": F.col("m.calculation_formula"), "related_sdr_field_formula": F.col("m.related_sdr_field_formula"),
        "metrics": (F.col("m.related_counters"),), "dimensions": (F.col("m.related_dimensions"),), "unit": F.col("m.unit"), "interface": F.col("m.interface"),
        "metric_group": F.col("m.metric_group"), "metric_type": F.coalesce(F.nullif(F.col("m.metric_type"), F.lit("")), "s.summary_type"),
    }, [("calculated_from", (F.col("m.related_counters"),), "metric"), ("grouped_by", (F.col("m.related_dimensions"),), "dimension")])
    c = _each(base.select("source_id", "pointer", "counter_summaries"), "counter_summaries", "s", "counter_summaries").withColumn("counters", F.col("s.counters"))
    c = _each(c, "counters", "c", "counters").withColumn("name", F.trim("c.counter_name"))
    counters = _emit(c, "metric", "kpi_definition", {
        "summary": F.coalesce(F.nullif(F.col("c.description"), F.lit("")), "c.field_description"), "formula": F.col("c.counter_formula"),
        "important_fields": F.when(F.coalesce(F.col("c.field.field_name"), F.lit("")) != "", F.to_json("c.field")), "dimensions": (F.col("c.related_dimensions"),),
        "application": F.col("s.application"), "metric_type": F.lit("counter"),
    }, [("grouped_by", (F.col("c.related_dimensions"),), "dimension")])
    d = _each(base.select("source_id", "pointer", "dimension"), "dimension", "d", "dimension").withColumn("name", F.trim("d.dimension_name"))
    dims = _emit(d, "dimension", "kpi_definition", {
        "summary": F.coalesce(F.nullif(F.col("d.description"), F.lit("")), "d.field_definition"), "important_fields": F.col("d.field_name"), "data_type": F.col("d.data_type"),
        "physical_models": F.col("d.sdr_name"),
    }, [("provided_by", F.col("d.sdr_name"), "physical-model")])
    return _union([metrics, counters, dims])


def from_tables(t: DataFrame) -> DataFrame:
    """Physical models; raw layer, domain and topic are kept for classification."""
    tb = _each(t.select("source_id", F.lit("").alias("pointer"), "tables"), "tables", "t", "tables").withColumn("name", F.trim("t.table_name"))
    cols = F.filter("t.columns", lambda c: F.trim(F.coalesce(c["corresponding_counter_or_dim"], F.lit(""))) != "")
    has = lambda c, words: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c["catagory"], F.lit(""))), F.lit(w)) for w in words])
    metrics = F.array_distinct(F.transform(F.filter(cols, lambda c: has(c, ("指标", "度量", "counter", "metric"))), lambda c: F.trim(c["corresponding_counter_or_dim"])))
    dims = F.array_distinct(F.transform(F.filter(cols, lambda c: has(c, ("维度", "dimension"))), lambda c: F.trim(c["corresponding_counter_or_dim"])))
    fields = F.transform("t.columns", lambda c: F.to_json(c))
    return _emit(tb, "physical-model", "asset_catalog", {
        "summary": F.col("t.table_description"), "classification.layer_raw": F.col("t.layer"), "classification.topic_domain_raw": F.col("t.domain"),
        "classification.topic_raw": F.col("t.topic"), "model_type": F.col("t.model_type"), "grain": F.col("t.granularity"), "storage": F.col("t.storage"),
        "applications": F.col("t.app_name"), "lineage.upstream": (F.col("t.source.source_tables"),), "processing_logic": F.col("t.source.processing_logic"),
        "important_fields": (fields,), "metrics": (metrics,), "dimensions": (dims,),
    }, [("implements_metric", (metrics,), "metric"), ("implements_dimension", (dims,), "dimension"), ("upstream_model", (F.col("t.source.source_tables"),), "physical-model"),
        ("implements_logical_model", F.col("t.logic_model_name"), "logical-model")], {"metrics": "DERIVED", "dimensions": "DERIVED"})


def from_analysis_groups(t: DataFrame) -> DataFrame:
    g = _each(t.select("source_id", F.lit("").alias("pointer"), "analysis_groups"), "analysis_groups", "g", "analysis_groups").withColumn("name", F.trim("g.analysis_name"))
    topics = _emit(g, "topic", "modeling_documents", {
        "semantic_role": F.lit("analysis-group"), "analysis_purposes": (F.transform("g.analysis_summaries", lambda s: s["analysis_type"]),)})
    s = _each(g.withColumnRenamed("name", "group_name").withColumn("ss", F.col("g.analysis_summaries")), "ss", "s", "analysis_summaries").withColumn("name", F.trim("s.analysis_type"))
    used = F.flatten(F.transform("s.calculation_metric_tables", lambda x: F.transform(x["calculation_metrics"], lambda m: m["metric_name"])))
    catalog = F.flatten(F.transform("s.calculation_metric_tables", lambda x: F.transform(
        x["calculation_metrics"], lambda m: F.to_json(F.struct(m["metric_name"].alias("name"), x["table_name"].alias("table"))))))
    purposes = _emit(s, "analysis-purpose", "modeling_documents", {
        "semantic_role": F.lit("modeling-analysis"), "scenario.kind": F.lit("MODELING_ANALYSIS"), "scenario.parent_name": F.col("group_name"), "summary": F.col("s.description"),
        "metrics": (F.array_distinct(used),), "metric_catalog": (catalog,),
    }, [("part_of", F.col("group_name"), "topic"), ("uses_metric", (used,), "metric")])
    x = _each(s.withColumnRenamed("name", "purpose").withColumn("tt", F.col("s.calculation_metric_tables")), "tt", "t", "calculation_metric_tables").withColumn("mm", F.col("t.calculation_metrics"))
    m = _each(x, "mm", "m", "calculation_metrics").withColumn("name", F.trim("m.metric_name"))
    metrics = _emit(m, "metric", "modeling_documents", {
        "formula": F.col("m.calculation_formula"), "measurement_point": F.col("m.measurement_point"), "interfaces": F.col("m.interfaces"), "probes": F.col("m.probes"),
        "dimensions": F.col("m.dimensions"),
    }, [("used_by", F.col("purpose"), "analysis-purpose")])
    return _union([topics, purposes, metrics])


def from_domains(t: DataFrame) -> DataFrame:
    """Business objects from name-keyed maps of domains, groups and objects."""
    d = t.select("source_id", F.explode("domains").alias("domain", "d"))
    a = d.select("source_id", "domain", F.explode("d.abes").alias("abe", "a"))
    b = a.select("source_id", "domain", "abe", F.explode("a.bes").alias("name", "b"))
    esc = T.pointer_escape
    b = b.withColumn("pointer", F.concat(F.lit("/domains/"), esc(F.col("domain")), F.lit("/abes/"), esc(F.col("abe")), F.lit("/bes/"), esc(F.col("name"))))
    return _emit(b, "business-object", "sid_standard", {
        "summary": F.col("b.description"), "attributes": (F.transform("b.attributes", lambda x: F.to_json(x)),), "semantic_reference.sid_domain": F.col("domain"),
        "semantic_reference.sid_abe": F.col("abe"), "sid_source": F.col("b.source"), "source_table": F.col("b.source_table"), "gb922_predefined": F.col("b.gb922_predefined"),
    }, [("represented_by", F.col("b.source_table"), "physical-model")])


LOADERS = {"apps": (APPS, from_apps), "kpi": (KPI, from_kpi), "tables": (TABLES, from_tables), "analysis_groups": (GROUPS, from_analysis_groups), "domains": (DOMAINS, from_domains)}


LEADS = {"apps": "apps", "kpi": "metric_summaries", "tables": "tables", "analysis_groups": "analysis_groups", "domains": "domains"}


def load_shape(spark: SparkSession, root: str, shape: str) -> DataFrame:
    """Fragments of the files of one shape in a delivery; a file that does not parse fails the load."""
    schema, build = LOADERS[shape]
    rows = read_templates(spark, root, schema)
    sound = F.assert_true(F.col("_corrupt_record").isNull(), F.concat(F.lit("delivery file does not parse: "), "source_id"))
    return with_fragment_ids(build(rows.withColumn("_sound", sound).where(F.col("_sound").isNull() & F.col(LEADS[shape]).isNotNull()).drop("_sound")))


def load_all(spark: SparkSession, root: str) -> DataFrame:
    """Fragments of a whole delivery; a file that does not parse or fits no shape fails the load.

    The files are read once for the check, with the leading key of every shape.
    """
    leads = read_templates(spark, root, ", ".join(f"{k} string" for k in LEADS.values()))
    strange = leads.where(F.coalesce(*[F.col(k) for k in LEADS.values()]).isNull() | F.col("_corrupt_record").isNotNull())
    names = [r["source_id"] for r in strange.select("source_id").orderBy("source_id").limit(20).collect()]
    if names:
        raise ValueError("delivery files that do not parse or fit no shape: " + ", ".join(names))
    return _union([load_shape(spark, root, shape) for shape in LOADERS])


def with_fragment_ids(rows: DataFrame) -> DataFrame:
    """Stable id per (source, pointer, kind, name, section); members of one list share it."""
    key = T.pair_key(F.col("source_id"), F.col("pointer"), F.col("context_type"), F.col("name"), F.col("section"))
    return rows.withColumn("fragment_id", F.concat(F.lit("tpl-"), T.short_hash(key)))


def contract_errors(rows: DataFrame) -> DataFrame:
    """Contexts without a usable name, by pointer."""
    return rows.where("name IS NULL OR trim(name) = ''").select("source_id", "pointer", F.lit("empty_name").alias("error")).distinct()
