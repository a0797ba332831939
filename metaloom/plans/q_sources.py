"""Readers and contracts: sheet regions, headings, table rules, templates, inventories, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import elements as E
from ..operators import facts as FX
from ..operators import mentions as M
from ..operators import search as S
from ..scale import cut_lineage, ensure_checkpoint_dir
from ..sources import documents as D
from ..sources import files as FI
from ..sources import handoff as HO
from ..sources import snapshot as SN
from ..sources import templates as TP
from ..streaming import incremental as INC
from ..streaming.segments import DeltaIndex
from . import q_serving as SV
from .registry import Registry
from .tables import table

R = Registry()


# ----------------------------------------------------------------------------- sheets <- documents
def sheets(spark, sf):
    """Each document is a sheet, each line a row, words are cells."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return d.select("sheet", (F.col("row") + 1).cast("long").alias("row"), F.split("line", " ").alias("cells"))


SHEET_SQL = """
ln AS (SELECT sheet, CAST(i AS BIGINT) AS row, string_split(l, ' ') AS cells FROM
  (SELECT doc_id AS sheet, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
lb AS (SELECT *, len(list_filter(cells, lambda c: trim(c) <> '')) = 0 AS blank FROM ln),
le AS (SELECT *, coalesce(max(CASE WHEN blank THEN row END) OVER (PARTITION BY sheet ORDER BY row), 0) AS edge FROM lb),
rg AS (SELECT sheet, row, cells, dense_rank() OVER (PARTITION BY sheet ORDER BY edge) AS region, min(row) OVER (PARTITION BY sheet, edge) AS start_row FROM le WHERE NOT blank)"""


@R.query("sheet_regions", f"WITH {SHEET_SQL} SELECT sheet, row, region, start_row FROM rg")
def sheet_regions(spark, sf):
    return D.sheet_regions(sheets(spark, sf)).select("sheet", "row", "region", "start_row")


@R.query(
    "header_inference",
    f"""WITH {SHEET_SQL}, f AS (SELECT sheet, region, row_number() OVER (PARTITION BY sheet, region ORDER BY row) AS n, list_filter(cells, lambda c: trim(c) <> '') AS c FROM rg),
    t AS (SELECT sheet, region, n, len(c) AS k, CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: NOT regexp_full_match(trim(x), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'))) / len(c) ELSE 0 END AS s FROM f WHERE n <= 2),
    p AS (SELECT sheet, region, max(k) FILTER (n = 1) AS k1, max(s) FILTER (n = 1) AS s1, max(k) FILTER (n = 2) AS k2, max(s) FILTER (n = 2) AS s2 FROM t GROUP BY ALL)
    SELECT sheet, region, CAST(CASE WHEN k1 < 2 OR s1 < 0.6 THEN 0 WHEN k2 IS NOT NULL AND k1 <= greatest(2, k2 // 2) AND s2 >= 0.6 THEN 2 ELSE 1 END AS BIGINT) AS header_rows FROM p""",
)
def header_inference(spark, sf):
    return D.header_rows(D.sheet_regions(sheets(spark, sf)))


HTML_SQL = r"""
ht AS (SELECT page_id AS document, regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'),
  '(?is)<(?:h[1-6]|p|li)\b[^>]*>') AS tags, string_split_regex(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'),
  '(?is)<(?:h[1-6]|p|li)\b[^>]*>') AS parts FROM pages),
hp AS (SELECT document, i - 1 AS seq, lower(regexp_extract(tags[i], '^<([A-Za-z0-9]+)', 1)) AS tag,
  trim(regexp_replace(regexp_replace(regexp_replace(parts[i + 1], '(?is)</(?:h[1-6]|p|li|ul|article|body)>.*', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM ht)),
he AS (SELECT document, CAST(seq AS BIGINT) AS seq, CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'li' THEN 'item' ELSE 'paragraph' END AS kind, CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS level, text FROM hp WHERE text <> '')"""


@R.query("html_elements", f"WITH {HTML_SQL} SELECT * FROM he")
def html_elements(spark, sf):
    return D.html_elements(table(spark, sf, "pages"))


LEVELS_SQL = f"""{HTML_SQL}, lv AS (SELECT document, seq, text, coalesce(level, CASE kind WHEN 'item' THEN 2 END) AS level FROM he)"""


OPEN_SQL = ", ".join(f"max(CASE WHEN level <= {n} THEN seq END) OVER w AS s{n}" for n in range(1, 7))
TITLE_SQL = ", ".join(f"(SELECT text FROM lv l{n} WHERE l{n}.document = p.document AND l{n}.seq = p.s{n} AND l{n}.level = {n})" for n in range(1, 7))


@R.query(
    "heading_sections",
    f"""WITH {LEVELS_SQL}, p AS (SELECT *, {OPEN_SQL} FROM lv WINDOW w AS (PARTITION BY document ORDER BY seq))
    SELECT p.document, p.seq, nullif(concat_ws(' > ', {TITLE_SQL}), '') AS section FROM p""",
)
def heading_sections(spark, sf):
    """Headings have the level of their tag; list items act as headings of level 2."""
    e = D.html_elements(table(spark, sf, "pages"))
    return D.heading_sections(e.withColumn("level", F.coalesce("level", F.when(F.col("kind") == "item", 2)))).select("document", "seq", "section")


@R.query(
    "raw_unit_match",
    f"""WITH {HTML_SQL} SELECT document, seq, regexp_extract(text, '^([A-Za-z]+) [a-z]+ ([a-z]+)', 1) AS first, regexp_extract(text, '^([A-Za-z]+) [a-z]+ ([a-z]+)', 2) AS third FROM he WHERE kind = 'paragraph' AND regexp_matches(text, '^([A-Za-z]+) [a-z]+ ([a-z]+)')""",
)
def raw_unit_match(spark, sf):
    e = D.html_elements(table(spark, sf, "pages")).withColumn("literal", F.col("text"))
    return D.match_units(e, "^([A-Za-z]+) [a-z]+ ([a-z]+)", "paragraph", "%", ("first", "third")).select("document", "seq", "first", "third")


# ----------------------------------------------------------------------------- table rules <- customer
def rule_tables(spark, sf):
    """One table per nation; even nations are metric sheets, odd ones model catalogues."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("table_id"), F.when(F.col("n_nationkey") % 2 == 0, "kpi_kqi").otherwise("asset_catalog").alias("source_type"))
    even = F.col("source_type") == "kpi_kqi"
    names = F.when(even, F.array(F.lit("指标 / Metric Name"), F.lit("计算公式"), F.lit("维度"), F.lit("Data_Source"))).otherwise(
        F.array(F.lit("Table Name"), F.lit("模型描述"), F.lit("统计粒度"), F.lit("Subject")))
    heads = n.select("table_id", F.posexplode(names).alias("position", "header"))
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("row"),
        F.posexplode(F.array(F.col("c_name"), F.col("c_mktsegment"), F.concat("c_mktsegment", F.lit("，"), F.lower("c_mktsegment")), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("src "), "c_nationkey")))).alias("position", "value"),
    )
    return n, heads, c


@R.query(
    "column_roles",
    """SELECT n_nationkey AS table_id, r AS role, CAST(p AS INTEGER) AS position FROM nation, (SELECT unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS odd, unnest(['metric', 'formula', 'dimension', 'source', 'model', 'description', 'grain', 'topic']) AS r, unnest([0, 1, 2, 3, 0, 1, 2, 3]) AS p) WHERE n_nationkey % 2 = odd""",
)
def column_roles(spark, sf):
    _, heads, _ = rule_tables(spark, sf)
    kept = ["metric", "formula", "dimension", "source", "model", "description", "grain", "topic"]
    return D.map_columns(heads, kept)


@R.query(
    "rule_extraction",
    """WITH c AS (SELECT c_nationkey AS table_id, c_custkey AS row, c_name AS name, c_mktsegment AS m, CASE WHEN c_acctbal > 0 THEN 'src ' || c_nationkey END AS s, c_nationkey % 2 = 0 AS even FROM customer),
    o AS (SELECT table_id, row, CASE WHEN even THEN 'metric' ELSE 'physical-model' END AS context_type, name, 'identity' AS section, 0 AS position, name AS value, NULL AS relation, NULL AS target_type FROM c
      UNION ALL SELECT table_id, row, 'metric', name, 'formula', 0, m, NULL, NULL FROM c WHERE even UNION ALL SELECT table_id, row, 'metric', name, 'dimensions', 0, m, NULL, NULL FROM c WHERE even UNION ALL SELECT table_id, row, 'metric', name, 'dimensions', 1, lower(m), NULL, NULL FROM c WHERE even
      UNION ALL SELECT table_id, row, 'metric', name, 'references', 0, s, 'supported_by', 'physical-model' FROM c WHERE even AND s IS NOT NULL
      UNION ALL SELECT table_id, row, 'physical-model', name, 'summary', 0, m, NULL, NULL FROM c WHERE NOT even UNION ALL SELECT table_id, row, 'physical-model', name, 'grain', 0, m, NULL, NULL FROM c WHERE NOT even
      UNION ALL SELECT table_id, row, 'physical-model', name, 'grain', 1, lower(m), NULL, NULL FROM c WHERE NOT even UNION ALL SELECT table_id, row, 'physical-model', name, 'topic', 0, s, NULL, NULL FROM c WHERE NOT even AND s IS NOT NULL)
    SELECT * FROM o""",
)
def rule_extraction(spark, sf):
    tables, _, cells = rule_tables(spark, sf)
    return D.extract_rows(tables, cells, column_roles(spark, sf))


# ----------------------------------------------------------------------------- template shapes
OUT = ["source_id", "pointer", "context_type", "name", "section", "value", "position", "relation", "target_type"]


@R.query(
    "template_apps",
    """WITH o AS (SELECT 'order-' || o_orderkey AS src, 'customer ' || o_custkey AS app, 'feature ' || o_orderkey AS feat, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS summ, o_orderstatus AS m1, o_orderpriority AS m2 FROM orders),
    r AS (SELECT src, '/apps/0' AS pointer, 'topic' AS context_type, app AS name, 'identity' AS section, app AS value, 0 AS position, NULL AS relation, NULL AS target_type FROM o
      UNION ALL SELECT src, '/apps/0', 'topic', app, 'semantic_role', 'application', 0, NULL, NULL FROM o UNION ALL SELECT src, '/apps/0', 'topic', app, 'application', app, 0, NULL, NULL FROM o UNION ALL SELECT src, '/apps/0', 'topic', app, 'scenarios', feat, 0, NULL, NULL FROM o
      UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'identity', feat, 0, NULL, NULL FROM o UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'semantic_role', 'app-feature', 0, NULL, NULL FROM o
      UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'scenario.kind', 'APP_FEATURE', 0, NULL, NULL FROM o UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'scenario.parent_name', app, 0, NULL, NULL FROM o
      UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'application', app, 0, NULL, NULL FROM o UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'summary', summ, 0, NULL, NULL FROM o WHERE summ IS NOT NULL
      UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'metrics', m1, 0, NULL, NULL FROM o UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'metrics', m2, 1, NULL, NULL FROM o
      UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'references', app, 0, 'part_of', 'topic' FROM o UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'references', m1, 0, 'uses_metric', 'metric' FROM o UNION ALL SELECT src, '/apps/0/features/0', 'scenario', feat, 'references', m2, 1, 'uses_metric', 'metric' FROM o)
    SELECT src AS source_id, pointer, context_type, name, section, value, CAST(position AS BIGINT) AS position, relation, target_type, 'tpl-' || substr(sha256(src || chr(31) || pointer || chr(31) || context_type || chr(31) || name || chr(31) || section), 1, 20) AS fragment_id FROM r""",
)
def template_apps(spark, sf):
    """Every order is one delivered file with one application and one feature."""
    o = table(spark, sf, "orders")
    feature = F.struct(
        F.concat(F.lit("feature "), "o_orderkey").alias("feature_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("feature_summary"), F.lit(None).cast("string").alias("customer_value"),
        F.struct(F.array("o_orderstatus", "o_orderpriority").alias("metric_name")).alias("feature_description"),
    )
    apps = F.array(F.struct(F.concat(F.lit("customer "), "o_custkey").alias("app_name"), F.array(feature).alias("features")))
    rows = TP.from_apps(o.select(F.concat(F.lit("order-"), "o_orderkey").alias("source_id"), apps.alias("apps")))
    return TP.with_fragment_ids(rows).select(*OUT, "fragment_id")


@R.query(
    "template_tables",
    """WITH p AS (SELECT 'part-' || p_partkey AS src, 'T_' || p_partkey AS name, p_name, p_brand, p_type, p_size FROM part),
    s AS (SELECT src, name, unnest([{'s': 'identity', 'v': name, 'p': 0, 'r': NULL, 't': NULL}, {'s': 'summary', 'v': p_name, 'p': 0, 'r': NULL, 't': NULL}, {'s': 'classification.layer_raw', 'v': p_type, 'p': 0, 'r': NULL, 't': NULL}, {'s': 'grain', 'v': 'size ' || p_size, 'p': 0, 'r': NULL, 't': NULL},
      {'s': 'lineage.upstream', 'v': 'U_' || p_brand, 'p': 0, 'r': NULL, 't': NULL}, {'s': 'metrics', 'v': p_name, 'p': 0, 'r': NULL, 't': NULL}, {'s': 'dimensions', 'v': p_brand, 'p': 0, 'r': NULL, 't': NULL}, {'s': 'references', 'v': p_name, 'p': 0, 'r': 'implements_metric', 't': 'metric'},
      {'s': 'references', 'v': p_brand, 'p': 0, 'r': 'implements_dimension', 't': 'dimension'}, {'s': 'references', 'v': 'U_' || p_brand, 'p': 0, 'r': 'upstream_model', 't': 'physical-model'}, {'s': 'references', 'v': 'L ' || p_type, 'p': 0, 'r': 'implements_logical_model', 't': 'logical-model'},
      {'s': 'important_fields', 'v': '{"column_name":"c1","data_type":"string","catagory":"Metric 度量","corresponding_counter_or_dim":"' || p_name || '"}', 'p': 0, 'r': NULL, 't': NULL},
      {'s': 'important_fields', 'v': '{"column_name":"c2","data_type":"string","catagory":"Dimension","corresponding_counter_or_dim":"' || p_brand || '"}', 'p': 1, 'r': NULL, 't': NULL},
      {'s': 'important_fields', 'v': '{"column_name":"c3","data_type":"string","catagory":"other"}', 'p': 2, 'r': NULL, 't': NULL}]) AS x FROM p)
    SELECT src AS source_id, '/tables/0' AS pointer, 'physical-model' AS context_type, name, x.s AS section, x.v AS value, CAST(x.p AS BIGINT) AS position, x.r AS relation, x.t AS target_type FROM s""",
)
def template_tables(spark, sf):
    """Every part is one delivered file with one table of three columns."""
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    col = lambda name, cat, target: F.struct(
        F.lit(name).alias("column_name"), none.alias("column_description"), F.lit("string").alias("data_type"), none.alias("content_decription"), F.lit(cat).alias("catagory"),
        target.alias("corresponding_counter_or_dim"), none.alias("unit"))
    t = F.struct(
        F.concat(F.lit("T_"), "p_partkey").alias("table_name"), F.col("p_name").alias("table_description"), F.concat(F.lit("L "), "p_type").alias("logic_model_name"), F.col("p_type").alias("layer"),
        none.alias("model_type"), F.concat(F.lit("size "), "p_size").alias("granularity"), none.alias("storage"), none.alias("domain"), none.alias("topic"), none.alias("app_name"),
        F.struct(F.array(F.concat(F.lit("U_"), "p_brand")).alias("source_tables"), none.alias("processing_logic")).alias("source"),
        F.array(col("c1", "Metric 度量", F.col("p_name")), col("c2", "Dimension", F.col("p_brand")), col("c3", "other", none)).alias("columns"),
    )
    rows = TP.from_tables(p.select(F.concat(F.lit("part-"), "p_partkey").alias("source_id"), F.array(t).alias("tables")))
    return rows.select(*OUT)


@R.query(
    "template_domains",
    """SELECT 'c' || c_custkey AS source_id, '/domains/' || replace(r_name, '/', '~1') || '/abes/' || n_name || '/bes/' || replace(c_name || '/~x', '~', '~0').replace('/', '~1') AS pointer, 'business-object' AS context_type, c_name || '/~x' AS name, x.s AS section, x.v AS value, 0::BIGINT AS position, x.r AS relation, x.t AS target_type
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey, LATERAL (SELECT unnest([{'s': 'identity', 'v': c_name || '/~x', 'r': NULL, 't': NULL}, {'s': 'summary', 'v': c_mktsegment, 'r': NULL, 't': NULL}, {'s': 'semantic_reference.sid_domain', 'v': r_name, 'r': NULL, 't': NULL},
      {'s': 'semantic_reference.sid_abe', 'v': n_name, 'r': NULL, 't': NULL}, {'s': 'source_table', 'v': 'T_' || n_name, 'r': NULL, 't': NULL}, {'s': 'references', 'v': 'T_' || n_name, 'r': 'represented_by', 't': 'physical-model'}]) AS x)""",
)
def template_domains(spark, sf):
    none = F.lit(None).cast("string")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    be = F.struct(F.col("c_mktsegment").alias("description"), none.alias("gb922_predefined"), none.alias("source"), F.concat(F.lit("T_"), "n_name").alias("source_table"),
                  F.array().cast("array<struct<name:string,description:string>>").alias("attributes"))
    bes = F.create_map(F.concat("c_name", F.lit("/~x")), be)
    abes = F.create_map(F.col("n_name"), F.struct(none.alias("description"), bes.alias("bes")))
    doms = F.create_map(F.col("r_name"), F.struct(none.alias("description"), abes.alias("abes")))
    return TP.from_domains(c.select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), doms.alias("domains"))).select(*OUT)


@R.query(
    "template_kpi",
    """WITH p AS (SELECT 'p' || p_partkey AS src, 'KPI ' || p_partkey AS k, 'CNT ' || p_partkey AS c, 'DIM ' || p_partkey AS d, * FROM part), r AS (
      SELECT src, '/metric_summaries/0/metrics/0' AS pointer, 'metric' AS ct, k AS name, unnest([{'s': 'identity', 'v': k, 'r': NULL}, {'s': 'formula', 'v': p_type, 'r': NULL}, {'s': 'metrics', 'v': c, 'r': NULL}, {'s': 'dimensions', 'v': d, 'r': NULL}, {'s': 'metric_type', 'v': 'base', 'r': NULL}, {'s': 'references', 'v': c, 'r': 'calculated_from'}, {'s': 'references', 'v': d, 'r': 'grouped_by'}]) AS x FROM p
      UNION ALL SELECT src, '/counter_summaries/0/counters/0', 'metric', c, unnest([{'s': 'identity', 'v': c, 'r': NULL}, {'s': 'summary', 'v': p_name, 'r': NULL}, {'s': 'dimensions', 'v': d, 'r': NULL}, {'s': 'application', 'v': p_brand, 'r': NULL}, {'s': 'metric_type', 'v': 'counter', 'r': NULL}, {'s': 'references', 'v': d, 'r': 'grouped_by'}]) FROM p
      UNION ALL SELECT src, '/dimension/0', 'dimension', d, unnest([{'s': 'identity', 'v': d, 'r': NULL}, {'s': 'important_fields', 'v': 'f', 'r': NULL}, {'s': 'physical_models', 'v': 'S_' || p_brand, 'r': NULL}, {'s': 'references', 'v': 'S_' || p_brand, 'r': 'provided_by'}]) FROM p)
    SELECT src AS source_id, pointer, ct AS context_type, name, x.s AS section, x.v AS value, 0::BIGINT AS position, x.r AS relation, CASE x.r WHEN 'calculated_from' THEN 'metric' WHEN 'grouped_by' THEN 'dimension' WHEN 'provided_by' THEN 'physical-model' END AS target_type FROM r""",
)
def template_kpi(spark, sf):
    none = F.lit(None).cast("string")
    p = table(spark, sf, "part")
    c, d = F.concat(F.lit("CNT "), "p_partkey"), F.concat(F.lit("DIM "), "p_partkey")
    m = F.struct(F.concat(F.lit("KPI "), "p_partkey").alias("metric_name"), F.lit("").alias("metric_type"), F.array(c).alias("related_counters"), F.array(d).alias("related_dimensions"), none.alias("interface"), none.alias("description"),
                 none.alias("metric_group"), none.alias("unit"), F.col("p_type").alias("calculation_formula"), none.alias("related_sdr_field_formula"))
    k = F.struct(c.alias("counter_name"), none.alias("counter_name_en"), F.lit("").alias("description"), F.col("p_name").alias("field_description"), none.alias("counter_formula"),
                 F.struct(none.alias("field_name"), none.alias("field_type"), none.alias("data_type")).alias("field"), F.array(d).alias("related_dimensions"))
    dim = F.struct(d.alias("dimension_name"), F.concat(F.lit("S_"), "p_brand").alias("sdr_name"), F.lit("f").alias("field_name"), none.alias("data_type"), none.alias("field_definition"), none.alias("description"))
    rows = TP.from_kpi(p.select(
        F.concat(F.lit("p"), "p_partkey").alias("source_id"), F.array(F.struct(F.lit("base").alias("summary_type"), F.array(m).alias("metrics"))).alias("metric_summaries"),
        F.array(F.struct(F.col("p_brand").alias("application"), F.array(k).alias("counters"))).alias("counter_summaries"), F.array(dim).alias("dimension"),
    ))
    return rows.select(*OUT)


@R.query(
    "template_analysis_groups",
    """WITH p AS (SELECT 'p' || p_partkey AS src, 'G ' || p_type AS g, 'A ' || p_partkey AS a, p_name AS m1, p_brand AS m2, 'T' || p_size AS t FROM part), r AS (
      SELECT src, '/analysis_groups/0' AS pointer, 'topic' AS ct, g AS name, unnest([{'s': 'identity', 'v': g, 'p': 0, 'r': NULL}, {'s': 'semantic_role', 'v': 'analysis-group', 'p': 0, 'r': NULL}, {'s': 'analysis_purposes', 'v': a, 'p': 0, 'r': NULL}]) AS x FROM p
      UNION ALL SELECT src, '/analysis_groups/0/analysis_summaries/0', 'analysis-purpose', a, unnest([{'s': 'identity', 'v': a, 'p': 0, 'r': NULL}, {'s': 'semantic_role', 'v': 'modeling-analysis', 'p': 0, 'r': NULL}, {'s': 'scenario.kind', 'v': 'MODELING_ANALYSIS', 'p': 0, 'r': NULL}, {'s': 'scenario.parent_name', 'v': g, 'p': 0, 'r': NULL},
        {'s': 'metrics', 'v': m1, 'p': 0, 'r': NULL}, {'s': 'metrics', 'v': m2, 'p': 1, 'r': NULL}, {'s': 'metric_catalog', 'v': '{"name":"' || m1 || '","table":"' || t || '"}', 'p': 0, 'r': NULL}, {'s': 'metric_catalog', 'v': '{"name":"' || m2 || '","table":"' || t || '"}', 'p': 1, 'r': NULL},
        {'s': 'references', 'v': g, 'p': 0, 'r': 'part_of'}, {'s': 'references', 'v': m1, 'p': 0, 'r': 'uses_metric'}, {'s': 'references', 'v': m2, 'p': 1, 'r': 'uses_metric'}]) FROM p
      UNION ALL SELECT src, '/analysis_groups/0/analysis_summaries/0/calculation_metric_tables/0/calculation_metrics/' || i, 'metric', CASE i WHEN 0 THEN m1 ELSE m2 END, unnest([{'s': 'identity', 'v': CASE i WHEN 0 THEN m1 ELSE m2 END, 'p': 0, 'r': NULL}, {'s': 'formula', 'v': 'f', 'p': 0, 'r': NULL}, {'s': 'references', 'v': a, 'p': 0, 'r': 'used_by'}])
        FROM p, (SELECT unnest([0, 1]) AS i))
    SELECT src AS source_id, pointer, ct AS context_type, name, x.s AS section, x.v AS value, CAST(x.p AS BIGINT) AS position, x.r AS relation, CASE x.r WHEN 'part_of' THEN 'topic' WHEN 'uses_metric' THEN 'metric' WHEN 'used_by' THEN 'analysis-purpose' END AS target_type FROM r""",
)
def template_analysis_groups(spark, sf):
    none = F.lit(None).cast("string")
    p = table(spark, sf, "part")
    metric = lambda c: F.struct(F.col(c).alias("metric_name"), F.lit("f").alias("calculation_formula"), none.alias("measurement_point"), none.alias("interfaces"), none.alias("probes"), none.alias("dimensions"))
    tables = F.array(F.struct(F.concat(F.lit("T"), "p_size").alias("table_name"), F.array(metric("p_name"), metric("p_brand")).alias("calculation_metrics")))
    summary = F.struct(F.concat(F.lit("A "), "p_partkey").alias("analysis_type"), none.alias("description"), tables.alias("calculation_metric_tables"))
    group = F.struct(F.concat(F.lit("G "), "p_type").alias("analysis_name"), F.array(summary).alias("analysis_summaries"))
    return TP.from_analysis_groups(p.select(F.concat(F.lit("p"), "p_partkey").alias("source_id"), F.array(group).alias("analysis_groups"))).select(*OUT)


@R.query(
    "json_pointer_select",
    "SELECT event_id, '/k' AS pointer, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events",
)
def json_pointer_select(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("v"))
    rows = D.select_pointer(ev, "v", "/*", ["event_id"])
    return rows.select("event_id", "pointer", F.variant_get("value", "$", "bigint").alias("value"))


@R.query(
    "fragment_contract",
    """SELECT 'f' || o_orderkey AS fragment_id, unnest(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'missing_candidate_name' END, CASE WHEN o_orderstatus = 'P' THEN 'invalid_status' END, CASE WHEN o_totalprice > 400000 THEN 'confidence_out_of_range' END,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 'missing_evidence' END, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'evidence_without_location' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'incomplete_reference' END], lambda x: x IS NOT NULL)) AS error FROM orders""",
)
def fragment_contract(spark, sf):
    o = table(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    loc = lambda path: F.struct(F.struct(F.lit("s").alias("source_id"), path.alias("path")).alias("source"))
    evidence = F.when(pr == "2-HIGH", F.filter(F.array(loc(F.lit("p"))), lambda e: F.lit(False))).when(pr == "3-MEDIUM", F.array(loc(F.lit("")))).otherwise(F.array(loc(F.lit("p"))))
    rows = o.select(
        F.concat(F.lit("f"), "o_orderkey").alias("fragment_id"), F.lit("metric").alias("context_type"), F.when(pr != "1-URGENT", F.lit("n")).alias("candidate_name"), F.lit("summary").alias("section_type"), F.lit("x").alias("payload"),
        F.when(F.col("o_orderstatus") == "P", "GUESSED").otherwise("EXPLICIT").alias("status"), (F.col("o_totalprice") / 400000).alias("confidence"), evidence.alias("evidence"),
        F.array(F.struct(F.lit("uses").alias("relation"), F.when(pr == "5-LOW", "").otherwise("t").alias("raw_target"))).alias("references"),
    )
    return HO.fragment_errors(rows)


@R.query(
    "inventory_diff",
    """WITH d AS (SELECT 'f/' || c_custkey || '.json' AS path, c_mktsegment AS kind, sha256(c_name) AS sha FROM customer WHERE c_acctbal > -800), a AS (SELECT 'f/' || c_custkey || '.json' AS path, CASE WHEN c_nationkey = 3 THEN 'OTHER' ELSE c_mktsegment END AS kind, sha256(CASE WHEN c_nationkey = 4 THEN 'x' ELSE c_name END) AS sha FROM customer WHERE c_acctbal < 9500)
    SELECT coalesce(d.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'extra_in_manifest' WHEN d.path IS NULL THEN 'missing_in_manifest' WHEN d.kind <> a.kind THEN 'kind_mismatch' WHEN d.sha <> a.sha THEN 'fingerprint_mismatch' END AS problem FROM d FULL JOIN a ON a.path = d.path
    WHERE a.path IS NULL OR d.path IS NULL OR d.kind <> a.kind OR d.sha <> a.sha""",
)
def inventory_diff(spark, sf):
    c = table(spark, sf, "customer").withColumn("path", F.concat(F.lit("f/"), "c_custkey", F.lit(".json")))
    d = c.where("c_acctbal > -800").select("path", F.col("c_mktsegment").alias("kind"), F.sha2("c_name", 256).alias("sha256"))
    a = c.where("c_acctbal < 9500").select("path", F.when(F.col("c_nationkey") == 3, "OTHER").otherwise(F.col("c_mktsegment")).alias("kind"), F.sha2(F.when(F.col("c_nationkey") == 4, "x").otherwise(F.col("c_name")), 256).alias("sha256"))
    return FI.inventory_diff(d, a)


@R.query(
    "frozen_corpus_check",
    """WITH f AS (SELECT 'd' || doc_id AS path, sha256(text) AS s, n_chars AS b FROM documents WHERE lang <> 'es'), a AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END) AS s, n_chars AS b FROM documents WHERE lang <> 'fr')
    SELECT coalesce(f.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN f.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM f FULL JOIN a ON a.path = f.path WHERE f.s IS DISTINCT FROM a.s""",
)
def frozen_corpus_check(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    frozen = d.where("lang <> 'es'").select("path", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    now = d.where("lang <> 'fr'").select("path", F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    return FI.verify_frozen(frozen, now)


@R.query(
    "source_classifier",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'KPI_DEFINITION' WHEN 'SMALL' THEN 'ETL_SPECIFICATION' WHEN 'LARGE' THEN 'DATA_DICTIONARY' WHEN 'MEDIUM' THEN 'MODEL_CATALOG' WHEN 'ECONOMY' THEN 'USE_CASE_SPECIFICATION' ELSE 'UNKNOWN' END AS source_kind FROM part""",
)
def source_classifier(spark, sf):
    t = F.col("p_type")
    name = F.when(t == "PROMO", "My KPI.xlsx").when(t == "SMALL", "nightly-ETL.sql").when(t == "LARGE", "Data-Dictionary.xlsx").when(t == "MEDIUM", "资产目录.xlsx").when(t == "ECONOMY", "metro.docx").otherwise("notes.txt")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/kpi/"), "p_brand", F.lit("/"), name).alias("path"))
    return FX.classify_sources(rows).select("p_partkey", "source_kind")


# ----------------------------------------------------------------------------- snapshots and upkeep
@R.query(
    "snapshot_fingerprint",
    """WITH h AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer),
    s AS (SELECT count(*) AS rows, sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS a, sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS b FROM h)
    SELECT rows, sha256(rows || '|' || a || '|' || b) AS digest FROM s""",
)
def snapshot_fingerprint(spark, sf):
    return SN.table_fingerprint(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))


@R.query(
    "incremental_apply",
    """SELECT 'c' || c_custkey AS path, CASE WHEN c_acctbal > -500 AND c_mktsegment <> 'BUILDING' THEN 'kept' ELSE 'fresh' END AS origin FROM customer WHERE c_acctbal < 9000""",
)
def incremental_apply(spark, sf):
    c = table(spark, sf, "customer").withColumn("path", F.concat(F.lit("c"), "c_custkey"))
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "CONSTRUCTION").otherwise(F.col("c_mktsegment"))
    old = c.where("c_acctbal > -500").select("path", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("fingerprint"), F.lit("kept").alias("origin"))
    new = c.where("c_acctbal < 9000").select("path", F.sha2(F.concat_ws("|", "c_name", seg), 256).alias("fingerprint"), F.lit("fresh").alias("origin"))
    return SN.apply_changes(old, new)[0].select("path", "origin")


@R.query(
    "latest_changes",
    "SELECT CAST(user_id AS VARCHAR) AS path, max(event_id) AS version, arg_max(event_type, event_id) AS name, arg_max(value, event_id) AS score FROM events GROUP BY user_id",
)
def latest_changes(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("version"), F.col("event_type").alias("name"), F.col("value").alias("score"))
    return INC.latest_changes(ev)


@R.query(
    "incremental_postings",
    """WITH d AS (SELECT 'd' || doc_id AS path, CASE WHEN lang = 'fr' THEN 'revised ' || text ELSE text END AS t FROM documents WHERE lang <> 'es')
    SELECT path, token, count(*) AS tf FROM (SELECT path, unnest(regexp_extract_all(lower('n ' || t || ' x'), '[a-z0-9_]+')) AS token FROM d) GROUP BY ALL""",
)
def incremental_postings(spark, sf):
    """All documents, then a batch that revises the French ones and deletes the Spanish ones."""
    from ..operators.quality import row_fingerprint

    d = table(spark, sf, "documents")
    page = lambda df, text: df.select(
        F.concat(F.lit("d"), "doc_id").alias("path"), F.lit("n").alias("name"), F.lit("metric").alias("context_type"), text.alias("l0"), F.lit("x").alias("l1"), F.lit("EXPLICIT").alias("identity_status"))
    start = page(d, F.col("text"))
    current = start.withColumn("fingerprint", row_fingerprint(*INC.PAGE_COLUMNS))
    fr = page(d.where("lang = 'fr'"), F.concat(F.lit("revised "), "text")).withColumn("deleted", F.lit(False)).withColumn("version", F.lit(2))
    es = page(d.where("lang = 'es'"), F.col("text")).withColumn("deleted", F.lit(True)).withColumn("version", F.lit(2))
    same = page(d.where("lang = 'de'"), F.col("text")).withColumn("deleted", F.lit(False)).withColumn("version", F.lit(2))
    pages, changed = INC.merge_pages(current, fr.unionByName(es).unionByName(same))
    return INC.merge_postings(S.postings(start), pages, changed)


# ----------------------------------------------------------------------------- delta indexes
def delta_index(spark, earlier, now, entries):
    """An index that got an earlier state of the parts, then two batches of what differs, with a compaction between.

    ``earlier`` and ``now`` are part tables; ``entries`` makes (owner, payload, entries) rows of one.
    """
    index = DeltaIndex(spark, f"{ensure_checkpoint_dir(spark)}/delta-{uuid.uuid4().hex}", buckets=16)
    first = lambda df, deleted: entries(df).withColumn("deleted", F.lit(deleted))
    index.apply(first(earlier, False), 0)
    index.compact()
    half = F.xxhash64("p_partkey") % 2 == 0
    gone = earlier.join(now.select("p_partkey"), "p_partkey", "left_anti")
    index.apply(first(now.where(half), False).unionByName(first(gone, True)), 1)
    index.compact(share=0.5)
    index.apply(first(now.where(~half), False), 2)
    return index


def earlier_parts(spark, sf):
    """Parts with some names and brands of before, without some and with others that have gone since."""
    p = table(spark, sf, "part")
    old = p.where("p_partkey % 11 <> 4").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("former "), "p_name")).otherwise(F.col("p_name")))
    return old.unionByName(p.where("p_partkey % 5 = 3").withColumn("p_partkey", F.col("p_partkey") + 100_000_000).withColumn("p_brand", F.lit("Brand#gone")))


def element_entries(parts):
    """Elements of a part with their words and exact keys; the part's page owns them."""
    els = E.build_elements(SV.sections_of(parts))
    text = F.array_distinct(T.tokens(F.array_join("texts", " ")))
    keys = F.filter(F.array_distinct(F.transform(F.concat(F.array("element_id"), "names"), lambda k: T.fold(k))), lambda k: k != "")
    entry = lambda space, xs: F.transform(xs, lambda k: F.struct(F.lit(space).alias("space"), k.alias("key"), F.col("element_id").alias("member"), F.lit(1).cast("long").alias("weight")))
    rows = els.select("path", "element_id", F.concat(entry("token", text), entry("exact", keys)).alias("entries"))
    held = rows.groupBy("path").agg(F.sort_array(F.collect_list("element_id")).alias("ids"), F.flatten(F.collect_list("entries")).alias("entries"))  # elements of one page
    pages = parts.select(F.concat(F.lit("data://metrics/"), "p_partkey").alias("path"))
    return pages.join(held, "path", "left").select(F.col("path").alias("owner"), F.to_json("ids").alias("payload"), "entries")


@R.query(
    "incremental_elements",
    f"""WITH {SV.ELEMENTS_SQL} SELECT DISTINCT unnest(regexp_extract_all(lower(txt), '[a-z0-9_]+')) AS token, element_id, path FROM el""",
)
def incremental_elements(spark, sf):
    """Word postings of elements after batches, against an index of the last state."""
    index = delta_index(spark, earlier_parts(spark, sf), table(spark, sf, "part"), element_entries)
    return index.postings().where("space = 'token'").select(F.col("key").alias("token"), F.col("member").alias("element_id"), F.col("owner").alias("path"))


@R.query(
    "incremental_mentions",
    f"""WITH {SV.ELEMENTS_SQL}, ky AS (SELECT DISTINCT lower(trim(ident)) AS key, element_id FROM el UNION SELECT element_id, element_id FROM el)
    SELECT key, count(*) AS members, NOT regexp_full_match(key, '[a-z0-9_]+(?:[.:/\\-][a-z0-9_]+)*') AS phrase FROM ky GROUP BY ALL""",
)
def incremental_mentions(spark, sf):
    """Vocabulary of exact keys with reference counts after batches: a key leaves with its last element."""
    index = delta_index(spark, earlier_parts(spark, sf), table(spark, sf, "part"), element_entries)
    counts = index.key_counts().where("space = 'exact'")
    return counts.select("key", "members", (~F.col("key").rlike(f"^{M.SYMBOL}$")).alias("phrase"))


def branch_entries(parts):
    pages = SV.branch_pages_of(parts)
    own = S.indexable(pages).select("view", "path", "quality", "l0", "l1", T.tokens(S.index_text(pages)).alias("toks"))
    entries = INC.token_entries(F.col("view"), F.col("toks"), F.col("path"))
    return own.select(F.col("path").alias("owner"), F.to_json(F.struct("l0", "l1", "quality")).alias("payload"), entries.alias("entries"))


@R.query(
    "incremental_aggregates",
    f"""WITH {SV.BRANCH_SQL} SELECT view, path, token, tf FROM bp""",
)
def incremental_aggregates(spark, sf):
    """Postings of branch pages kept up while parts change: pages are summed anew, only those that differ reach the index."""
    index = DeltaIndex(spark, f"{ensure_checkpoint_dir(spark)}/delta-{uuid.uuid4().hex}", buckets=16)
    before, after = (cut_lineage(branch_entries(p)) for p in (earlier_parts(spark, sf), table(spark, sf, "part")))
    index.apply(before.withColumn("deleted", F.lit(False)), 0)
    index.compact()
    gone = before.join(after.select("owner"), "owner", "left_anti").withColumn("deleted", F.lit(True))
    index.apply(after.withColumn("deleted", F.lit(False)).unionByName(gone), 1)
    return index.postings().select(F.col("space").alias("view"), F.col("member").alias("path"), F.col("key").alias("token"), F.col("weight").alias("tf"))


@R.query(
    "resume_plan",
    "SELECT o_orderkey AS case_id, r AS repeat FROM orders, (SELECT unnest([1, 2]) AS r) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = r)",
)
def resume_plan(spark, sf):
    planned = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("repeat"))
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("repeat"))
    return SN.resume_plan(planned, done, ["case_id", "repeat"])
