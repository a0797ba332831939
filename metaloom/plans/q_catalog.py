"""Catalogue search, gateway merging, similarity links and the fact graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import facts as FX
from .registry import Registry
from .tables import table

R = Registry()


def part_assets(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lower("p_type").alias("type"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"),
        F.concat_ws(" ", F.lit("sold in size"), "p_size", "p_type").alias("description"), F.array(F.concat(F.lit("Alias-"), F.split("p_name", " ")[1])).alias("aliases"), F.col("p_type").alias("domain"),
    )


ASSET_SQL = """
pa AS (SELECT 'part:' || p_partkey AS id, lower(p_type) AS type, p_brand AS code, p_name AS name, 'sold in size ' || p_size || ' ' || p_type AS description, 'Alias-' || split_part(p_name, ' ', 2) AS al, p_type AS domain FROM part)"""
CK = "regexp_replace(lower(trim({0})), '[\\s_-]+', '', 'g')"
FK = "regexp_replace(lower(trim({0})), '[\\s_\\-–—/\\\\|:：()（）\\[\\]【】]+', '', 'g')"


@R.query(
    "catalog_search",
    f"""WITH {ASSET_SQL}, s AS (SELECT id, least(1.0::DOUBLE, CASE WHEN {CK.format('code')} = 'redring' THEN 1.0 ELSE 0 END + CASE WHEN {CK.format('name')} = 'redring' THEN 0.95::DOUBLE ELSE 0 END + CASE WHEN {CK.format('al')} = 'redring' THEN 0.9::DOUBLE ELSE 0 END
      + CASE WHEN contains({CK.format('code')}, 'redring') OR contains({CK.format('name')}, 'redring') THEN 0.55::DOUBLE ELSE 0 END
      + least(0.5::DOUBLE, (contains(lower(code || ' ' || name || ' ' || description || ' ' || al), 'red')::INT + contains(lower(code || ' ' || name || ' ' || description || ' ' || al), 'ring')::INT) / 2 / 2)
      + CASE WHEN contains({CK.format('description')}, 'redring') THEN 0.2::DOUBLE ELSE 0 END) AS score FROM pa WHERE type IN ('promo', 'small'))
    SELECT id, round(score, 9) AS score FROM s WHERE score > 0 ORDER BY 2 DESC, id LIMIT 40""",
)
def catalog_search(spark, sf):
    return K.search_assets(part_assets(spark, sf), "Red_ring", types=["promo", "small"], limit=40)


@R.query(
    "fact_graph_search",
    f"""WITH {ASSET_SQL}, s AS (SELECT id, least(round(CASE WHEN {FK.format('code')} = 'brand#7' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN {FK.format('name')} = 'brand#7' THEN 0.95::DOUBLE ELSE 0 END
      + CASE WHEN contains({FK.format('code')}, 'brand#7') OR contains('brand#7', {FK.format('code')}) OR contains({FK.format('name')}, 'brand#7') THEN 0.55::DOUBLE ELSE 0 END
      + least(0.45::DOUBLE, contains(lower(concat_ws(' ', code, name, description, al, domain)), 'brand')::INT / 1 * 0.45::DOUBLE), 4), 1.0::DOUBLE) AS score FROM pa WHERE lower(domain) = 'large')
    SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 100""",
)
def fact_graph_search(spark, sf):
    ents = part_assets(spark, sf).withColumn("properties", F.create_map(F.lit("domain"), F.col("domain")))
    return K.search_entities(ents, "Brand #7", filters={"domain": "LARGE"}, limit=100)


@R.query(
    "gateway_search",
    f"""WITH {ASSET_SQL} SELECT id, CASE WHEN {CK.format('code')} = 'ring' THEN 1.0::DOUBLE WHEN {CK.format('name')} = 'ring' THEN 0.98::DOUBLE WHEN {CK.format('al')} = 'aliasring' AND false THEN 0.95::DOUBLE
      WHEN contains({CK.format('code')} || {CK.format('name')} || {CK.format('al')} || {CK.format('description')}, 'ring') THEN 0.7::DOUBLE END AS score FROM pa
    WHERE contains({CK.format('code')} || {CK.format('name')} || {CK.format('al')} || {CK.format('description')}, 'ring')""",
)
def gateway_search(spark, sf):
    scored = part_assets(spark, sf).select("id", K.gateway_score("Ring", spark).alias("score"))
    return scored.where("score > 0")


@R.query(
    "gateway_merge",
    """WITH a AS (SELECT l_linenumber AS route, 'supplier:' || l_suppkey AS id, max(l_partkey) AS part FROM lineitem GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY route) AS r FROM a WHERE route <= 3)
    SELECT id, part FROM m WHERE r = 1""",
)
def gateway_merge(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_linenumber").alias("route"), F.concat(F.lit("supplier:"), "l_suppkey").alias("id")).agg(F.max("l_partkey").alias("part"))
    routes = li.groupBy(F.col("l_linenumber").alias("route")).agg(F.lit(True).alias("complete"), F.lit(False).alias("truncated"))
    return K.merge_routes(a, routes, 3)[0]


@R.query(
    "gateway_completeness",
    """WITH r AS (SELECT l_linenumber AS route, min(l_quantity) >= 1 AS complete, count(*) > 8700 AS truncated FROM lineitem GROUP BY ALL), u AS (SELECT * FROM r ORDER BY route LIMIT 5)
    SELECT bool_and(complete) AND (SELECT count(*) FROM r) <= 5 AS complete, bool_or(truncated) OR (SELECT count(*) FROM r) > 5 AS truncated, count(*) AS routes FROM u""",
)
def gateway_completeness(spark, sf):
    li = table(spark, sf, "lineitem")
    routes = li.groupBy(F.col("l_linenumber").alias("route")).agg((F.min("l_quantity") >= 1).alias("complete"), (F.count("*") > 8700).alias("truncated"))
    none = li.select(F.col("l_linenumber").alias("route"), F.lit("x").alias("id"), F.lit(1).alias("v"))
    return K.merge_routes(none, routes, 5)[1]


@R.query(
    "capability_errors",
    "SELECT DISTINCT l_linenumber AS route, 'supplier:' || l_suppkey AS id, l_returnflag AS type FROM lineitem WHERE NOT (l_linenumber <= 4 AND l_returnflag IN ('A', 'N') OR l_linenumber > 4 AND l_returnflag = 'R')",
)
def capability_errors(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("route"), F.concat(F.lit("supplier:"), "l_suppkey").alias("id"), F.col("l_returnflag").alias("type")).distinct()
    offer = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("route")).distinct()
    caps = offer.select("route", F.explode(F.when(F.col("route") <= 4, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("R")))).alias("asset_type"))
    return K.capability_errors(a, caps)


@R.query(
    "similarity_link_topk",
    """WITH rq AS (SELECT 'o' || o_orderkey AS id, lower(o_orderpriority || ' order of customer') AS t FROM orders), md AS (SELECT DISTINCT 'm' || p_partkey AS id, lower(p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' urgent order' ELSE ' high customer' END) AS t FROM part),
    rt AS (SELECT DISTINCT id, unnest(list_distinct(list_filter(list_concat(list_transform(regexp_split_to_array(t, '[^a-z0-9-]+'), lambda x: regexp_replace(x, '[\\s_-]+', '', 'g')), list_transform(regexp_extract_all(t, '[a-z0-9]+(?:[/-][a-z0-9]+)+'), lambda x: regexp_replace(x, '[/-]+', '', 'g'))), lambda x: length(x) >= 3))) AS k FROM rq),
    mt AS (SELECT DISTINCT id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(t, '[^a-z0-9-]+'), lambda x: regexp_replace(x, '[\\s_-]+', '', 'g')), lambda x: length(x) >= 3))) AS k FROM md),
    kinds AS (SELECT id, string_agg(k, '|' ORDER BY k) AS sig, count(*) AS terms FROM rt GROUP BY ALL), sg AS (SELECT sig, min(id) AS rep FROM kinds GROUP BY ALL),
    sh AS (SELECT sig, mt.id AS model, count(*) AS shared FROM sg JOIN rt ON rt.id = sg.rep JOIN mt USING (k) GROUP BY ALL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY shared DESC, model) AS rank FROM sh QUALIFY rank <= 8)
    SELECT id AS requirement, model, round(shared / terms, 6) AS score, round(0.5::DOUBLE + least(shared / terms, 1.0) * 0.3::DOUBLE, 2) AS confidence, rank FROM kinds JOIN tp USING (sig)""".replace("\\\\", "\\"),
)
def similarity_link_topk(spark, sf):
    req = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" order of customer")).alias("text"))
    tail = F.when(F.col("p_size") > 25, " urgent order").otherwise(" high customer")
    models = table(spark, sf, "part").select(F.concat(F.lit("m"), "p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type", tail).alias("text"))
    return K.link_similar(req, models)


@R.query(
    "edge_evidence",
    """WITH e AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS edge_id, 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, unnest(['ev:' || l_returnflag, 'ev:' || l_linestatus]) AS evidence_id FROM lineitem)
    SELECT e.edge_id, src, dst, evidence_id, note, p_name AS src_name, s_name AS dst_name FROM e JOIN (SELECT 'ev:' || f AS evidence_id, 'flag ' || f AS note FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem)) USING (evidence_id) JOIN part ON src = 'part:' || p_partkey JOIN supplier ON dst = 'supplier:' || s_suppkey""",
)
def edge_evidence(spark, sf):
    li = table(spark, sf, "lineitem")
    refs = F.array(F.concat(F.lit("ev:"), "l_returnflag"), F.concat(F.lit("ev:"), "l_linestatus"))
    e = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("edge_id"), F.concat(F.lit("part:"), "l_partkey").alias("src"),
        F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), refs.alias("refs"),
    )
    ev = li.select("l_returnflag").distinct().select(F.concat(F.lit("ev:"), "l_returnflag").alias("evidence_id"), F.concat(F.lit("flag "), "l_returnflag").alias("note"))
    assets = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name")).unionByName(
        table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return K.edge_evidence(e, assets, ev)


# ----------------------------------------------------------------------------- facts <- events and lineitem
def mentions(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        F.col("event_id").alias("seq"), F.upper("event_type").alias("type"), F.lit(None).cast("string").alias("code"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "User ").otherwise("USER_"), "user_id").alias("name"), F.when(F.col("value") > 50, F.concat(F.lit("v "), "value")).alias("description"),
        F.array(F.concat(F.lit("u"), F.col("user_id"))).alias("aliases"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("properties"),
        F.concat(F.lit("ev:"), F.col("user_id") % 10).alias("evidence_id"),
    )


@R.query(
    "entity_merge",
    """WITH m AS (SELECT event_id AS seq, upper(event_type) AS type, CASE WHEN event_id % 2 = 0 THEN 'User ' ELSE 'USER_' END || user_id AS name, CASE WHEN value > 50 THEN 'v ' || value END AS description, user_id FROM events)
    SELECT type || ':user' || user_id AS entity_key, type, arg_min(name, seq) AS name, count(*) AS mentions, coalesce(arg_min(description, seq) FILTER (description IS NOT NULL), '') AS description FROM m GROUP BY type, user_id""",
)
def entity_merge(spark, sf):
    return FX.merge_entities(mentions(spark, sf))["entities"].select("entity_key", "type", "name", "mentions", "description")


@R.query(
    "entity_properties",
    "SELECT upper(event_type) || ':user' || user_id AS entity_key, 'k' AS property, arg_max(json_extract_string(props, '$.k'), event_id) AS value FROM events GROUP BY event_type, user_id",
)
def entity_properties(spark, sf):
    return FX.merge_entities(mentions(spark, sf))["properties"]


FACT_SQL = """
fc AS (SELECT 'part:' || l_partkey AS subject, 'SUPPLIED_BY' AS predicate, 'supplier:' || l_suppkey AS object, '{}' AS qualifiers, 1 - l_discount AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'EXPLICIT' WHEN 'N' THEN 'INFERRED' ELSE 'CANDIDATE' END AS assertion, 'ev:' || l_linestatus AS evidence_id FROM lineitem),
mf AS (SELECT subject, predicate, object, qualifiers, max(confidence) AS confidence, CASE WHEN bool_or(assertion = 'EXPLICIT') THEN 'EXPLICIT' WHEN bool_or(assertion = 'INFERRED') THEN 'INFERRED' ELSE 'CANDIDATE' END AS assertion FROM fc GROUP BY ALL),
ff AS (SELECT *, CASE assertion WHEN 'EXPLICIT' THEN 'VERIFIED' ELSE 'CANDIDATE' END AS status, 'fact:' || substr(sha256(subject || chr(31) || predicate || chr(31) || object || chr(31) || qualifiers), 1, 20) AS fact_id FROM mf)"""


def facts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("part:"), "l_partkey").alias("subject"), F.lit("SUPPLIED_BY").alias("predicate"), F.concat(F.lit("supplier:"), "l_suppkey").alias("object"), F.lit("{}").alias("qualifiers"),
        (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_returnflag") == "A", "EXPLICIT").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("CANDIDATE").alias("assertion"),
        F.concat(F.lit("ev:"), "l_linestatus").alias("evidence_id"),
    )


@R.query("fact_merge", f"WITH {FACT_SQL} SELECT fact_id, subject, predicate, object, round(confidence, 6) AS confidence, assertion, status FROM ff")
def fact_merge(spark, sf):
    return FX.merge_facts(facts(spark, sf))["facts"].drop("qualifiers").withColumn("confidence", F.round("confidence", 6))


@R.query(
    "fact_integrity",
    f"""WITH {FACT_SQL} SELECT 'dangling_endpoint' AS code, fact_id AS subject FROM ff WHERE object IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0) UNION SELECT 'missing_evidence', evidence_id FROM fc WHERE evidence_id = 'ev:F'""",
)
def fact_integrity(spark, sf):
    merged = FX.merge_facts(facts(spark, sf))
    ents = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("entity_key")).unionByName(
        table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("entity_key")))
    known = table(spark, sf, "lineitem").where("l_linestatus <> 'F'").select(F.concat(F.lit("ev:"), "l_linestatus").alias("evidence_id")).distinct()
    return FX.dangling(merged["facts"], ents, merged["evidence"], known)


@R.query(
    "entity_definition",
    f"WITH {FACT_SQL} SELECT object AS entity_key, count(*) AS facts FROM ff GROUP BY ALL UNION ALL SELECT subject, count(*) FROM ff GROUP BY ALL",
)
def entity_definition(spark, sf):
    f = FX.merge_facts(facts(spark, sf))["facts"]
    ents = f.select(F.col("subject").alias("entity_key")).union(f.select("object")).distinct()
    return FX.definition(f, ents).groupBy("entity_key").agg(F.count("*").alias("facts"))


@R.query(
    "carry_forward_rows",
    """WITH r AS (SELECT event_type, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'L' || user_id % 4 END AS layer, CASE WHEN event_type = 'purchase' THEN 'D' || user_id % 7 END AS domain,
      CASE WHEN event_type = 'error' THEN 'S' || user_id % 9 END AS subject, CASE WHEN event_type IN ('click', 'view') THEN 'm' || event_id END AS model FROM events),
    w AS (SELECT *, max(CASE WHEN layer IS NOT NULL THEN seq END) OVER o AS ls, max(CASE WHEN domain IS NOT NULL OR layer IS NOT NULL THEN seq END) OVER o AS ds, max(CASE WHEN subject IS NOT NULL OR domain IS NOT NULL OR layer IS NOT NULL THEN seq END) OVER o AS ss FROM r WINDOW o AS (ORDER BY seq))
    SELECT 'all' AS sheet, w.seq, w.model, coalesce(a.layer, '') AS layer, coalesce(b.domain, '') AS domain, coalesce(c.subject, '') AS subject FROM w LEFT JOIN r a ON a.seq = w.ls LEFT JOIN r b ON b.seq = w.ds LEFT JOIN r c ON c.seq = w.ss WHERE w.model IS NOT NULL""",
)
def carry_forward_rows(spark, sf):
    """All events form one long sheet: sign-ups give layers, purchases domains, errors subjects."""
    ev = table(spark, sf, "events")
    t, u = F.col("event_type"), F.col("user_id")
    rows = ev.select(
        F.lit("all").alias("sheet"), F.col("event_id").alias("seq"), F.when(t == "signup", F.concat(F.lit("L"), u % 4)).alias("layer"), F.when(t == "purchase", F.concat(F.lit("D"), u % 7)).alias("domain"),
        F.when(t == "error", F.concat(F.lit("S"), u % 9)).alias("subject"), F.when(t.isin("click", "view"), F.concat(F.lit("m"), "event_id")).alias("model"),
    )
    return FX.catalog_rows(rows)


@R.query(
    "kpi_extract",
    """SELECT DISTINCT 'kpi ' || p_partkey AS subject, 'USES_COUNTER' AS predicate, unnest([p_brand, split_part(p_name, ' ', 1)]) AS object, 0.96::DOUBLE AS confidence FROM part
    UNION ALL SELECT 'kpi ' || p_partkey, 'HAS_DIMENSION', unnest(list_distinct([p_type, 'size ' || p_size])), 0.96::DOUBLE FROM part UNION ALL SELECT 'kpi ' || p_partkey, 'OBSERVED_ON', 'S1-' || p_size, 0.95::DOUBLE FROM part WHERE p_size > 25""",
)
def kpi_extract(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(
        F.concat(F.lit("kpi "), "p_partkey").alias("metric"), F.concat(F.lit("([ "), "p_brand", F.lit(" ] / ["), F.split("p_name", " ")[0], F.lit("]) * [统计周期] + [KPI_"), "p_partkey", F.lit("]")).alias("formula"),
        F.concat("p_type", F.lit("、size  "), "p_size", F.lit("/时间维度")).alias("dimensions"), F.when(F.col("p_size") > 25, F.concat(F.lit("S1-"), "p_size")).otherwise("").alias("interface"),
    )
    return FX.kpi_facts(rows)


@R.query(
    "field_extract",
    """WITH r AS (SELECT DISTINCT 'm' || l_partkey AS m, 'f' || l_linenumber AS f, l_linenumber AS n FROM lineitem)
    SELECT m AS subject, 'HAS_FIELD' AS predicate, m || '.' || f AS object, 'EXPLICIT' AS assertion, 0.99::DOUBLE AS confidence FROM r
    UNION ALL SELECT m || '.' || f, 'HAS_ROLE', CASE n WHEN 1 THEN 'DIMENSION:' WHEN 2 THEN 'COUNTER:' ELSE 'MEASURE:' END || f, 'CANDIDATE', 0.72::DOUBLE FROM r WHERE n <= 3""",
)
def field_extract(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber").distinct().select(
        F.concat(F.lit("m"), "l_partkey").alias("model"), F.concat(F.lit("f"), "l_linenumber").alias("field"), F.when(n == 1, "Dimension").when(n == 2, "a counter").when(n == 3, "Measure").otherwise("text").alias("role")
    )
    return FX.field_facts(rows)
