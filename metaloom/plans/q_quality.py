"""Classification, business mapping, quality, audit, fingerprints, organisation proposals and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classification as CL
from ..operators import inference as N
from ..operators import mapping as MP
from ..operators import pages as PG
from ..operators import quality as Q
from ..operators import references as RF
from .q_compile import resolved
from .registry import Registry
from .tables import CONTEXTS_SQL, PAGES_SQL, RESOLVED_SQL, contexts, pages, table

R = Registry()


# ----------------------------------------------------------------------------- classification <- part
def model_labels(spark, sf):
    p = table(spark, sf, "part")
    t, s = F.col("p_type"), F.col("p_size")
    layer = (
        F.when(t == "PROMO", "dwd").when(t == "ECONOMY", " SDL ").when(t == "SMALL", "Object Data-Insight").when(t == "LARGE", "ODS").when(t == "MEDIUM", "layer X").otherwise("")
    )
    domain = F.when(s < 10, "PERF").when(s < 20, "Incident").when(s < 25, "Planning").when(s < 30, "network object").when(s < 40, F.col("p_brand")).otherwise("")
    topic = F.when(s % 4 == 0, "Wireless Coverage").when(s % 4 == 1, "2/3G cs").when(s % 4 == 2, "Cell").otherwise(F.col("p_name"))
    return p.select("p_partkey", layer.alias("layer_raw"), domain.alias("domain_raw"), topic.alias("topic_raw"))


CLASS_SQL = """
md AS (SELECT p_partkey, p_type, p_size, p_brand, p_name, CASE p_type WHEN 'PROMO' THEN 'SDL' WHEN 'ECONOMY' THEN 'SDL' WHEN 'SMALL' THEN 'ODI' WHEN 'LARGE' THEN 'ODS' END AS layer,
  CASE p_type WHEN 'PROMO' THEN 'APPROXIMATE_ALIAS' WHEN 'ECONOMY' THEN 'EXACT' WHEN 'SMALL' THEN 'ALIAS' WHEN 'LARGE' THEN 'EXACT' WHEN 'MEDIUM' THEN 'UNRESOLVED' ELSE 'MISSING' END AS layer_status,
  CASE WHEN p_size < 10 THEN 'PERF' WHEN p_size < 20 THEN 'Incident' WHEN p_size < 25 THEN 'Planning' WHEN p_size < 30 THEN 'network object' WHEN p_size < 40 THEN p_brand END AS dr,
  CASE p_size % 4 WHEN 0 THEN 'Wireless Coverage' WHEN 1 THEN '2/3G cs' WHEN 2 THEN 'Cell' ELSE p_name END AS tr FROM part),
m2 AS (SELECT *, coalesce(layer IN ('SDL', 'ODI'), false) AS ctl,
  CASE WHEN layer = 'SDL' AND p_size < 10 THEN '性能' WHEN layer = 'SDL' AND p_size < 20 THEN '事件' WHEN layer = 'SDL' AND p_size < 25 THEN '规划' WHEN layer = 'ODI' AND p_size BETWEEN 25 AND 29 THEN '网络对象' END AS dc FROM md),
m3 AS (SELECT *, CASE WHEN ctl THEN dc ELSE dr END AS domain, CASE WHEN dr IS NULL THEN 'MISSING' WHEN NOT ctl THEN 'UNCONTROLLED' WHEN dc IS NULL THEN 'UNRESOLVED' ELSE 'ALIAS' END AS domain_status,
  CASE WHEN dc = '性能' AND p_size % 4 = 0 THEN '无线覆盖' WHEN dc = '性能' AND p_size % 4 = 1 THEN '2/3G CS' WHEN dc = '网络对象' AND p_size % 4 = 2 THEN '小区' END AS tc FROM m2),
m4 AS (SELECT *, CASE WHEN ctl THEN tc ELSE tr END AS topic, CASE WHEN NOT ctl THEN 'UNCONTROLLED' WHEN tc IS NULL THEN 'UNRESOLVED' WHEN p_size % 4 = 1 THEN 'EXACT' ELSE 'ALIAS' END AS topic_status FROM m3),
m5 AS (SELECT *, concat_ws(',', CASE layer_status WHEN 'MISSING' THEN 'missing_model_layer' WHEN 'UNRESOLVED' THEN 'unknown_model_layer' END,
  CASE WHEN ctl AND domain_status = 'MISSING' THEN 'missing_topic_domain' WHEN ctl AND domain_status = 'UNRESOLVED' THEN 'unknown_topic_domain' END,
  CASE WHEN ctl AND topic_status = 'UNRESOLVED' THEN CASE WHEN domain = '规划' THEN 'topic_catalog_incomplete' WHEN domain IS NOT NULL THEN 'topic_not_in_domain' ELSE 'topic_domain_unresolved' END END) AS issues FROM m4)"""


@R.query(
    "classification_normalize",
    f"""WITH {CLASS_SQL} SELECT p_partkey, layer, layer_status, domain, domain_status, topic, topic_status, issues,
    CASE WHEN issues <> '' THEN 'REVIEW' WHEN layer_status LIKE '%ALIAS' OR domain_status = 'ALIAS' OR topic_status = 'ALIAS' THEN 'NORMALIZED' ELSE 'VALID' END AS status FROM m5""",
)
def classification_normalize(spark, sf):
    cols = ["p_partkey", "layer", "layer_status", "domain", "domain_status", "topic", "topic_status", "issues", "status"]
    return CL.classify(model_labels(spark, sf)).select(*cols)


@R.query(
    "scope_extract",
    """SELECT p_partkey AS query_id, CASE p_type WHEN 'PROMO' THEN 'SDL' WHEN 'SMALL' THEN 'ODI' WHEN 'LARGE' THEN 'SDL' END AS layer,
    CASE p_type WHEN 'PROMO' THEN '性能' WHEN 'SMALL' THEN '网络对象' WHEN 'LARGE' THEN '事件' END AS topic_domain, CASE p_type WHEN 'PROMO' THEN '无线覆盖' WHEN 'SMALL' THEN '小区' WHEN 'LARGE' THEN '网络事件' END AS topic FROM part""",
)
def scope_extract(spark, sf):
    t = F.col("p_type")
    text = (
        F.when(t == "PROMO", F.concat(F.lit("Which DWD performance models cover wireless coverage for "), "p_name"))
        .when(t == "SMALL", F.concat(F.lit("odi 网络对象 小区 "), "p_brand")).when(t == "LARGE", F.concat("p_name", F.lit(" 网络事件"))).otherwise(F.col("p_name"))
    )
    return CL.query_scope(table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text")))


# ----------------------------------------------------------------------------- business mapping
MAP_TEXT = """
tx AS (SELECT 'c' || c_custkey AS path, c_name || ' ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'cell_id imsi' WHEN 'HOUSEHOLD' THEN 'IMEI lat RSRP' WHEN 'MACHINERY' THEN 'alarm_level ne id' ELSE 'plain' END AS text,
  c_acctbal < 0 AS has_objects, c_mktsegment FROM customer)"""


def mapped_texts(spark, sf):
    c = table(spark, sf, "customer")
    m = F.col("c_mktsegment")
    extra = F.when(m == "BUILDING", "cell_id imsi").when(m == "HOUSEHOLD", "IMEI lat RSRP").when(m == "MACHINERY", "alarm_level ne id").otherwise("plain")
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.concat_ws(" ", "c_name", extra).alias("text"), (F.col("c_acctbal") < 0).alias("has_objects"))


@R.query(
    "business_objects",
    f"""WITH {MAP_TEXT}, o AS (SELECT path, unnest(CASE c_mktsegment WHEN 'BUILDING' THEN [struct_pack(p := 0, v := 'Cell'), struct_pack(p := 1, v := 'Subscriber')]
      WHEN 'HOUSEHOLD' THEN [struct_pack(p := 0, v := 'Terminal'), struct_pack(p := 1, v := 'Location')] WHEN 'MACHINERY' THEN [struct_pack(p := 0, v := 'Network Element')] ELSE [] END) AS x FROM tx WHERE NOT has_objects)
    SELECT path, CASE x.p WHEN 0 THEN 'primary_objects' ELSE 'related_objects' END AS section, x.v AS value, CAST(x.p AS BIGINT) AS position, 'DERIVED' AS status FROM o""",
)
def business_objects(spark, sf):
    return MP.map_objects(mapped_texts(spark, sf))


@R.query(
    "topic_proposals",
    f"""WITH {MAP_TEXT} SELECT path, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '性能' ELSE '事件' END AS topic_domain, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '无线覆盖' ELSE '网络事件' END AS topic, 'CANDIDATE' AS status,
    0.65::DOUBLE AS confidence FROM tx WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') AND NOT has_objects""",
)
def topic_proposals(spark, sf):
    return MP.propose_topics(mapped_texts(spark, sf).withColumn("has_topic", F.col("has_objects")))


@R.query(
    "object_references",
    f"""WITH {MAP_TEXT} SELECT path AS source, 'maps_to_business_object' AS relation, CASE c_mktsegment WHEN 'BUILDING' THEN 'Cell' WHEN 'HOUSEHOLD' THEN 'Terminal' ELSE 'Network Element' END AS raw_target,
      'business-object' AS target_type, 'UNRESOLVED' AS status, 0.8::DOUBLE AS confidence FROM tx WHERE NOT has_objects AND c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')
    UNION ALL SELECT path, 'relates_to_business_object', CASE c_mktsegment WHEN 'BUILDING' THEN 'Subscriber' ELSE 'Location' END, 'business-object', 'UNRESOLVED', 0.8::DOUBLE FROM tx WHERE NOT has_objects AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')""",
)
def object_references(spark, sf):
    objects = MP.map_objects(mapped_texts(spark, sf))
    known = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("c"), "c_custkey").alias("source"), F.lit("maps_to_business_object").alias("relation"), F.lit("Cell").alias("raw_target")
    )
    return MP.object_references(objects, known)


@R.query(
    "coverage_flags",
    f"""WITH {CONTEXTS_SQL}, s AS (SELECT DISTINCT 'data://metrics/' || l_partkey AS path, CASE l_returnflag WHEN 'A' THEN 'summary' WHEN 'N' THEN 'dimensions' ELSE 'grain' END AS section FROM lineitem),
    p AS (SELECT path, bool_or(section = 'summary') AS s, bool_or(section = 'dimensions') AS d, bool_or(section = 'grain') AS g FROM s GROUP BY ALL)
    SELECT cx.path, coalesce(s, false) AS business_meaning, false AS purpose, context_type = 'business-object' AS business_object, context_type = 'metric' AS metrics, coalesce(d, false) AS dimensions,
      context_type = 'physical-model' AS models, false AS fields, coalesce(g, false) AS grain, false AS lineage FROM cx LEFT JOIN p USING (path)""",
)
def coverage_flags(spark, sf):
    li = table(spark, sf, "lineitem")
    sec = F.when(F.col("l_returnflag") == "A", "summary").when(F.col("l_returnflag") == "N", "dimensions").otherwise("grain")
    rows = li.select(F.concat(F.lit("data://metrics/"), "l_partkey").alias("path"), sec.alias("section")).distinct()
    return MP.coverage_flags(contexts(spark, sf), rows)


# ----------------------------------------------------------------------------- quality and audit
QC_SQL = f"""{RESOLVED_SQL},
qx AS (SELECT *, split_part(path, '/', 4) AS tail, context_type || ':' || lower(CASE context_type WHEN 'metric' THEN regexp_extract(name, '^Part [a-z]+ [a-z]+') ELSE name END) AS canonical_id FROM cx),
al AS (SELECT context_type, lower(regexp_extract(name, '^Part [a-z]+ [a-z]+')) AS alias, canonical_id, path FROM qx WHERE context_type = 'metric' UNION ALL SELECT context_type, left(lower(name), 12), canonical_id, path FROM qx WHERE context_type = 'physical-model'),
qi AS (
  SELECT 'warning' AS severity, 'candidate_context_not_indexed' AS code, path AS subject FROM qx WHERE identity_status IN ('INFERRED', 'CANDIDATE')
  UNION ALL SELECT 'error', 'duplicate_canonical_id', canonical_id FROM qx GROUP BY canonical_id HAVING count(*) > 1
  UNION ALL SELECT 'warning', 'alias_collision', alias FROM al GROUP BY context_type, alias HAVING count(DISTINCT canonical_id) > 1
  UNION ALL SELECT 'error', 'missing_reference_target', target_path FROM rr WHERE status = 'CONFIRMED' AND target_path NOT IN (SELECT path FROM cx)
  UNION ALL SELECT 'warning', 'missing_evidence', path FROM qx WHERE identity_status = 'DERIVED')"""


def quality_contexts(spark, sf):
    cx = contexts(spark, sf)
    stem = F.regexp_extract("name", "^Part [a-z]+ [a-z]+", 0)
    metric = F.col("context_type") == "metric"
    alias = F.when(metric, F.array(stem)).when(F.col("context_type") == "physical-model", F.array(F.substring("name", 1, 12))).otherwise(F.array().cast("array<string>"))
    return cx.withColumn("canonical_id", F.concat_ws(":", "context_type", F.lower(F.when(metric, stem).otherwise(F.col("name"))))).withColumn("aliases", alias)


def issues(spark, sf):
    cx = quality_contexts(spark, sf)
    sections = cx.select("path", F.lit("summary").alias("section"), (F.col("identity_status") != "DERIVED").alias("evidenced"))
    return Q.quality_issues(cx, resolved(spark, sf), sections)


@R.query("quality_checks", f"WITH {QC_SQL} SELECT * FROM qi")
def quality_checks(spark, sf):
    return issues(spark, sf)


@R.query(
    "audit_gates",
    f"""WITH {QC_SQL}, orp AS (SELECT path FROM cx WHERE identity_status NOT IN ('INFERRED', 'CANDIDATE') AND path NOT IN (SELECT source FROM rr WHERE status = 'CONFIRMED' UNION SELECT target_path FROM rr WHERE status = 'CONFIRMED')),
    a AS (SELECT (SELECT count(*) FROM rr) AS refs, (SELECT count(*) FROM rr WHERE status = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM cx) AS contexts, (SELECT count(*) FROM orp) AS orphans,
      (SELECT count(*) FROM qi WHERE severity = 'error') AS errors, 0::BIGINT AS leaks, (SELECT count(*) FROM (SELECT DISTINCT source, relation, target_path FROM rr JOIN cx a ON a.path = source JOIN cx b ON b.path = target_path WHERE status = 'CONFIRMED' AND a.source_id <> b.source_id)) AS cross_n)
    SELECT refs, unresolved, contexts, orphans, errors, leaks, cross_n AS "cross", round(unresolved / refs, 6) AS unresolved_ratio, round(orphans / contexts, 6) AS orphan_ratio, errors = 0 AS no_quality_errors,
      false AS fragment_evidence_complete, true AS candidate_references_isolated, true AS delivery_manifest_met, true AS coverage_met, cross_n >= 1 AS cross_source_met, unresolved / refs <= 0.2 AS unresolved_ratio_met,
      orphans / contexts <= 0.5 AS orphan_ratio_met, 'FAILED' AS status FROM a""",
)
def audit_gates(spark, sf):
    refs, cx = resolved(spark, sf), contexts(spark, sf)
    frags = cx.select((F.col("identity_status") != "DERIVED").alias("evidenced"))
    leaks = RF.candidate_leaks(refs, RF.graph_edges(refs, cx))
    cross = RF.cross_source(refs, cx.select("path", "source_id"))
    return Q.audit(issues(spark, sf), refs, cx, RF.orphans(refs, cx), leaks, cross, frags, min_cross=1, max_unresolved=0.2, max_orphans=0.5)


@R.query(
    "fingerprint_diff",
    """WITH o AS (SELECT 'c' || c_custkey AS path, sha256(c_name || '|' || c_mktsegment) AS f FROM customer WHERE c_acctbal > -500),
    n AS (SELECT 'c' || c_custkey AS path, sha256(c_name || '|' || CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END) AS f FROM customer WHERE c_acctbal < 9000)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON n.path = o.path WHERE o.f IS DISTINCT FROM n.f""",
)
def fingerprint_diff(spark, sf):
    c = table(spark, sf, "customer").withColumn("path", F.concat(F.lit("c"), "c_custkey"))
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "CONSTRUCTION").otherwise(F.col("c_mktsegment"))
    old = c.where("c_acctbal > -500").select("path", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("fingerprint"))
    new = c.where("c_acctbal < 9000").select("path", F.sha2(F.concat_ws("|", "c_name", seg), 256).alias("fingerprint"))
    return Q.fingerprint_diff(old, new)


# ----------------------------------------------------------------------------- proposals
FEATURE_SQL = """
fe AS (SELECT 'p' || p_partkey AS path, 'tags' AS section, p_type AS value FROM part UNION ALL SELECT 'p' || p_partkey, 'primary_objects', p_name FROM part
  UNION ALL SELECT 'p' || p_partkey, 'metrics', p_brand FROM part UNION ALL SELECT 'p' || p_partkey, 'grain', 'size ' || p_size FROM part)"""


def part_features(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("p"), "p_partkey"))
    pick = lambda s, c: p.select("path", F.lit(s).alias("section"), c.alias("value"), F.lit("EXPLICIT").alias("status"))
    return pick("tags", F.col("p_type")).unionByName(pick("primary_objects", F.col("p_name"))).unionByName(pick("metrics", F.col("p_brand"))).unionByName(
        pick("grain", F.concat(F.lit("size "), "p_size"))
    )


@R.query(
    "feature_neighbors",
    f"""WITH {FEATURE_SQL}, s AS (SELECT a.path, b.path AS neighbor, count(*) AS shared FROM fe a JOIN fe b ON a.section = b.section AND lower(a.value) = lower(b.value) AND a.path <> b.path GROUP BY ALL)
    SELECT path, neighbor, shared, row_number() OVER (PARTITION BY path ORDER BY shared DESC, neighbor) AS rank FROM s QUALIFY rank <= 16""",
)
def feature_neighbors(spark, sf):
    return N.feature_neighbors(N.feature_keys(N.context_features(part_features(spark, sf))))


@R.query(
    "dependency_invalidation",
    f"""WITH {FEATURE_SQL}, ch AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_type = 'PROMO' AND p_size = 7),
    ln AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)
    SELECT path FROM ch UNION SELECT b.path FROM fe a JOIN ch USING (path) JOIN fe b ON b.section = a.section AND lower(b.value) = lower(a.value) UNION SELECT dst FROM ln JOIN ch ON ch.path = ln.src""",
)
def dependency_invalidation(spark, sf):
    changed = table(spark, sf, "part").where("p_type = 'PROMO' AND p_size = 7").select(F.concat(F.lit("p"), "p_partkey").alias("path"))
    links = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return N.dependents(changed, N.feature_keys(N.context_features(part_features(spark, sf))), links)


@R.query(
    "rule_placements",
    f"""WITH {FEATURE_SQL}, ru AS (SELECT * FROM (VALUES ('r1', 'radio', 0.95::DOUBLE, 'PROMO', 'Brand#7'), ('r2', 'core', 0.9::DOUBLE, 'SMALL', 'Brand#12')) v(rule_id, selected, confidence, tag, brand))
    SELECT a.path, rule_id, selected, confidence, 'DERIVED' AS status FROM ru JOIN fe a ON a.section = 'tags' AND a.value = tag JOIN fe b ON b.path = a.path AND b.section = 'metrics' AND b.value = brand""",
)
def rule_placements(spark, sf):
    rules = spark.createDataFrame(
        [("r1", "radio", 0.95, "tags", "PROMO"), ("r1", "radio", 0.95, "metrics", "Brand#7"), ("r2", "core", 0.9, "tags", "SMALL"), ("r2", "core", 0.9, "metrics", "Brand#12"),
         ("r3", "weak", 0.5, "tags", "LARGE")],
        "rule_id string, selected string, confidence double, section string, value string",
    )
    return N.rule_placements(part_features(spark, sf).withColumn("evidenced", F.lit(True)), rules)


LABELS = [("a", "PROMO", "Brand#7"), ("b", "PROMO", "Brand#9"), ("c", "LARGE", "Brand#7"), ("d", "SMALL", "Brand#3")]


@R.query(
    "taxonomy_margin",
    f"""WITH {FEATURE_SQL}, lb AS (SELECT * FROM (VALUES {', '.join(f"('{i}', 'tags', '{t}'), ('{i}', 'metrics', '{b}')" for i, t, b in LABELS)}) v(label_id, section, value)),
    s AS (SELECT path, label_id, round(least(0.95::DOUBLE, sum(CASE section WHEN 'tags' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) / 1.9::DOUBLE * 0.9::DOUBLE), 9) AS score FROM fe JOIN lb USING (section, value) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, label_id) AS n, lead(score) OVER (PARTITION BY path ORDER BY score DESC, label_id) AS nx FROM s)
    SELECT path, 'domain' AS view, 'topic' AS kind, label_id, score, round(score - coalesce(nx, 0), 9) AS margin, CASE WHEN score >= 0.8 AND round(score - coalesce(nx, 0), 9) >= 0.15 THEN 'CANDIDATE' ELSE 'UNKNOWN' END AS result FROM r WHERE n = 1""",
)
def taxonomy_margin(spark, sf):
    rows = [(i, "domain", "topic", s, v) for i, t, b in LABELS for s, v in (("tags", t), ("metrics", b))]
    labels = spark.createDataFrame(rows, "label_id string, view string, kind string, section string, value string")
    return N.decide_labels(N.label_scores(N.context_features(part_features(spark, sf)), labels))


@R.query(
    "target_ranking",
    f"""WITH {PAGES_SQL}, so AS (SELECT path AS source, lower(l1) AS t, topic_domain FROM ipg WHERE context_type = 'logical-model'),
    st AS (SELECT DISTINCT source, unnest(regexp_extract_all(t, '[a-z0-9]{{2,}}')) AS term FROM so), tt AS (SELECT DISTINCT path, unnest(regexp_extract_all(lower(l1), '[a-z0-9]{{2,}}')) AS term FROM ipg WHERE context_type IN ('metric', 'physical-model')),
    ov AS (SELECT source, path, least(0.6::DOUBLE, count(*) * 0.06::DOUBLE) AS part FROM st JOIN tt USING (term) GROUP BY ALL),
    fc AS (SELECT source, path, 0.15::DOUBLE AS part FROM so JOIN ipg USING (topic_domain) WHERE context_type IN ('metric', 'physical-model')),
    sc AS (SELECT source, path, round(least(1.0::DOUBLE, sum(part)), 4) AS score FROM (SELECT * FROM ov UNION ALL SELECT * FROM fc) GROUP BY ALL)
    SELECT source, path, context_type, score, row_number() OVER (PARTITION BY source, context_type ORDER BY score DESC, path) AS rank FROM sc JOIN ipg USING (path) QUALIFY rank <= 12""",
)
def target_ranking(spark, sf):
    pg = pages(spark, sf).where("identity_status = 'EXPLICIT'").withColumn("text", F.col("l1"))
    none = spark.createDataFrame([], "path string, name string")
    ranked = N.rank_targets(pg.where("context_type = 'logical-model'"), pg.where("context_type IN ('metric', 'physical-model')"), none, ["topic_domain"])
    return ranked.select("source", "path", "context_type", "score", "rank")


@R.query(
    "proposal_validation",
    """WITH pr AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS proposal_id, 'p' || l_partkey AS source, CASE l_linestatus WHEN 'F' THEN 'supported_by' ELSE 'uses_metric' END AS relation, 's' || l_suppkey AS target, 1 - l_discount * 5 AS confidence, l_returnflag, l_tax, l_suppkey, l_partkey FROM lineitem),
    al AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS path FROM lineitem WHERE l_quantity > 20), cf AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem WHERE l_quantity > 49)
    SELECT DISTINCT proposal_id, pr.source, relation, pr.target, CASE WHEN al.path IS NULL THEN 'target_not_in_bounded_candidates' WHEN relation = 'uses_metric' THEN 'relation_target_type_mismatch'
      WHEN l_returnflag = 'A' THEN 'source_page_evidence_required' WHEN l_returnflag = 'N' THEN 'target_page_evidence_required' WHEN cf.target IS NOT NULL THEN 'relationship_already_confirmed' WHEN confidence < 0.7 THEN 'below_minimum_confidence' END AS reason
    FROM pr LEFT JOIN al ON al.source = pr.source AND al.path = pr.target LEFT JOIN cf ON cf.source = pr.source AND cf.target = pr.target""",
)
def proposal_validation(spark, sf):
    li = table(spark, sf, "lineitem")
    src, dst = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    named = lambda rows: rows.withColumn("proposal_id", F.concat_ws("-", *keys))
    late = named(li)
    lines = li.select(*keys, F.when(F.col("l_linestatus") == "F", "supported_by").otherwise("uses_metric").alias("relation"), (1 - F.col("l_discount") * 5).alias("confidence"))
    whole = F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys))  # then equal ids are equal keys
    proposed = lambda rows: named(rows).select("proposal_id", src.alias("source"), "relation", dst.alias("target"), "confidence")
    props = proposed(lines.where(whole).distinct()).unionByName(proposed(lines.where(~whole)).distinct())
    cites = F.when(F.col("l_returnflag") == "A", F.array(dst)).when(F.col("l_returnflag") == "N", F.array(src)).otherwise(F.array(src, dst))
    evid = late.select("proposal_id", F.explode(cites).alias("path"))
    allowed = li.where("l_quantity > 20").select(src.alias("source"), dst.alias("path")).distinct()
    conf = li.where("l_quantity > 49").select(src.alias("source"), F.lit("supported_by").alias("relation"), dst.alias("target_path"))
    kinds = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.lit("physical-model").alias("context_type"))
    return N.check_proposals(props, allowed, evid, conf, kinds, {"supported_by": "physical-model", "uses_metric": "metric"}, 0.7).drop("confidence")


# ----------------------------------------------------------------------------- page text
@R.query(
    "page_materialize",
    """SELECT 'o' || o_orderkey AS path, 'order ' || o_orderkey AS name, 'logical-model' AS context_type, substr(coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Order of ' || o_orderpriority END, 'order ' || o_orderkey || ' (logical-model)'), 1, 700) AS l0,
    '# order ' || o_orderkey || chr(10) || chr(10) || coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Order of ' || o_orderpriority END, 'order ' || o_orderkey || ' (logical-model)') ||
      chr(10) || chr(10) || '## Topic' || chr(10) || o_orderpriority || coalesce(chr(10) || chr(10) || '## Dimensions' || chr(10) || m, '') || chr(10) || chr(10) || '## References' || chr(10) || '- part_of: c' || o_custkey AS l1, o_orderpriority AS facet_topic
    FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('- ' || l_returnflag, chr(10) ORDER BY l_returnflag) AS m FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY ALL) ON l_orderkey = o_orderkey""",
)
def page_materialize(spark, sf):
    o = table(spark, sf, "orders").withColumn("path", F.concat(F.lit("o"), "o_orderkey"))
    ctx = o.select("path", F.concat(F.lit("order "), "o_orderkey").alias("name"), F.lit("logical-model").alias("context_type"))
    summary = o.where("o_orderstatus <> 'P'").select("path", F.lit("summary").alias("section"), F.concat(F.lit("Order of "), "o_orderpriority").alias("rendered"))
    topic = o.select("path", F.lit("topic").alias("section"), F.col("o_orderpriority").alias("rendered"))
    flags = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"), "l_returnflag").distinct()
    dims = PG.render_members(flags.select("path", F.lit("dimensions").alias("section"), F.col("l_returnflag").alias("position"), F.col("l_returnflag").alias("value")))
    refs = o.select("path", F.lit("part_of").alias("relation"), F.concat(F.lit("c"), "o_custkey").alias("target_path"))
    page = PG.render_pages(ctx, summary.unionByName(topic).unionByName(dims), refs)
    return page.select("path", "name", "context_type", "l0", "l1", "facet_topic")
