"""Deterministic projections of the supplied tables onto the engine's record kinds.

Each projection has a SQL twin (``*_SQL``) used by the verification queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blockindex import StoredIndex, build_blocks
from ..operators.search import PageIndex
from ..scale import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ context pages <- documents
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    kind = (
        F.when(F.col("lang") == "en", "metric").when(F.col("lang") == "fr", "physical-model")
        .when(F.col("lang") == "de", "logical-model").otherwise("dimension")
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("data://documents/"), "doc_id").alias("path"),
        F.concat(F.lit("document:"), "doc_id").alias("canonical_id"),
        kind.alias("context_type"),
        F.concat("source", F.lit("_"), "doc_id").alias("name"),
        F.array(F.concat("source", F.lit("_"), F.col("doc_id") + 20)).alias("aliases"),
        F.col("source").alias("topic_domain"),
        F.col("lang").alias("layer"),
        F.substring("text", 1, 700).alias("l0"),
        F.col("text").alias("l1"),
        F.when(F.col("toxic") == 1, "CANDIDATE").otherwise("EXPLICIT").alias("identity_status"),
    )


PAGES_SQL = """
pg AS (SELECT d.doc_id, 'data://documents/' || d.doc_id AS path, 'document:' || d.doc_id AS canonical_id,
  CASE lang WHEN 'en' THEN 'metric' WHEN 'fr' THEN 'physical-model' WHEN 'de' THEN 'logical-model' ELSE 'dimension' END AS context_type,
  source || '_' || d.doc_id AS name, source || '_' || (d.doc_id + 20) AS alias, source AS topic_domain, lang AS layer, substr(text, 1, 700) AS l0, text AS l1,
  CASE WHEN lb.toxic = 1 THEN 'CANDIDATE' ELSE 'EXPLICIT' END AS identity_status
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id),
ipg AS (SELECT * FROM pg WHERE identity_status = 'EXPLICIT')"""

INDEX_SQL = PAGES_SQL + """,
tk AS (SELECT path, unnest(regexp_extract_all(lower(name || ' ' || l0 || ' ' || l1 || ' ' || alias), '[a-z0-9_]+')) AS token FROM ipg),
post AS (SELECT path, token, count(*) AS tf FROM tk GROUP BY ALL),
lens AS (SELECT path, count(*) AS dl FROM tk GROUP BY ALL),
tdf AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lens)"""


_STORED: dict[tuple[str, str], StoredIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The block index of the pages: written by the first query of a session that asks for it, read by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not _STORED[key].stands():
        _STORED[key] = build_blocks(pages(spark, sf_dir))
    return _STORED[key]


def search_index(spark: SparkSession, sf_dir: str) -> PageIndex:
    return stored_index(spark, sf_dir).as_page_index(pages(spark, sf_dir))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ------------------------------------------------------------------ ordered fragments <- events
# Fixed source order of the scalar section "formula" for this mapping (highest first).
FRAGMENT_AUTHORITY = ("purchase", "signup", "click")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fragment per event: the user is the context, the event type is the source type."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        F.col("user_id").alias("ctx_id"),
        F.when(F.col("event_type") == "view", "metrics").otherwise("formula").alias("section"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("source_type"),
        (k % 5).cast("string").alias("value"),
        F.when(F.col("event_type") == "error", "CANDIDATE").when(k % 3 == 0, "DERIVED").otherwise("EXPLICIT").alias("status"),
    )


FRAGMENTS_SQL = """
fr AS (SELECT user_id AS ctx_id, CASE WHEN event_type = 'view' THEN 'metrics' ELSE 'formula' END AS section,
  event_id AS seq, event_type AS source_type, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS value,
  CASE WHEN event_type = 'error' THEN 'CANDIDATE' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 'DERIVED'
       ELSE 'EXPLICIT' END AS status FROM events)"""


# ------------------------------------------------------------------ contexts and references
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted contexts: nations, customers, suppliers and parts with kinds, names and statuses."""
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("data://topics/"), "n_nationkey").alias("path"), F.lit("topic").alias("context_type"),
        F.col("n_name").alias("name"), F.lit("EXPLICIT").alias("identity_status"), F.lit("src-geo").alias("source_id"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("data://business-objects/"), "c_custkey").alias("path"), F.lit("business-object").alias("context_type"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, "CANDIDATE").otherwise("EXPLICIT").alias("identity_status"),
        F.concat(F.lit("src-"), F.lower("c_mktsegment")).alias("source_id"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("data://physical-models/"), "s_suppkey").alias("path"), F.lit("physical-model").alias("context_type"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 0, "CANDIDATE").otherwise("EXPLICIT").alias("identity_status"), F.lit("src-supply").alias("source_id"),
    )
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("data://metrics/"), "p_partkey").alias("path"), F.lit("metric").alias("context_type"),
        F.concat(F.lit("Part "), "p_name", F.lit(" "), "p_partkey").alias("name"),
        F.when(F.col("p_size") % 7 == 0, "DERIVED").otherwise("EXPLICIT").alias("identity_status"), F.lit("src-catalog").alias("source_id"),
    )
    return n.unionByName(c).unionByName(s).unionByName(p)


CONTEXTS_SQL = """
cx AS (
  SELECT 'data://topics/' || n_nationkey AS path, 'topic' AS context_type, n_name AS name, 'EXPLICIT' AS identity_status, 'src-geo' AS source_id FROM nation
  UNION ALL SELECT 'data://business-objects/' || c_custkey, 'business-object', c_name, CASE WHEN c_acctbal < 0 THEN 'CANDIDATE' ELSE 'EXPLICIT' END,
    'src-' || lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'data://physical-models/' || s_suppkey, 'physical-model', s_name, CASE WHEN s_acctbal < 0 THEN 'CANDIDATE' ELSE 'EXPLICIT' END, 'src-supply' FROM supplier
  UNION ALL SELECT 'data://metrics/' || p_partkey, 'metric', 'Part ' || p_name || ' ' || p_partkey, CASE WHEN p_size % 7 = 0 THEN 'DERIVED' ELSE 'EXPLICIT' END, 'src-catalog' FROM part)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed references: part -> supplier by name (per distinct line pair) and customer -> nation by name.

    Names are written in another case and spacing than the target's; every eleventh
    part-supplier pair names something that does not exist; every fifth is only a proposal;
    furniture customers give no location.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supplied = li.select(
        F.concat(F.lit("data://metrics/"), "l_partkey").alias("source"), F.lit("supported_by").alias("relation"),
        F.when((F.col("l_partkey") + F.col("l_suppkey")) % 11 == 0, F.concat(F.lit("missing "), "l_suppkey"))
        .otherwise(F.concat(F.lit("SUPPLIER # "), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).alias("raw_target"),
        F.lit("physical-model").alias("target_type"),
        F.when((F.col("l_partkey") + F.col("l_suppkey")) % 5 == 0, "CANDIDATE").otherwise("UNRESOLVED").alias("status"),
    )
    located = table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'").select(
        F.concat(F.lit("data://business-objects/"), "c_custkey").alias("source"), F.lit("part_of").alias("relation"),
        F.concat(F.lit("nation-"), "c_nationkey").alias("raw_target"), F.lit("topic").alias("target_type"),
        F.lit("UNRESOLVED").alias("status"),
    )
    return supplied.unionByName(located)


REFERENCES_SQL = """
rf AS (
  SELECT 'data://metrics/' || l_partkey AS source, 'supported_by' AS relation,
    CASE WHEN (l_partkey + l_suppkey) % 11 = 0 THEN 'missing ' || l_suppkey ELSE 'SUPPLIER # ' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS raw_target,
    'physical-model' AS target_type, CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 'CANDIDATE' ELSE 'UNRESOLVED' END AS status
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'data://business-objects/' || c_custkey, 'part_of', 'nation-' || c_nationkey, 'topic', 'UNRESOLVED' FROM customer WHERE c_mktsegment <> 'FURNITURE')"""

NORM_SQL = r"regexp_replace(lower(trim({0})), '[\s_\-:/（）()]+', '', 'g')"


def norm_sql(column: str) -> str:
    return NORM_SQL.format(column)


RESOLVED_SQL = f"""{CONTEXTS_SQL.strip()},
{REFERENCES_SQL.strip()},
nm AS (SELECT context_type, {norm_sql('name')} AS key, min(path) AS target, min(identity_status) AS target_status, count(*) AS c
  FROM cx GROUP BY ALL HAVING count(DISTINCT path) = 1),
rr AS (SELECT rf.source, rf.relation, rf.raw_target, rf.target_type,
  CASE WHEN rf.status = 'CANDIDATE' THEN 'CANDIDATE' WHEN nm.target_status IN ('EXPLICIT', 'DERIVED') THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS status,
  CASE WHEN nm.target_status IN ('EXPLICIT', 'DERIVED') THEN nm.target END AS target_path,
  CASE WHEN rf.status <> 'CANDIDATE' AND nm.target_status IN ('EXPLICIT', 'DERIVED') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM rf LEFT JOIN nm ON nm.context_type = rf.target_type AND nm.key = {norm_sql('rf.raw_target')})"""


# ------------------------------------------------------------------ asset graph
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"),
             ("part", "p_partkey"), ("orders", "o_orderkey"))
    out = None
    for name, key in kinds:
        part = table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), key).alias("id"), F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset edges with confidence and assertion kind, all derived from the key columns."""

    def edge(df, src, relation, dst, confidence, inferred):
        return df.select(src.alias("src"), F.lit(relation).alias("relation"), dst.alias("dst"), confidence.alias("confidence"), inferred.alias("inferred"))

    col, lit = F.col, F.lit
    nid = lambda kind, key: F.concat(lit(f"{kind}:"), key)
    parts = [
        edge(table(spark, sf_dir, "orders"), nid("orders", "o_orderkey"), "PLACED_BY", nid("customer", "o_custkey"),
             (col("o_orderkey") % 10) / 10.0, col("o_orderpriority") == "5-LOW"),
        edge(table(spark, sf_dir, "customer"), nid("customer", "c_custkey"), "LOCATED_IN", nid("nation", "c_nationkey"),
             (col("c_custkey") % 4) / 4.0, col("c_acctbal") < 0),
        edge(table(spark, sf_dir, "supplier"), nid("supplier", "s_suppkey"), "LOCATED_IN", nid("nation", "s_nationkey"), lit(0.75), col("s_acctbal") < 0),
        edge(table(spark, sf_dir, "nation"), nid("nation", "n_nationkey"), "PART_OF", nid("region", "n_regionkey"), lit(1.0), lit(False)),
        edge(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), nid("part", "l_partkey"), "SUPPLIED_BY",
             nid("supplier", "l_suppkey"), ((col("l_partkey") + col("l_suppkey")) % 8) / 8.0, lit(False)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("edge_id", F.concat_ws("|", "src", "relation", "dst"))


GRAPH_SQL = """
ge AS (SELECT *, src || '|' || relation || '|' || dst AS edge_id FROM (
  SELECT 'orders:' || o_orderkey AS src, 'PLACED_BY' AS relation, 'customer:' || o_custkey AS dst, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, o_orderpriority = '5-LOW' AS inferred FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey, (c_custkey % 4) / 4.0::DOUBLE, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey, 0.75::DOUBLE, s_acctbal < 0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey, 1.0::DOUBLE, false FROM nation
  UNION ALL SELECT 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey, ((l_partkey + l_suppkey) % 8) / 8.0::DOUBLE, false FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))),
gn AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part UNION ALL SELECT 'orders:' || o_orderkey, 'orders' FROM orders)"""


# ------------------------------------------------------------------ organisation (view "domain")
def org_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(
        F.concat(F.lit("data://views/domain/topic-domain/"), F.replace("r_name", F.lit(" "), F.lit("%20"))).alias("path"),
        F.col("r_name").alias("name"), F.lit("topic-domain").alias("context_type"), F.lit(True).alias("virtual"),
    )
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("data://topics/"), "n_nationkey"), "n_name", F.lit("topic"), F.lit(False))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("data://business-objects/"), "c_custkey"), "c_name", F.lit("business-object"), F.lit(False))
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("data://logical-models/"), "o_orderkey"), F.concat(F.lit("order-"), "o_orderkey"), F.lit("logical-model"), F.lit(False)
    )
    return r.union(n).union(c).union(o)


def org_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements region > nation > customer > order; some are rules, some proposals, some compete."""
    r = table(spark, sf_dir, "region").select(
        "r_regionkey", F.concat(F.lit("data://views/domain/topic-domain/"), F.replace("r_name", F.lit(" "), F.lit("%20"))).alias("rp")
    )
    n = table(spark, sf_dir, "nation")
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    topic = lambda k: F.concat(F.lit("data://topics/"), k)
    obj = lambda k: F.concat(F.lit("data://business-objects/"), k)

    def rows(df, parent, child, pk, ck, status, method, rule, conf):
        return df.select(
            F.lit("domain").alias("view"), parent.alias("parent"), child.alias("child"), F.lit(pk).alias("parent_kind"), F.lit(ck).alias("child_kind"),
            status.alias("status"), method.alias("method"), rule.alias("rule_id"), F.lit(conf).alias("confidence"), child.alias("owner"),
        )

    none = F.lit(None).cast("string")
    cust = F.when(F.col("c_acctbal") < 0, "CANDIDATE").when(F.col("c_mktsegment") == "HOUSEHOLD", "DERIVED").otherwise("CONFIRMED")
    cmeth = F.when(F.col("c_acctbal") < 0, "metadata_inference").when(F.col("c_mktsegment") == "HOUSEHOLD", "domain_rule").otherwise("explicit")
    crule = F.when((F.col("c_acctbal") >= 0) & (F.col("c_mktsegment") == "HOUSEHOLD"), "geo-rule")
    part = F.col("o_orderstatus") == "P"
    return (
        rows(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("rp"), topic("n_nationkey"), "topic-domain", "topic",
             F.lit("CONFIRMED"), F.lit("explicit_taxonomy"), none, 1.0)
        .unionByName(rows(c, topic("c_nationkey"), obj("c_custkey"), "topic", "business-object", cust, cmeth, crule, 0.9))
        .unionByName(rows(c.where("c_mktsegment = 'BUILDING'"), topic((F.col("c_nationkey") + 7) % 25), obj("c_custkey"), "topic", "business-object",
                          F.lit("DERIVED"), F.lit("domain_rule"), F.lit("alt-rule"), 0.95))
        .unionByName(rows(o, obj("o_custkey"), F.concat(F.lit("data://logical-models/"), "o_orderkey"), "business-object", "logical-model",
                          F.when(part, "DERIVED").otherwise("CONFIRMED"), F.when(part, "domain_rule").otherwise("explicit"), F.when(part, "order-rule"), 1.0))
    )


ORG_SQL = """
og AS (SELECT 'data://views/domain/topic-domain/' || replace(r_name, ' ', '%20') AS path, r_name AS name, 'topic-domain' AS context_type, true AS virtual FROM region
  UNION ALL SELECT 'data://topics/' || n_nationkey, n_name, 'topic', false FROM nation
  UNION ALL SELECT 'data://business-objects/' || c_custkey, c_name, 'business-object', false FROM customer
  UNION ALL SELECT 'data://logical-models/' || o_orderkey, 'order-' || o_orderkey, 'logical-model', false FROM orders),
oe AS (SELECT 'domain' AS view, *, child AS owner FROM (
  SELECT 'data://views/domain/topic-domain/' || replace(r_name, ' ', '%20') AS parent, 'data://topics/' || n_nationkey AS child, 'topic-domain' AS parent_kind, 'topic' AS child_kind,
    'CONFIRMED' AS status, 'explicit_taxonomy' AS method, NULL::VARCHAR AS rule_id, 1.0::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'data://topics/' || c_nationkey, 'data://business-objects/' || c_custkey, 'topic', 'business-object',
    CASE WHEN c_acctbal < 0 THEN 'CANDIDATE' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'DERIVED' ELSE 'CONFIRMED' END,
    CASE WHEN c_acctbal < 0 THEN 'metadata_inference' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'domain_rule' ELSE 'explicit' END,
    CASE WHEN c_acctbal >= 0 AND c_mktsegment = 'HOUSEHOLD' THEN 'geo-rule' END, 0.9::DOUBLE FROM customer
  UNION ALL SELECT 'data://topics/' || ((c_nationkey + 7) % 25), 'data://business-objects/' || c_custkey, 'topic', 'business-object', 'DERIVED', 'domain_rule', 'alt-rule', 0.95::DOUBLE
    FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'data://business-objects/' || o_custkey, 'data://logical-models/' || o_orderkey, 'business-object', 'logical-model',
    CASE WHEN o_orderstatus = 'P' THEN 'DERIVED' ELSE 'CONFIRMED' END, CASE WHEN o_orderstatus = 'P' THEN 'domain_rule' ELSE 'explicit' END,
    CASE WHEN o_orderstatus = 'P' THEN 'order-rule' END, 1.0::DOUBLE FROM orders)),
me AS (SELECT 'he-' || substr(sha256('["domain", "' || parent || '", "' || child || '", "' || status || '", "' || method || '", ' || coalesce('"' || rule_id || '"', 'null') || ']'), 1, 20) AS edge_id,
  view, parent, child, parent_kind, child_kind, status, method, rule_id, max(confidence) AS confidence, count(DISTINCT owner) AS owners FROM oe GROUP BY ALL),
pr AS (SELECT *, CASE WHEN method = 'explicit_taxonomy' THEN 10 ELSE 0 END + CASE status WHEN 'CONFIRMED' THEN 3 WHEN 'DERIVED' THEN 2 ELSE 1 END AS p FROM me),
ae AS (SELECT pr.* EXCLUDE (p), status <> 'CANDIDATE' AND p = max(p) OVER w AS active,
  CASE WHEN min(parent) OVER w <> max(parent) OVER w THEN CASE WHEN sum(CASE WHEN status = 'CONFIRMED' THEN 1 ELSE 0 END) OVER w > 1 THEN 'conflicting_confirmed_placement' ELSE 'placement_conflict' END END AS conflict
  FROM pr WINDOW w AS (PARTITION BY view, child, parent_kind)),
cl AS (WITH RECURSIVE c AS (SELECT view, parent AS ancestor, child AS node, 1 AS depth FROM ae WHERE active
  UNION ALL SELECT c.view, e.parent, c.node, c.depth + 1 FROM c JOIN ae e ON e.child = c.ancestor AND e.active AND e.view = c.view)
  SELECT view, ancestor, node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY ALL)"""
