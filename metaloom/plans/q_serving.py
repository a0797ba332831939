"""Elements, mentions, branch retrieval, bundle selection, coverage, binding and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import binding as B
from ..operators import branches as BR
from ..operators import bundle as BU
from ..operators import coverage as C
from ..operators import elements as E
from ..operators import hierarchical as HS
from ..operators import mentions as M
from ..operators import planning as P
from ..operators import search as S
from ..scale import cut_lineage, global_rank, spread, top_per_group
from .q_search import SCORED_SQL
from .registry import Registry
from .tables import CONTEXTS_SQL, contexts, pages, query_set, search_index, table

R = Registry()

# ----------------------------------------------------------------------------- elements <- part
def part_sections(spark, sf):
    return sections_of(table(spark, sf, "part"))


def sections_of(parts):
    p = parts.withColumn("path", F.concat(F.lit("data://metrics/"), "p_partkey"))
    counter = F.to_json(F.struct(
        F.concat_ws(" ", F.split("p_name", " ")[1], F.lit("counter")).alias("counter_name"), F.col("p_type").alias("note"),
        F.when(F.col("p_size") % 10 == 0, "CANDIDATE").otherwise("EXPLICIT").alias("status")))

    def member(section, value, is_json=False):
        return F.struct(F.lit(section).alias("section"), F.lit(0).alias("offset"), value.alias("value"), F.lit(is_json).alias("is_json"))

    rows = F.array(
        member("important_fields", F.col("p_name")), member("attributes", F.col("p_brand")), member("metric_catalog", counter, True),
        member("summary", F.col("p_type")),
    )
    status = F.when(F.col("p_size") > 48, "CANDIDATE").when(F.col("p_size") > 25, "DERIVED").otherwise("EXPLICIT")
    return p.select(
        "path", F.when(F.col("p_size") == 1, "INFERRED").otherwise("EXPLICIT").alias("identity_status"), status.alias("status"), F.explode(rows).alias("r")
    ).select("path", "identity_status", "r.section", "r.offset", "r.value", "status", "r.is_json")


ELEMENTS_SQL = """
el0 AS (SELECT 'data://metrics/' || p_partkey AS path, 'important_fields' AS section, '"' || p_name || '"' AS value, p_name AS txt, p_name AS ident, 'Field' AS kind,
    CASE WHEN p_size > 25 THEN 'DERIVED' ELSE 'EXPLICIT' END AS status FROM part WHERE p_size <= 48 AND p_size <> 1
  UNION ALL SELECT 'data://metrics/' || p_partkey, 'attributes', '"' || p_brand || '"', p_brand, p_brand, 'Attribute', CASE WHEN p_size > 25 THEN 'DERIVED' ELSE 'EXPLICIT' END FROM part WHERE p_size <= 48 AND p_size <> 1
  UNION ALL SELECT 'data://metrics/' || p_partkey, 'metric_catalog', '{"counter_name": "' || split_part(p_name, ' ', 2) || ' counter", "note": "' || p_type || '", "status": "EXPLICIT"}',
    split_part(p_name, ' ', 2) || ' counter ' || p_type || ' EXPLICIT', split_part(p_name, ' ', 2) || ' counter', 'Counter', 'EXPLICIT' FROM part WHERE p_size <= 48 AND p_size <> 1 AND p_size % 10 <> 0),
el AS (SELECT *, 'element-' || substr(sha256(path || ':' || section || ':0:' || value), 1, 20) AS element_id FROM el0)"""


@R.query("element_index", f"WITH {ELEMENTS_SQL} SELECT element_id, path, section, value, status, kind FROM el")
def element_index(spark, sf):
    return E.build_elements(part_sections(spark, sf)).select("element_id", "path", "section", "value", "status", "kind")


EQ = "eq AS (SELECT row_number() OVER (ORDER BY p_name) AS query_id, p_name AS text FROM (SELECT DISTINCT p_name FROM part))"


def name_queries(spark, sf):
    """Every distinct part name is one query."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct().withColumn("g", F.lit(0))
    return global_rank(names, ["g"], [F.asc("text")], "query_id").select("query_id", "text")


@R.query(
    "element_search",
    f"""WITH {ELEMENTS_SQL}, {EQ}, tk AS (SELECT DISTINCT element_id, unnest(regexp_extract_all(lower(txt), '[a-z0-9_]+')) AS token FROM el),
    ky AS (SELECT DISTINCT lower(trim(ident)) AS key, element_id FROM el), qw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM eq),
    rd AS (SELECT query_id, element_id, '' AS token, 0 AS pool FROM eq JOIN ky ON ky.key = lower(trim(text)) UNION ALL SELECT query_id, element_id, token, 1 FROM qw JOIN tk USING (token)),
    cd AS (SELECT query_id, element_id, max(CASE WHEN pool = 0 THEN 1 ELSE 0 END) AS ex FROM rd GROUP BY ALL),
    nq AS (SELECT query_id, count(*) AS asked FROM qw GROUP BY ALL), hd AS (SELECT query_id, element_id, count(*) AS held FROM cd JOIN qw USING (query_id) JOIN tk USING (element_id, token) GROUP BY ALL),
    sc AS (SELECT query_id, element_id, round(coalesce(held, 0) / greatest(1, asked) + 2 * ex, 9) AS score, CASE WHEN ex = 1 THEN 'EXACT_IDENTIFIER' ELSE 'TEXT' END AS match FROM cd JOIN nq USING (query_id) LEFT JOIN hd USING (query_id, element_id))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS rank FROM sc QUALIFY rank <= 20""",
)
def element_search(spark, sf):
    return E.search_elements(E.build_elements(part_sections(spark, sf)), name_queries(spark, sf))


@R.query(
    "element_stale_keys",
    f"""WITH {ELEMENTS_SQL}, ky AS (SELECT DISTINCT lower(trim(ident)) AS key, element_id FROM el UNION SELECT element_id, element_id FROM el)
    SELECT key, element_id, 'missing' AS side FROM ky JOIN el USING (element_id) WHERE section = 'attributes'""",
)
def element_stale_keys(spark, sf):
    els = E.build_elements(part_sections(spark, sf))
    return E.stale_keys(E.element_keys(els), E.element_keys(els.where("section <> 'attributes'")))


@R.query(
    "element_expand",
    f"WITH {ELEMENTS_SQL} SELECT path, section, value FROM el WHERE section IN ('important_fields', 'metric_catalog')",
)
def element_expand(spark, sf):
    els = E.build_elements(part_sections(spark, sf))
    return E.expand_sections(els, els.select("path"), ["fields", "counters"]).select("path", "section", "value")


# ----------------------------------------------------------------------------- mentions
@R.query(
    "phrase_mentions",
    r"""WITH q AS (SELECT p_partkey AS query_id, lower('Compare ' || p_brand || ' ' || p_name || ', "' || p_type || '" in NATION_' || (p_size % 25)) AS q FROM part),
    k AS (SELECT DISTINCT lower(p_brand) AS key, 'element' AS source, 'brand:' || p_brand AS target FROM part UNION SELECT DISTINCT lower(p_name), 'page', 'name:' || p_name FROM part
      UNION SELECT DISTINCT lower(p_type), 'page', 'type:' || p_type FROM part UNION SELECT lower(n_name), 'page', 'nation:' || n_nationkey FROM nation),
    ks AS (SELECT *, regexp_full_match(key, '[a-z0-9_]+(?:[.:/\-][a-z0-9_]+)*') AS sym FROM k),
    tk AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(q, '[a-z0-9_]+(?:[.:/\-][a-z0-9_]+)*')) AS key FROM q)
    SELECT query_id, key, source, target, 'exact_symbol' AS match_method FROM tk JOIN ks USING (key) WHERE sym
    UNION ALL SELECT query_id, key, source, target, 'exact_alias' FROM q JOIN ks ON NOT sym AND regexp_matches(q, '(^|[^a-z0-9_])' || regexp_escape(key) || '($|[^a-z0-9_])')""",
)
def phrase_mentions(spark, sf):
    p = spread(table(spark, sf, "part"))
    text = F.concat(F.lit("Compare "), "p_brand", F.lit(" "), "p_name", F.lit(', "'), "p_type", F.lit('" in NATION_'), F.col("p_size") % 25)
    queries = p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))

    def keys(df, column, source, prefix, ident=None):
        return df.select(
            T.fold(F.col(column)).alias("key"), F.lit(source).alias("source"), F.concat(F.lit(prefix), ident or column).alias("target"), F.lit(prefix[:-1]).alias("kind")
        ).distinct()

    known = keys(p, "p_brand", "element", "brand:").unionByName(keys(p, "p_name", "page", "name:")).unionByName(keys(p, "p_type", "page", "type:"))
    known = known.unionByName(keys(table(spark, sf, "nation"), "n_name", "page", "nation:", "n_nationkey"))
    return M.resolve_mentions(queries, known).drop("kind")


@R.query(
    "exact_name_match",
    """SELECT o_orderkey AS query_id, 'data://business-objects/' || c_custkey AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0""",
)
def exact_name_match(spark, sf):
    """Every order's note is a query naming its customer; names hold '#', so they match as phrases."""
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    text = F.concat(F.lit("note for CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(", priority "), "o_orderpriority")
    queries = o.select(F.col("o_orderkey").alias("query_id"), text.alias("text"))
    cx = S.indexable(contexts(spark, sf)).where("context_type = 'business-object'")
    keys = cx.select(T.fold(F.col("name")).alias("key"), F.lit("page").alias("source"), F.col("path").alias("target"), F.col("context_type").alias("kind"))
    return M.resolve_mentions(queries, keys).select("query_id", F.col("target").alias("path"))


# ----------------------------------------------------------------------------- branches
def branch_pages(spark, sf):
    return branch_pages_of(table(spark, sf, "part"))


def branch_pages_of(p):
    """Summary pages of three views over parts: by type, by brand and by size."""
    out = None
    for view, key, label in (("domain", "p_type", "type"), ("analysis", "p_brand", "brand"), ("asset", "p_size", "size")):
        counted = p.groupBy(F.col(key).cast("string").alias("k"), "p_name").agg(F.count("*").alias("c"), F.count_if(F.col("p_retailprice") > 950).alias("good"))
        top = top_per_group(counted, ["k"], [F.desc("c"), F.asc("p_name")], 12, "r")
        texts = top.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_name"))), lambda x: x["p_name"]), ", ").alias("l1"))
        share = counted.groupBy("k").agg(F.sum("good").alias("good"), F.sum("c").alias("c"))
        part = texts.join(share, "k").select(
            F.lit(view).alias("view"), F.concat(F.lit(f"data://views/{view}/{label}/"), "k").alias("path"), F.concat(F.lit(f"{label} "), F.lower("k")).alias("name"),
            F.concat(F.lit(f"{label}:"), "k").alias("canonical_id"), F.concat_ws(" ", F.lit(label), "k", "c", F.lit("members")).alias("l0"), "l1", F.lit("EXPLICIT").alias("identity_status"),
            (F.col("good") / F.col("c")).alias("quality"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _branch_view(view, key, label):
    return f"""SELECT '{view}' AS view, 'data://views/{view}/{label}/' || k AS path, '{label} ' || lower(k) AS name, '{label} ' || k || ' ' || c || ' members' AS l0, l1, good / c AS quality FROM
      (SELECT k, string_agg(p_name, ', ' ORDER BY r) AS l1 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, p_name) AS r FROM
        (SELECT CAST({key} AS VARCHAR) AS k, p_name, count(*) AS c FROM part GROUP BY ALL)) WHERE r <= 12 GROUP BY k)
      JOIN (SELECT CAST({key} AS VARCHAR) AS k, count(*) AS c, count(*) FILTER (p_retailprice > 950) AS good FROM part GROUP BY ALL) USING (k)"""


BRANCH_SQL = f"""
br AS ({_branch_view('domain', 'p_type', 'type')} UNION ALL {_branch_view('analysis', 'p_brand', 'brand')} UNION ALL {_branch_view('asset', 'p_size', 'size')}),
bq AS (SELECT row_number() OVER (ORDER BY t) AS query_id, t AS text FROM (SELECT DISTINCT p_name || ' in ' || CASE WHEN p_size < 25 THEN lower(p_brand) ELSE 'type ' || lower(p_type) END AS t FROM part)),
bt AS (SELECT view, path, unnest(regexp_extract_all(lower(name || ' ' || l0 || ' ' || l1), '[a-z0-9_]+')) AS token FROM br),
bp AS (SELECT view, path, token, count(*) AS tf FROM bt GROUP BY ALL), bl AS (SELECT view, path, count(*) AS dl FROM bt GROUP BY ALL),
bs AS (SELECT view, count(*) AS n, sum(dl) / count(*) AS avgdl FROM bl GROUP BY ALL), bd AS (SELECT view, token, count(*) AS df FROM bp GROUP BY ALL),
qw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM bq),
bm AS (SELECT query_id, view, path, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM qw JOIN bp USING (token) JOIN bd USING (view, token) JOIN bl USING (view, path) JOIN bs USING (view) GROUP BY ALL),
ex AS (SELECT query_id, view, path, 1.0::DOUBLE AS score FROM bq JOIN br ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || regexp_escape(name) || '($|[^a-z0-9_])')),
fc AS (SELECT query_id, view, path, 1.0::DOUBLE AS score FROM bq, br),
ch AS (SELECT *, 1.0::DOUBLE AS w, 'b' AS c FROM bm UNION ALL SELECT *, 3.0::DOUBLE, 'e' FROM ex UNION ALL SELECT *, 0.25::DOUBLE, 'f' FROM fc),
rk AS (SELECT query_id, view, path, w / (60 + row_number() OVER (PARTITION BY query_id, view, c ORDER BY score DESC, path)) AS part FROM ch WHERE score > 0),
fs AS (SELECT query_id, view, path, round(sum(part), 12) AS score FROM rk GROUP BY ALL),
sb AS (SELECT fs.query_id, fs.view, fs.path, round(fs.score * (0.9::DOUBLE + 0.1::DOUBLE * quality), 12) AS score FROM fs JOIN br USING (view, path)
  WHERE (fs.query_id, fs.view, fs.path) IN (SELECT (query_id, view, path) FROM bm WHERE score > 0 UNION SELECT (query_id, view, path) FROM ex)),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id, view ORDER BY score DESC, path) AS rank FROM sb)"""


def branch_queries(spark, sf):
    tail = F.when(F.col("p_size") < 25, F.lower("p_brand")).otherwise(F.concat(F.lit("type "), F.lower("p_type")))
    names = table(spark, sf, "part").select(F.concat("p_name", F.lit(" in "), tail).alias("text")).distinct().withColumn("g", F.lit(0))
    return global_rank(names, ["g"], [F.asc("text")], "query_id").select("query_id", "text")


@R.query("branch_ranking", f"WITH {BRANCH_SQL} SELECT query_id, view, path, round(score, 10) AS score, rank FROM rb WHERE rank <= 9")
def branch_ranking(spark, sf):
    ranked = BR.rank_branches(branch_queries(spark, sf), branch_pages(spark, sf))
    return ranked.select("query_id", "view", "path", F.round("score", 10).alias("score"), "rank")


@R.query(
    "view_arbitration",
    f"""WITH {BRANCH_SQL}, ev AS (SELECT query_id, view, round((max(score) * 0.7::DOUBLE + avg(score) * 0.3::DOUBLE) * CASE WHEN view = 'analysis' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 12) AS evidence
      FROM rb WHERE rank <= 3 GROUP BY query_id, view), kp AS (SELECT *, max(evidence) OVER (PARTITION BY query_id) AS best FROM ev)
    SELECT query_id, view, round(evidence, 8) AS evidence, row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, view) AS position FROM kp WHERE evidence >= best * 0.8::DOUBLE QUALIFY position <= 2""",
)
def view_arbitration(spark, sf):
    queries = branch_queries(spark, sf)
    ranked = BR.rank_branches(queries, branch_pages(spark, sf))
    initial = queries.select("query_id", F.lit("analysis").alias("view"))
    return BR.arbitrate_views(ranked, initial).withColumn("evidence", F.round("evidence", 8))


# ----------------------------------------------------------------------------- through the organisation
DOMAIN = "PROMO"
MEMBERS_SQL = f"""
pp AS (SELECT 'data://physical-models/p' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'physical-model' ELSE 'metric' END AS kind, p_type, p_brand, p_size,
  CASE p_partkey % 3 WHEN 1 THEN p_type WHEN 2 THEN 'other' END AS facet, 'part ' || p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type AS txt FROM part),
mem AS (SELECT 'data://views/domain/type/' || p_type AS branch, path FROM pp UNION ALL SELECT 'data://views/analysis/brand/' || p_brand, path FROM pp),
ok AS (SELECT path FROM pp WHERE kind = 'metric' OR lower(trim(facet)) = lower('{DOMAIN}') OR (facet IS NULL AND p_type = '{DOMAIN}'))"""
MEMBER_SCORES_SQL = """
ptk AS (SELECT path, unnest(regexp_extract_all(lower(txt), '[a-z0-9_]+')) AS token FROM pp),
ppo AS (SELECT path, token, count(*) AS tf FROM ptk GROUP BY ALL), pln AS (SELECT path, count(*) AS dl FROM ptk GROUP BY ALL), pdf AS (SELECT token, count(*) AS df FROM ppo GROUP BY ALL),
pst AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM pln),
psc AS (SELECT query_id, path, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM qw JOIN ppo USING (token) JOIN pdf USING (token) JOIN pln USING (path), pst GROUP BY ALL)"""


def member_pages(spark, sf):
    """Parts as pages: models without a facet of their own stand below the node of their type."""
    p = table(spark, sf, "part")
    own = F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).when(F.col("p_partkey") % 3 == 2, F.lit("other"))
    return p.select(
        F.concat(F.lit("data://physical-models/p"), "p_partkey").alias("path"), F.concat(F.lit("c:"), "p_partkey").alias("canonical_id"),
        F.when(F.col("p_size") % 2 == 0, "physical-model").otherwise("metric").alias("context_type"), F.concat(F.lit("part "), "p_partkey").alias("name"),
        own.alias("topic_domain"), F.concat_ws(" ", "p_name", "p_brand").alias("l0"), F.col("p_type").alias("l1"), F.lit("EXPLICIT").alias("identity_status"), "p_type", "p_brand",
    )


def member_closure(pages):
    by = lambda view, label, c: pages.select(F.lit(view).alias("view"), F.concat(F.lit(f"data://views/{view}/{label}/"), c).alias("ancestor"), F.col("path").alias("node"))
    return by("domain", "type", "p_type").unionByName(by("analysis", "brand", "p_brand"))


def type_nodes(pages):
    return pages.select(F.concat(F.lit("data://views/domain/type/"), "p_type").alias("path"), F.col("p_type").alias("name"), F.lit("topic-domain").alias("context_type")).distinct()


@R.query("organisation_filter", f"WITH {MEMBERS_SQL} SELECT path FROM ok")
def organisation_filter(spark, sf):
    pages = member_pages(spark, sf)
    return HS.organisation_allowed(pages, member_closure(pages), type_nodes(pages), scope={"topic_domain": f" {DOMAIN.lower()}"}).select("path")


@R.query(
    "hierarchical_search",
    f"""WITH {BRANCH_SQL}, {MEMBERS_SQL}, {MEMBER_SCORES_SQL},
    sd AS (SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS r FROM psc) WHERE r <= 8),
    cho AS (SELECT query_id, path AS branch, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS b FROM rb WHERE rank <= 9 AND view IN ('domain', 'analysis') AND query_id % 4 <> 0 QUALIFY b <= 3),
    h0 AS (SELECT query_id, b, path, row_number() OVER (PARTITION BY query_id, b ORDER BY score DESC, path) AS r FROM cho JOIN mem USING (branch) JOIN psc USING (query_id, path) QUALIFY r <= 50),
    hr AS (SELECT query_id, b, path, row_number() OVER (PARTITION BY query_id, b ORDER BY r) AS r FROM h0 WHERE path IN (SELECT path FROM ok)),
    bs2 AS (SELECT query_id, max(score) AS base FROM sd GROUP BY ALL),
    p AS (SELECT query_id, path, max(CASE WHEN b = 1 THEN r END) AS r1, max(CASE WHEN b = 2 THEN r END) AS r2, max(CASE WHEN b = 3 THEN r END) AS r3 FROM hr GROUP BY ALL),
    j AS (SELECT coalesce(sd.query_id, p.query_id) AS query_id, coalesce(sd.path, p.path) AS path, sd.score AS s0, r1, r2, r3 FROM sd FULL JOIN p ON p.query_id = sd.query_id AND p.path = sd.path),
    k AS (SELECT j.*, coalesce(base, 0.05::DOUBLE) AS base FROM j LEFT JOIN bs2 USING (query_id)),
    f1 AS (SELECT *, CASE WHEN r1 IS NULL THEN s0 WHEN s0 IS NULL THEN base * (0.9::DOUBLE + 0.1::DOUBLE / r1) ELSE greatest(base * (0.9::DOUBLE + 0.1::DOUBLE / r1), s0) + base * 0.2::DOUBLE END AS s1 FROM k),
    f2 AS (SELECT *, CASE WHEN r2 IS NULL THEN s1 WHEN s1 IS NULL THEN base * (0.9::DOUBLE + 0.1::DOUBLE / r2) ELSE greatest(base * (0.9::DOUBLE + 0.1::DOUBLE / r2), s1) + base * 0.2::DOUBLE END AS s2 FROM f1),
    f3 AS (SELECT *, CASE WHEN r3 IS NULL THEN s2 WHEN s2 IS NULL THEN base * (0.9::DOUBLE + 0.1::DOUBLE / r3) ELSE greatest(base * (0.9::DOUBLE + 0.1::DOUBLE / r3), s2) + base * 0.2::DOUBLE END AS s3 FROM f2)
    SELECT query_id, path, round(s3, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s3, 12) DESC, path) AS rank FROM f3 QUALIFY rank <= 50""",
)
def hierarchical_search(spark, sf):
    """Three of four queries go through two views of the organisation, the rest are answered directly."""
    pages = member_pages(spark, sf)
    queries, index = cut_lineage(branch_queries(spark, sf)), S.build_index(spread(pages.drop("p_type", "p_brand")))
    seeds = cut_lineage(S.search_many(index, queries, top_k=8).select("query_id", "path", "score"))
    routes = queries.where("query_id % 4 <> 0").select("query_id", F.explode(F.array(F.lit("domain"), F.lit("analysis"))).alias("view"))
    hits, _ = HS.hierarchical_search(index, queries, seeds, routes, branch_pages(spark, sf), member_closure(pages), type_nodes(pages), scope={"topic_domain": DOMAIN})
    return hits.withColumn("score", F.round("score", 6))


@R.query(
    "branch_discovery",
    """WITH sd AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS path, round(o_totalprice / 1000000, 6) AS score FROM orders WHERE o_orderstatus = 'F'),
    h AS (SELECT o_custkey AS query_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS b, CAST(o_orderkey AS VARCHAR) AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY path) AS r FROM h), bs AS (SELECT query_id, max(score) AS base FROM sd GROUP BY ALL),
    p AS (SELECT query_id, path, max(CASE WHEN b = 1 THEN r END) AS r1, max(CASE WHEN b = 2 THEN r END) AS r2, max(CASE WHEN b = 3 THEN r END) AS r3 FROM hr GROUP BY ALL),
    j AS (SELECT coalesce(sd.query_id, p.query_id) AS query_id, coalesce(sd.path, p.path) AS path, sd.score AS s0, r1, r2, r3 FROM sd FULL JOIN p ON p.query_id = sd.query_id AND p.path = sd.path),
    k AS (SELECT j.*, coalesce(base, 0.05::DOUBLE) AS base FROM j LEFT JOIN bs USING (query_id)),
    f1 AS (SELECT *, CASE WHEN r1 IS NULL THEN s0 WHEN s0 IS NULL THEN base * (0.9::DOUBLE + 0.1::DOUBLE / r1) ELSE greatest(base * (0.9::DOUBLE + 0.1::DOUBLE / r1), s0) + base * 0.2::DOUBLE END AS s1 FROM k),
    f2 AS (SELECT *, CASE WHEN r2 IS NULL THEN s1 WHEN s1 IS NULL THEN base * (0.9::DOUBLE + 0.1::DOUBLE / r2) ELSE greatest(base * (0.9::DOUBLE + 0.1::DOUBLE / r2), s1) + base * 0.2::DOUBLE END AS s2 FROM f1),
    f3 AS (SELECT *, CASE WHEN r3 IS NULL THEN s2 WHEN s2 IS NULL THEN base * (0.9::DOUBLE + 0.1::DOUBLE / r3) ELSE greatest(base * (0.9::DOUBLE + 0.1::DOUBLE / r3), s2) + base * 0.2::DOUBLE END AS s3 FROM f2)
    SELECT query_id, path, round(round(s3, 12), 11) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s3, 12) DESC, path) AS rank FROM f3 QUALIFY rank <= 50""",
)
def branch_discovery(spark, sf):
    o = table(spark, sf, "orders")
    seeds = o.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("path"), F.round(F.col("o_totalprice") / 1000000, 6).alias("score")
    )
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").distinct()
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long")
    hits = o.select("o_orderkey", F.col("o_custkey").alias("query_id")).join(li, "o_orderkey").select(
        "query_id", rank.alias("branch_rank"), F.col("o_orderkey").cast("string").alias("path")
    )
    hits = global_rank(hits, ["query_id", "branch_rank"], [F.asc("path")])
    return BR.discover(seeds, hits).withColumn("score", F.round("score", 11))


ASPECTS_SQL = r"list_filter(['business_meaning', CASE WHEN contains(l1, chr(10)) THEN 'fields' END, CASE WHEN length(l1) > 1000 THEN 'lineage' END], lambda a: a IS NOT NULL)"


@R.query(
    "greedy_rerank",
    f"""WITH RECURSIVE {SCORED_SQL},
    pl AS (SELECT query_id, path, context_type AS kind, {ASPECTS_SQL} AS asp, 1 + ln(1 + length(l1)) / 10 AS damp, CAST(rank <= 4 AS INTEGER) AS seed, round(score, 9) / max(round(score, 9)) OVER (PARTITION BY query_id) AS rel FROM tp JOIN ipg USING (path) WHERE rank <= 8),
    go(query_id, n, ord, seen, kinds) AS (
      SELECT DISTINCT query_id, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM pl
      UNION ALL SELECT query_id, n + 1, list_append(ord, b.path), list_concat(seen, b.asp), list_append(kinds, b.kind) FROM
        (SELECT g.query_id, g.n, g.ord, g.seen, g.kinds, max({{'s': CASE WHEN g.n = 0 THEN seed ELSE 0 END, 'v': rel + CASE WHEN g.n = 0 THEN 0 ELSE
            0.18::DOUBLE * len(list_filter(asp, lambda a: NOT list_contains(g.seen, a))) / damp + CASE WHEN list_contains(g.kinds, kind) THEN 0::DOUBLE ELSE 0.12::DOUBLE END END, 'path': path, 'asp': asp, 'kind': kind}}) AS b
         FROM go g JOIN pl ON pl.query_id = g.query_id AND NOT list_contains(g.ord, pl.path) GROUP BY ALL))
    SELECT query_id, ord[n] AS path, CAST(n AS BIGINT) AS position FROM go WHERE n > 0""",
)
def greedy_rerank(spark, sf):
    """Bounded served results of the whole query set, reordered for coverage and kind diversity."""
    pg = pages(spark, sf)
    hits = S.search_many(search_index(spark, sf), query_set(spark, sf), top_k=8)
    info = pg.select("path", "context_type", F.length("l1").alias("l1_length"), F.array_compact(F.array(
        F.lit("business_meaning"), F.when(F.col("l1").contains("\n"), "fields"), F.when(F.length("l1") > 1000, "lineage"))).alias("aspects"))
    return BU.greedy_rerank(hits.withColumn("is_seed", F.col("rank") <= 4).join(info, "path"))


COST_SQL = r"CAST(greatest(1, ceil(length(regexp_replace({}, '[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]', '', 'g')) / 4.0)) AS BIGINT)"


@R.query(
    "token_budget_select",
    f"""WITH RECURSIVE {SCORED_SQL},
    ck AS (SELECT query_id, path, rank, context_type AS kind, {COST_SQL.format("l1")} AS c1, {COST_SQL.format("l0")} AS c0 FROM tp JOIN ipg USING (path) WHERE rank <= 20),
    go(query_id, pos, used, n, kinds, path, level, tokens) AS (
      SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM ck
      UNION ALL SELECT query_id, pos, used + coalesce(cost, 0), n + CAST(lv IS NOT NULL AS BIGINT), CASE WHEN lv IS NULL THEN kinds ELSE list_append(kinds, kind) END, path, lv, cost FROM
        (SELECT *, CASE lv WHEN 'L1' THEN c1 WHEN 'L0' THEN c0 END AS cost FROM
          (SELECT g.query_id, g.pos + 1 AS pos, g.used, g.n, g.kinds, ck.path, ck.kind, c1, c0, CASE WHEN g.n >= 8 OR len(list_filter(g.kinds, lambda k: k = ck.kind)) >= 3 THEN NULL WHEN g.used + c1 <= 2800 THEN 'L1' WHEN g.used + c0 <= 2800 THEN 'L0' END AS lv
           FROM go g JOIN ck ON ck.query_id = g.query_id AND ck.rank = g.pos + 1)))
    SELECT query_id, path, level, tokens, n AS position FROM go WHERE level IS NOT NULL""",
)
def token_budget_select(spark, sf):
    pg = pages(spark, sf)
    hits = S.search_many(search_index(spark, sf), query_set(spark, sf), top_k=20)
    cost = pg.select("path", "context_type", T.token_estimate(F.col("l1")).alias("l1_tokens"), T.token_estimate(F.col("l0")).alias("l0_tokens"))
    ranked = hits.join(cost, "path").withColumn("position", F.col("rank")).withColumn("seen", F.lit(False))
    return BU.budgeted_select(ranked, limit=8, token_budget=2800, max_per_type=3)


@R.query("token_estimate", r"""SELECT doc_id, CAST(greatest(1, ceil(length(regexp_replace(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]', '', 'g')) / 4.0)) AS BIGINT) AS estimate,
    CAST((length(text) + 3) // 4 AS BIGINT) AS billing FROM documents""")
def token_estimate(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.token_estimate(F.col("text")).alias("estimate"), T.billing_estimate(F.col("text")).alias("billing"))


# ----------------------------------------------------------------------------- coverage
def metric_facts(spark, sf):
    """Evidenced sections of parts (as metrics) and suppliers (as models)."""
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("data://metrics/"), "p_partkey"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    secs = p.select(
        "path", F.explode(F.array_compact(F.array(F.lit("summary"), F.when(F.col("p_size") < 30, "formula"), F.when(F.col("p_size") > 40, "grain")))).alias("section"), "p_size"
    ).select(
        "path", "section", F.when(F.col("p_size") % 6 == 0, "CANDIDATE").otherwise("EXPLICIT").alias("status"), F.lit(True).alias("evidenced"),
        (F.col("p_size") % 7 == 0).alias("conflicted"), no.alias("truncated"),
        F.when((F.col("section") == "grain") & (F.col("p_size") > 45), "NOT_APPLICABLE").alias("coverage_status"), (F.col("p_size") > 46).alias("authoritative"), no.alias("complete"),
        none.alias("selector"), F.lit("scalar measure").alias("reason"),
    )
    ctx = contexts(spark, sf).where("context_type IN ('metric', 'physical-model') AND identity_status IN ('EXPLICIT', 'DERIVED')").withColumn("evidenced", F.lit(True))
    return C.support_facts(secs, ctx)


COVER_SQL = f"""{CONTEXTS_SQL},
fx AS (SELECT 'data://metrics/' || p_partkey AS path, aspect, CASE WHEN aspect = 'grain' AND p_size > 45 THEN 'NOT_APPLICABLE' ELSE 'SATISFIED' END AS st, p_size % 7 = 0 AS conflicted
  FROM part, (SELECT unnest(['business_meaning', 'formula', 'grain']) AS aspect)
  WHERE (aspect = 'business_meaning' OR (aspect = 'formula' AND p_size < 30) OR (aspect = 'grain' AND p_size > 40)) AND p_size % 6 <> 0 AND NOT (aspect = 'grain' AND p_size > 45 AND NOT p_size > 46)
  UNION ALL SELECT path, CASE context_type WHEN 'metric' THEN 'metrics' ELSE 'models' END, 'SATISFIED', false FROM cx WHERE context_type IN ('metric', 'physical-model') AND identity_status IN ('EXPLICIT', 'DERIVED')),
rq AS (SELECT 'reference:' || substr(sha256('data://metrics/' || p_partkey), 1, 12) || ':' || aspect AS req_id, 'data://metrics/' || p_partkey AS entity, aspect
  FROM part, (SELECT unnest(['business_meaning', 'formula', 'grain', 'metrics', 'models', 'lineage']) AS aspect)),
rl AS (SELECT DISTINCT 'data://metrics/' || l_partkey AS src, 'data://physical-models/' || l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A'),
px AS (SELECT req_id, st, conflicted FROM rq JOIN fx ON fx.path = rq.entity AND fx.aspect = rq.aspect
  UNION ALL SELECT req_id, st, conflicted FROM rq JOIN rl ON rl.src = rq.entity AND rq.aspect = 'models' JOIN fx ON fx.path = rl.dst AND fx.aspect = 'models'
  UNION ALL SELECT req_id, 'SATISFIED', false FROM rq WHERE aspect = 'lineage' AND entity IN (SELECT src FROM rl)),
ag AS (SELECT req_id, count(*) AS proofs, min(st) AS lo, max(st) AS hi, bool_or(conflicted) AS mixed FROM px GROUP BY ALL),
ca AS (SELECT rq.req_id, entity, aspect, 'REFERENCE' AS layer, CASE WHEN proofs IS NULL THEN 'UNKNOWN' WHEN lo <> hi OR mixed THEN 'PARTIAL' ELSE lo END AS status,
  CASE WHEN proofs IS NULL THEN 'no_evidence_in_partial_corpus' WHEN lo <> hi OR mixed THEN 'conflicting_or_incomplete_evidence' ELSE 'entity_scoped_evidence' END AS reason,
  coalesce(proofs, 0) AS proofs FROM rq LEFT JOIN ag USING (req_id))"""

ASPECTS = ["business_meaning", "formula", "grain", "metrics", "models", "lineage"]


def assessed(spark, sf):
    ents = table(spark, sf, "part").select(F.concat(F.lit("data://metrics/"), "p_partkey").alias("entity"), F.col("p_name").alias("entity_name"))
    reqs = C.infer_requirements(ents, ASPECTS)
    li = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    rel = li.select(
        F.concat(F.lit("data://metrics/"), "l_partkey").alias("src"), F.lit("supported_by").alias("relation"), F.concat(F.lit("data://physical-models/"), "l_suppkey").alias("dst")
    )
    return C.assess(reqs, C.proofs(reqs, metric_facts(spark, sf), rel))


@R.query("coverage_assess", f"WITH {COVER_SQL} SELECT * FROM ca")
def coverage_assess(spark, sf):
    return assessed(spark, sf)


@R.query(
    "coverage_summary",
    f"WITH {COVER_SQL} SELECT layer, aspect, bool_and(status IN ('SATISFIED', 'NOT_APPLICABLE')) AS resolved, count(*) AS requirements FROM ca GROUP BY ALL",
)
def coverage_summary(spark, sf):
    return C.coverage_summary(assessed(spark, sf))


@R.query(
    "support_facts",
    f"WITH {COVER_SQL} SELECT path, aspect, conflicted FROM fx UNION ALL SELECT 'data://metrics/' || p_partkey, 'grain', p_size % 7 = 0 FROM part WHERE p_size = 46",
)
def support_facts(spark, sf):
    return metric_facts(spark, sf).select("path", "aspect", F.coalesce("conflicted", F.lit(False)).alias("conflicted"))


@R.query(
    "environment_coverage",
    """WITH rq AS (SELECT 'data://physical-models/' || s_suppkey AS entity, aspect, s_suppkey, s_acctbal, s_nationkey FROM supplier, (SELECT unnest(['models', 'grain', 'lineage']) AS aspect)),
    dc AS (SELECT entity, aspect, CASE WHEN s_acctbal > 9000 THEN 'MISSING' ELSE 'SATISFIED' END AS st FROM rq WHERE aspect = 'grain' AND (s_acctbal > 9000 AND s_nationkey > 5 OR s_acctbal BETWEEN 0 AND 2000))
    SELECT 'environment:' || substr(sha256(rq.entity), 1, 12) || ':' || rq.aspect AS req_id, rq.entity, rq.aspect, 'ENVIRONMENT' AS layer,
      CASE WHEN st IS NOT NULL THEN st WHEN s_acctbal < 0 THEN 'UNKNOWN' WHEN rq.aspect = 'models' THEN 'SATISFIED' WHEN rq.aspect = 'lineage' AND s_nationkey < 10 THEN 'SATISFIED' ELSE 'UNKNOWN' END AS status,
      CASE WHEN st IS NOT NULL THEN 'provider_scoped_assessment' WHEN s_acctbal < 0 THEN 'environment_found' WHEN rq.aspect = 'models' OR rq.aspect = 'lineage' AND s_nationkey < 10 THEN 'authoritative_entity_evidence' ELSE 'environment_found' END AS reason
    FROM rq LEFT JOIN dc USING (entity, aspect)""",
)
def environment_coverage(spark, sf):
    s = table(spark, sf, "supplier").withColumn("entity", F.concat(F.lit("data://physical-models/"), "s_suppkey"))
    reqs = C.infer_requirements(s.select("entity", F.col("s_name").alias("entity_name")), ["models", "grain", "lineage"], environment=True)
    assets = s.where("s_acctbal >= 0").select(
        F.concat(F.lit("asset:"), "s_suppkey").alias("asset_id"), F.lit("physical-model").alias("type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("code"),
        F.col("entity").alias("reference_path"),
    )
    said = s.where("s_acctbal > 9000 OR s_acctbal BETWEEN 0 AND 2000").select(
        "entity", F.lit("grain").alias("aspect"), F.when(F.col("s_acctbal") > 9000, "MISSING").otherwise("SATISFIED").alias("status"), (F.col("s_nationkey") > 5).alias("complete"),
        F.lit(True).alias("authoritative"), F.lit("inventory").alias("reason"),
    )
    flows = s.where("s_acctbal >= 0 AND s_nationkey < 10").select(F.concat(F.lit("asset:"), "s_suppkey").alias("source_id"), F.lit("UPSTREAM_OF").alias("predicate"))
    return C.assess_environment(reqs, assets, said, flows)


# ----------------------------------------------------------------------------- binding
def env_assets(spark, sf):
    """Suppliers as seen by an environment: some carry a crosswalk, some only keys, some names only."""
    s = table(spark, sf, "supplier")
    text = lambda c, t: F.when(c, t).otherwise(F.lit(None).cast("string"))
    return s.select(
        F.concat(F.lit("asset:"), "s_suppkey").alias("asset_id"), F.lit("physical-model").alias("type"), F.lower("s_name").alias("code"), F.upper("s_name").alias("name"),
        F.array(F.concat(F.lit("alias "), "s_suppkey")).alias("aliases"),
        text(F.col("s_nationkey") < 5, F.concat(F.lit("data://physical-models/"), "s_suppkey")).alias("reference_path"), F.lit("supply").alias("identity_namespace"),
        text(F.col("s_nationkey").between(5, 14), F.col("s_nationkey").cast("string")).alias("stable_id"),
        text(F.col("s_nationkey") > 14, F.concat(F.lit("db.t"), "s_suppkey")).alias("strong_key"),
    )


def env_refs(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("data://physical-models/"), "s_suppkey").alias("path"), F.lit("physical-model").alias("type"), F.col("s_name").alias("name"), F.lit("supply").alias("identity_namespace"),
        F.lit("env-1").alias("environment_id"), F.col("s_nationkey").cast("string").alias("stable_id"), F.concat(F.lit("db.t"), "s_suppkey").alias("strong_key"), (F.col("s_acctbal") >= 0).alias("explicit_identity"),
    )


BIND_SQL = """
b0 AS (SELECT 'asset:' || a.s_suppkey AS asset_id, 'data://physical-models/' || r.s_suppkey AS path,
    CASE WHEN a.s_nationkey < 5 THEN 'provider_explicit_crosswalk/v3' WHEN a.s_nationkey <= 14 THEN 'same_type_scoped_stable_id/v3' ELSE 'same_type_scoped_strong_key/v3' END AS rule
  FROM supplier a JOIN supplier r ON (a.s_nationkey < 5 AND a.s_suppkey = r.s_suppkey) OR (a.s_nationkey BETWEEN 5 AND 14 AND r.s_nationkey = a.s_nationkey AND r.s_acctbal >= 0)
    OR (a.s_nationkey > 14 AND a.s_suppkey = r.s_suppkey AND r.s_acctbal >= 0)),
ib AS (SELECT *, count(*) OVER (PARTITION BY asset_id) = 1 AND count(*) OVER (PARTITION BY path) = 1 AS confirmed FROM b0)"""


@R.query("identity_binding", f"WITH {BIND_SQL} SELECT * FROM ib")
def identity_binding(spark, sf):
    return B.identity_bindings(env_assets(spark, sf), env_refs(spark, sf), "env-1")


@R.query(
    "candidate_binding",
    f"WITH {BIND_SQL} SELECT 'asset:' || s_suppkey AS asset_id, 'data://physical-models/' || s_suppkey AS path FROM supplier WHERE 'data://physical-models/' || s_suppkey NOT IN (SELECT path FROM ib WHERE confirmed)",
)
def candidate_binding(spark, sf):
    a, r = env_assets(spark, sf), env_refs(spark, sf)
    return B.candidate_bindings(a, r, B.confirmed_bindings(a, r, "env-1"))


@R.query(
    "reference_only_assets",
    f"""WITH {BIND_SQL} SELECT 'data://physical-models/' || s_suppkey AS path, 'physical-model' AS type, 'PARTIAL' AS availability_state, 'environment_identity_unverified' AS candidate_reason
    FROM supplier WHERE 'data://physical-models/' || s_suppkey NOT IN (SELECT path FROM ib WHERE confirmed)""",
)
def reference_only_assets(spark, sf):
    a, r = env_assets(spark, sf), env_refs(spark, sf)
    return B.reference_only(r, B.confirmed_bindings(a, r, "env-1"), "PARTIAL")


@R.query(
    "relation_classification",
    """WITH r AS (SELECT 'asset:' || l_suppkey AS source_id, CASE l_linestatus WHEN 'F' THEN 'MAPS_TO' ELSE 'UPSTREAM_OF' END AS predicate,
      CASE WHEN l_linestatus = 'F' THEN 'data://physical-models/' || l_linenumber ELSE 'asset:' || l_linenumber END AS target_id, CASE l_returnflag WHEN 'R' THEN 'CANDIDATE' ELSE 'EXPLICIT' END AS a FROM lineitem)
    SELECT DISTINCT source_id, predicate, target_id, CASE predicate WHEN 'MAPS_TO' THEN 'SEMANTIC_MAPPING' ELSE 'STRUCTURAL_RELATION' END AS binding_kind FROM r WHERE a = 'EXPLICIT'
      AND source_id IN (SELECT 'asset:' || s_suppkey FROM supplier) AND (target_id IN (SELECT 'asset:' || s_suppkey FROM supplier) OR target_id IN (SELECT 'data://physical-models/' || s_suppkey FROM supplier))""",
)
def relation_classification(spark, sf):
    li = table(spark, sf, "lineitem")
    done = F.col("l_linestatus") == "F"
    rel = li.select(
        F.concat(F.lit("asset:"), "l_suppkey").alias("source_id"), F.when(done, "MAPS_TO").otherwise("UPSTREAM_OF").alias("predicate"),
        F.concat(F.when(done, "data://physical-models/").otherwise("asset:"), "l_linenumber").alias("target_id"),
        F.when(F.col("l_returnflag") == "R", "CANDIDATE").otherwise("EXPLICIT").alias("assertion_status"),
    ).distinct()
    return B.classify_relations(rel, env_assets(spark, sf), env_refs(spark, sf)).select("source_id", "predicate", "target_id", "binding_kind")


@R.query(
    "snapshot_evidence",
    "SELECT s_suppkey, s_nationkey < 20 AND s_acctbal >= 0 AS valid FROM supplier",
)
def snapshot_evidence(spark, sf):
    s = table(spark, sf, "supplier")
    one = F.struct(F.lit("env-1").alias("environment_id"), F.when(F.col("s_nationkey") < 20, "snap-7").otherwise("snap-6").alias("snapshot_token"))
    proofs = F.when(F.col("s_acctbal") >= 0, F.array(one)).otherwise(F.array().cast("array<struct<environment_id:string,snapshot_token:string>>"))
    return s.select("s_suppkey", B.snapshot_valid(proofs, "env-1", "snap-7").alias("valid"))


@R.query(
    "availability_state",
    """SELECT c_custkey AS query_id, CASE WHEN c_acctbal < -500 THEN 'UNAVAILABLE' WHEN c_mktsegment = 'MACHINERY' THEN 'UNSUPPORTED' WHEN n > 15 THEN 'TRUNCATED' WHEN n = 0 AND c_nationkey < 12 THEN 'NOT_FOUND_CONFIRMED'
      WHEN n = 0 OR c_nationkey >= 12 THEN 'PARTIAL' ELSE 'FOUND' END AS state FROM (SELECT customer.*, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""",
)
def availability_state(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("records"))
    c = table(spark, sf, "customer").join(n, "c_custkey", "left").select(
        F.col("c_custkey").alias("query_id"), F.coalesce("records", F.lit(0)).alias("records"), (F.col("c_nationkey") < 12).alias("complete"),
        (F.coalesce("records", F.lit(0)) > 15).alias("truncated"), (F.col("c_mktsegment") != "MACHINERY").alias("supported"), (F.col("c_acctbal") >= -500).alias("available"),
    )
    return B.availability_state(c).select("query_id", "state")


# ----------------------------------------------------------------------------- planning
QUERY_TEXT_SQL = """
qx AS (SELECT p_partkey AS query_id, CASE p_type WHEN 'PROMO' THEN '哪些模型提供 KPI_' || p_size WHEN 'ECONOMY' THEN '分析需要哪些数据 ' || p_name || ' LTE' WHEN 'SMALL' THEN 'SDL 字段 粒度 ' || p_name
  WHEN 'LARGE' THEN '影响 下游 ' || p_brand WHEN 'MEDIUM' THEN 'topic of ' || p_name || ', what else 指标' ELSE p_name || ' 5G asset inventory' END AS text FROM part)"""


def question_texts(spark, sf):
    p = table(spark, sf, "part")
    t = F.col("p_type")
    text = (
        F.when(t == "PROMO", F.concat(F.lit("哪些模型提供 KPI_"), "p_size")).when(t == "ECONOMY", F.concat(F.lit("分析需要哪些数据 "), "p_name", F.lit(" LTE")))
        .when(t == "SMALL", F.concat(F.lit("SDL 字段 粒度 "), "p_name")).when(t == "LARGE", F.concat(F.lit("影响 下游 "), "p_brand"))
        .when(t == "MEDIUM", F.concat(F.lit("topic of "), "p_name", F.lit(", what else 指标"))).otherwise(F.concat("p_name", F.lit(" 5G asset inventory")))
    )
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


ROUTE_SQL = f"""{QUERY_TEXT_SQL}, ro AS (SELECT query_id, text, CASE WHEN contains(text, '哪些模型') THEN 'metric_to_models' WHEN contains(text, '需要哪些数据') THEN 'analysis_data_requirement' WHEN contains(text, '字段') THEN 'model_understanding'
  WHEN contains(text, '影响') THEN 'impact_analysis' ELSE 'generic' END AS intent, CASE WHEN contains(text, 'KPI_') THEN regexp_extract(text, 'KPI_[0-9]+') WHEN contains(text, 'LTE') THEN 'LTE' END AS symbol,
  CASE WHEN contains(text, 'LTE') THEN 'LTE' WHEN contains(text, '5G') THEN '5G' END AS technology, contains(text, 'SDL') AS layer_asked, contains(text, 'topic') AS topic_asked FROM qx)"""


@R.query("query_route", f"WITH {ROUTE_SQL} SELECT query_id, intent, symbol, technology, layer_asked, topic_asked FROM ro")
def query_route(spark, sf):
    return P.route(question_texts(spark, sf)).drop("text")


@R.query(
    "query_policy",
    f"""WITH {ROUTE_SQL} SELECT query_id, CASE intent WHEN 'metric_to_models' THEN 'metrics,models' WHEN 'analysis_data_requirement' THEN 'purpose,metrics,dimensions,models' WHEN 'model_understanding' THEN 'business_meaning,business_object,fields,grain'
      WHEN 'impact_analysis' THEN 'models,lineage' ELSE 'business_meaning' END AS required, CAST(CASE intent WHEN 'analysis_data_requirement' THEN 6 ELSE 4 END AS BIGINT) AS top_k,
      CAST(CASE intent WHEN 'analysis_data_requirement' THEN 12 ELSE 8 END AS BIGINT) AS bundle_k, CAST(CASE intent WHEN 'metric_to_models' THEN 1600 WHEN 'analysis_data_requirement' THEN 2800 WHEN 'generic' THEN 1400 ELSE 2200 END AS BIGINT) AS token_budget FROM ro""",
)
def query_policy(spark, sf):
    return P.plan(P.route(question_texts(spark, sf))).select("query_id", "required", "top_k", "bundle_k", "token_budget")


@R.query(
    "retrieval_strategy",
    f"""WITH {ROUTE_SQL}, an AS (SELECT p_partkey AS query_id FROM part WHERE p_size < 20),
    x AS (SELECT ro.*, an.query_id IS NOT NULL AS anchored, contains(text, 'what else') AS crossing FROM ro LEFT JOIN an USING (query_id))
    SELECT query_id, CASE WHEN anchored AND crossing THEN 'hybrid' WHEN anchored THEN 'direct' ELSE 'hierarchical' END AS mode,
      CASE WHEN anchored AND NOT crossing THEN '' WHEN crossing THEN 'analysis,domain' WHEN layer_asked THEN 'asset' WHEN intent = 'analysis_data_requirement' THEN 'analysis' WHEN intent = 'model_understanding' THEN 'domain'
        WHEN contains(text, 'asset inventory') THEN 'asset' ELSE 'analysis' END AS views,
      CASE WHEN anchored THEN 0.99::DOUBLE WHEN intent IN ('analysis_data_requirement', 'model_understanding') THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM x""",
)
def retrieval_strategy(spark, sf):
    anchors = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("query_id"), F.lit("metric").alias("kind"))
    return P.strategy(P.route(question_texts(spark, sf)), anchors)


@R.query(
    "expansion_plan",
    f"""WITH {COVER_SQL} SELECT DISTINCT entity AS query_id, CASE aspect WHEN 'grain' THEN 'grain' WHEN 'formula' THEN 'formula' WHEN 'lineage' THEN 'lineage' ELSE 'metrics' END AS expand
    FROM ca WHERE status NOT IN ('SATISFIED', 'NOT_APPLICABLE') AND aspect IN ('grain', 'formula', 'lineage', 'metrics')""",
)
def expansion_plan(spark, sf):
    open_rows = assessed(spark, sf).where("status NOT IN ('SATISFIED', 'NOT_APPLICABLE')")
    return P.expansions(open_rows.select(F.col("entity").alias("query_id"), "aspect"))


@R.query(
    "bundle_confidence",
    f"""WITH {COVER_SQL} SELECT entity, greatest(0.2::DOUBLE, round(1.0::DOUBLE - 0.1::DOUBLE * count(*) FILTER (status NOT IN ('SATISFIED', 'NOT_APPLICABLE')) - 0.03::DOUBLE * count(*) FILTER (status = 'PARTIAL'), 6)) AS confidence FROM ca GROUP BY entity""",
)
def bundle_confidence(spark, sf):
    per = assessed(spark, sf).groupBy("entity").agg(
        F.count_if(~F.col("status").isin("SATISFIED", "NOT_APPLICABLE")).alias("open"), F.count_if(F.col("status") == "PARTIAL").alias("mixed")
    )
    return per.select("entity", BU.bundle_confidence(F.col("open"), F.col("mixed"), F.lit(0), F.lit(True)).alias("confidence"))
