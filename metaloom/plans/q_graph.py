"""Graph and hierarchy queries over the asset graph and the organisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import maintenance as U
from ..operators import provenance as P
from ..scale import cut_lineage, top_per_group
from .registry import Registry
from .tables import CONTEXTS_SQL, GRAPH_SQL, ORG_SQL, RESOLVED_SQL, contexts, graph_links, graph_nodes, org_edges, org_nodes, table

R = Registry()


def active(spark, sf):
    return H.arbitrate(H.merge_edges(org_edges(spark, sf)))


def nodes_of(spark, sf, kind):
    return graph_nodes(spark, sf).where(F.col("type") == kind).select("id")


@R.query(
    "graph_neighbors",
    f"WITH {GRAPH_SQL} SELECT src, relation, dst FROM ge WHERE dst IN (SELECT 'nation:' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
)
def graph_neighbors(spark, sf):
    asia = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = asia.select(F.concat(F.lit("nation:"), "n_nationkey").alias("path"))
    return G.neighbors(graph_links(spark, sf), wanted, "in").select("src", "relation", "dst")


@R.query(
    "graph_impact",
    f"""WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT id AS start, id AS node, 0 AS depth FROM gn WHERE type = 'region'
      UNION SELECT w.start, ge.src, w.depth + 1 FROM w JOIN ge ON ge.dst = w.node WHERE w.depth < 4),
    f AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL)
    SELECT a.start, a.node, CAST(a.depth AS BIGINT) AS depth, min(relation) AS relation, min(ge.dst) AS via FROM f a JOIN ge ON ge.src = a.node
      JOIN f b ON b.start = a.start AND b.node = ge.dst AND b.depth = a.depth - 1 WHERE a.depth > 0 GROUP BY a.start, a.node, a.depth""",
)
def graph_impact(spark, sf):
    return G.impact(graph_links(spark, sf), nodes_of(spark, sf, "region").withColumnRenamed("id", "path"))


@R.query(
    "rich_relations",
    f"""WITH {GRAPH_SQL}, s AS (SELECT src AS path, relation, dst AS other, 'outgoing' AS side FROM ge UNION ALL SELECT dst, relation, src, 'incoming' FROM ge),
    t AS (SELECT s.*, o.type AS other_type FROM s JOIN gn p ON p.id = s.path AND p.type IN ('nation', 'supplier') JOIN gn o ON o.id = s.other)
    SELECT path, side, relation, other, other_type, position FROM (SELECT *, row_number() OVER (PARTITION BY path, side ORDER BY relation, other) AS position FROM t) WHERE position <= 3""",
)
def rich_relations(spark, sf):
    nodes = graph_nodes(spark, sf)
    pages = nodes.select(F.col("id").alias("path"), F.col("id").alias("name"), F.col("type").alias("context_type"), F.lit("EXPLICIT").alias("identity_status"))
    wanted = nodes.where("type IN ('nation', 'supplier')").select(F.col("id").alias("path"))
    return G.related(graph_links(spark, sf), pages, wanted, 3).select("path", "side", "relation", "other", "other_type", "position")


@R.query(
    "khop_context",
    f"""WITH {GRAPH_SQL}, b AS (SELECT edge_id, src AS a, dst AS n, confidence FROM ge UNION ALL SELECT edge_id, dst, src, confidence FROM ge),
    l1 AS (SELECT n AS node, row_number() OVER (ORDER BY max(confidence) DESC, min(edge_id)) AS position FROM b WHERE a = 'region:0' GROUP BY n),
    l2 AS (SELECT n AS node, min(struct_pack(p := l1.position, c := -confidence, e := edge_id)) AS o FROM b JOIN l1 ON l1.node = b.a
      WHERE n <> 'region:0' AND n NOT IN (SELECT node FROM l1) GROUP BY n ORDER BY o, n LIMIT 44)
    SELECT 'region:0' AS node, CAST(0 AS BIGINT) AS level UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""",
)
def khop_context(spark, sf):
    visited, _ = G.bounded_context(graph_nodes(spark, sf), graph_links(spark, sf), "region:0", depth=2, max_nodes=50)
    return visited.select("node", F.col("level").cast("long").alias("level"))


@R.query(
    "expand_assets",
    f"""WITH {GRAPH_SQL}, t AS (SELECT *, CASE WHEN src IN ('nation:3', 'nation:7') THEN dst ELSE src END AS other FROM ge
      WHERE (src IN ('nation:3', 'nation:7') OR dst IN ('nation:3', 'nation:7')) AND relation IN ('PART_OF', 'LOCATED_IN')),
    a AS (SELECT id FROM (SELECT 'nation:3' AS id, 0 AS f, 0 AS k, 0.0::DOUBLE AS c, '' AS e UNION ALL SELECT 'nation:7', 1, 0, 0.0, ''
      UNION ALL SELECT other, CASE WHEN 'nation:3' IN (src, dst) THEN 0 ELSE 1 END, 1, -confidence, edge_id FROM t) GROUP BY id ORDER BY min(struct_pack(f, k, c, e)), id LIMIT 20)
    SELECT edge_id FROM t WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)""",
)
def expand_assets(spark, sf):
    _, inside = G.expand(graph_nodes(spark, sf), graph_links(spark, sf), ["nation:3", "nation:7"], ["PART_OF", "LOCATED_IN"], 20)
    return inside.select("edge_id")


PATHS = f"""{GRAPH_SQL}, p3 AS (SELECT a.src AS start, c.dst AS target, a.src || '>' || b.src || '>' || c.src || '>' || c.dst AS nodes, CAST(3 AS BIGINT) AS hops,
  a.confidence AS c1, b.confidence AS c2, c.confidence AS c3, a.inferred::INT + b.inferred::INT + c.inferred::INT AS inf
  FROM ge a JOIN ge b ON b.src = a.dst JOIN ge c ON c.src = b.dst WHERE a.relation = 'SUPPLIED_BY' AND b.relation = 'LOCATED_IN' AND c.relation = 'PART_OF')"""


@R.query(
    "simple_paths",
    f"""WITH {PATHS}, s AS (SELECT start, target, nodes, hops, round((c1 + c2 + c3) / 3 - inf * 0.1::DOUBLE - 0.03::DOUBLE, 4) AS score FROM p3)
    SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, hops, nodes) AS position FROM s QUALIFY position <= 10""",
)
def simple_paths(spark, sf):
    return G.find_paths(graph_links(spark, sf), nodes_of(spark, sf, "part"), nodes_of(spark, sf, "region"), max_depth=3, limit=10)


@R.query(
    "fact_trace",
    f"""WITH {PATHS}, s AS (SELECT start, target, nodes, hops, round(least(c1, c2, c3), 4) AS score FROM p3 WHERE inf = 0)
    SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, hops, nodes) AS position FROM s QUALIFY position <= 5""",
)
def fact_trace(spark, sf):
    verified = graph_links(spark, sf).where("NOT inferred")
    return G.find_paths(verified, nodes_of(spark, sf, "part"), nodes_of(spark, sf, "region"), max_depth=3, limit=5, directed=True, score="min")


@R.query(
    "bundle_completion",
    f"""WITH {CONTEXTS_SQL}, e AS (SELECT DISTINCT 'data://metrics/' || l_partkey AS src, 'supported_by' AS relation, 'data://physical-models/' || l_suppkey AS dst FROM lineitem
      UNION ALL SELECT 'data://physical-models/' || s_suppkey, 'part_of', 'data://topics/' || s_nationkey FROM supplier),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, side ORDER BY relation, target) AS link FROM
      (SELECT src AS path, dst AS target, relation, 0 AS side FROM e UNION ALL SELECT dst, src, relation, 1 FROM e)) WHERE link <= 18),
    sd AS (SELECT * FROM (SELECT s_nationkey AS query_id, 'data://physical-models/' || s_suppkey AS path, s_acctbal / 10000 AS score,
      row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS position FROM supplier WHERE s_acctbal >= 0) WHERE position <= 3),
    st AS (SELECT sd.query_id, h.target, min(struct_pack(position, side, link, score, relation)) AS o FROM sd JOIN h USING (path) JOIN cx ON cx.path = h.target AND cx.identity_status IN ('EXPLICIT', 'DERIVED')
      WHERE NOT EXISTS (SELECT 1 FROM sd x WHERE x.query_id = sd.query_id AND x.path = h.target) GROUP BY ALL),
    ad AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, target) AS n FROM st),
    cp AS (SELECT query_id, count(*) AS held, greatest(8, count(*) * 6) AS cap FROM sd GROUP BY ALL)
    SELECT query_id, path, round(score, 6) AS score, 'seed' AS reason FROM sd
    UNION ALL SELECT query_id, target, round(o.score * CASE WHEN o.side = 0 THEN 0.75 ELSE 0.55 END, 6), CASE WHEN o.side = 0 THEN 'reference:' ELSE 'backref:' END || o.relation
      FROM ad JOIN cp USING (query_id) WHERE n <= cap - held""",
)
def bundle_completion(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal >= 0").select(
        F.col("s_nationkey").alias("query_id"), F.concat(F.lit("data://physical-models/"), "s_suppkey").alias("path"),
        (F.col("s_acctbal") / 10000).alias("score"), "s_acctbal", "s_suppkey",
    )
    seeds = top_per_group(s, ["query_id"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 3, "position").drop("s_acctbal", "s_suppkey")
    allowed = contexts(spark, sf).where("identity_status IN ('EXPLICIT', 'DERIVED')").select("path")
    done = G.complete_bundles(seeds, supply_edges(spark, sf), allowed, None, top_k=3)
    return done.select("query_id", "path", F.round("score", 6).alias("score"), "reason")


def supply_edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    e = li.select(
        F.concat(F.lit("data://metrics/"), "l_partkey").alias("src"), F.lit("supported_by").alias("relation"), F.concat(F.lit("data://physical-models/"), "l_suppkey").alias("dst")
    )
    return e.unionByName(
        table(spark, sf, "supplier").select(
            F.concat(F.lit("data://physical-models/"), "s_suppkey").alias("src"), F.lit("part_of").alias("relation"), F.concat(F.lit("data://topics/"), "s_nationkey").alias("dst")
        )
    )


# ----------------------------------------------------------------------------- hierarchy
@R.query("hierarchy_edge_merge", f"WITH {ORG_SQL} SELECT edge_id, parent, child, status, confidence, owners FROM me")
def hierarchy_edge_merge(spark, sf):
    return H.merge_edges(org_edges(spark, sf)).select("edge_id", "parent", "child", "status", "confidence", "owners")


@R.query("active_edge", f"WITH {ORG_SQL} SELECT edge_id, active, conflict FROM ae")
def active_edge(spark, sf):
    return active(spark, sf).select("edge_id", "active", "conflict")


@R.query("hierarchy_closure", f"WITH {ORG_SQL} SELECT * FROM cl")
def hierarchy_closure(spark, sf):
    return H.closure(active(spark, sf))


@R.query(
    "breadcrumb",
    f"""WITH RECURSIVE {ORG_SQL}, bp AS (SELECT child, (min(struct_pack(v := NOT virtual, p := parent))).p AS parent FROM ae JOIN og ON og.path = ae.parent WHERE active GROUP BY child),
    nd AS (SELECT child AS node FROM bp UNION SELECT parent FROM bp),
    tr AS (SELECT node, node AS at_node, og.name AS trail, 1 AS depth FROM nd JOIN og ON og.path = node
      UNION ALL SELECT tr.node, bp.parent, og.name || ' > ' || tr.trail, tr.depth + 1 FROM tr JOIN bp ON bp.child = tr.at_node JOIN og ON og.path = bp.parent)
    SELECT 'domain' AS view, node, trail, CAST(depth AS BIGINT) AS depth FROM tr QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth DESC) = 1""",
)
def breadcrumb(spark, sf):
    return H.breadcrumbs(active(spark, sf), org_nodes(spark, sf))


@R.query(
    "classification_status",
    f"""WITH {ORG_SQL}, pl AS (SELECT DISTINCT child FROM ae WHERE active)
    SELECT path, CASE WHEN context_type = 'topic-domain' THEN CASE WHEN child IS NULL THEN 'unclassified' ELSE 'classified' END WHEN child IS NULL THEN 'unclassified' ELSE 'partially_classified' END AS status,
      CASE context_type WHEN 'topic-domain' THEN CASE WHEN child IS NULL THEN 'domain' ELSE '' END WHEN 'logical-model' THEN CASE WHEN child IS NULL THEN 'analysis,asset,domain' ELSE 'analysis,asset' END
      ELSE CASE WHEN child IS NULL THEN 'analysis,domain' ELSE 'analysis' END END AS missing_views FROM og LEFT JOIN pl ON pl.child = og.path""",
)
def classification_status(spark, sf):
    return H.classification_status(org_nodes(spark, sf), active(spark, sf))


@R.query(
    "cycle_check",
    """WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS a, 'p' || (p_size * 13) AS b FROM part WHERE p_partkey <> p_size * 13),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT DISTINCT 'domain' AS view, b AS node FROM r WHERE a IN (SELECT a FROM r WHERE a = b)""",
)
def cycle_check(spark, sf):
    p = table(spark, sf, "part").select(
        F.lit("domain").alias("view"), F.concat(F.lit("p"), "p_partkey").alias("parent"), F.concat(F.lit("p"), F.col("p_size") * 13).alias("child")
    )
    return H.cyclic_nodes(p)


@R.query(
    "hierarchy_integrity",
    f"""WITH {ORG_SQL}, kn AS (SELECT path FROM og WHERE path NOT IN (SELECT 'data://topics/' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'))
    SELECT DISTINCT 'broken_parent_reference' AS code, edge_id AS subject FROM ae WHERE parent NOT IN (SELECT path FROM kn) OR child NOT IN (SELECT path FROM kn)
    UNION ALL SELECT conflict, edge_id FROM ae WHERE conflict IS NOT NULL""",
)
def hierarchy_integrity(spark, sf):
    asia = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    gone = asia.select(F.concat(F.lit("data://topics/"), "n_nationkey").alias("path"))
    return H.integrity_issues(active(spark, sf), org_nodes(spark, sf).join(gone, "path", "left_anti"))


@R.query(
    "aggregate_pages",
    f"""WITH {ORG_SQL}, mb AS (SELECT view, ancestor AS branch, count(*) AS member_count, count(*) FILTER (context_type = 'logical-model') AS logical_models,
      count(*) FILTER (context_type = 'physical-model') AS physical_models FROM cl JOIN og ON og.path = cl.node GROUP BY ALL),
    eb AS (SELECT parent AS branch, status FROM ae UNION ALL SELECT cl.ancestor, status FROM ae JOIN cl ON cl.node = ae.parent),
    ct AS (SELECT branch, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'DERIVED') AS derived, count(*) FILTER (status = 'CANDIDATE') AS candidate FROM eb GROUP BY ALL)
    SELECT mb.*, confirmed, derived, candidate, round((confirmed + derived) / greatest(1, confirmed + derived + candidate), 6) AS quality FROM mb LEFT JOIN ct USING (branch)""",
)
def aggregate_pages(spark, sf):
    e = active(spark, sf)
    return H.branch_summary(H.closure(e), org_nodes(spark, sf), e)


# ----------------------------------------------------------------------------- provenance
# Placements with who stated them, on what evidence and from which file: orders state where their customer belongs.
PROVENANCE_SQL = f"""{ORG_SQL},
ct AS (SELECT parent, child, status, method, rule_id, owner, NULL::VARCHAR AS evidence, 'file:taxonomy' AS source FROM oe WHERE child_kind = 'topic'
  UNION ALL SELECT parent, child, status, method, rule_id, owner, NULL, NULL FROM oe WHERE child_kind = 'business-object'
  UNION ALL SELECT parent, child, status, method, rule_id, 'data://logical-models/' || o_orderkey, 'order:' || o_orderkey, 'file:' || o_orderpriority
    FROM oe JOIN orders ON child = 'data://business-objects/' || o_custkey WHERE child_kind = 'business-object'
  UNION ALL SELECT parent, child, status, method, rule_id, owner, 'flag:' || l_returnflag || l_linestatus, 'file:' || o_orderpriority
    FROM oe JOIN orders ON child = 'data://logical-models/' || o_orderkey JOIN lineitem ON l_orderkey = o_orderkey),
ce AS (SELECT edge_id, confidence, owner, evidence, source FROM ct JOIN me ON me.parent = ct.parent AND me.child = ct.child AND me.status = ct.status AND me.method = ct.method AND me.rule_id IS NOT DISTINCT FROM ct.rule_id)"""


def contributions(spark, sf):
    edges = org_edges(spark, sf)
    order = table(spark, sf, "orders").select(
        F.concat(F.lit("data://business-objects/"), "o_custkey").alias("customer"), F.concat(F.lit("data://logical-models/"), "o_orderkey").alias("order"),
        F.concat(F.lit("order:"), "o_orderkey").alias("row"), F.concat(F.lit("file:"), "o_orderpriority").alias("file"), "o_orderkey",
    )
    flags = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("flag:"), "l_returnflag", "l_linestatus").alias("flag")).distinct()
    none = F.lit(None).cast("string")
    proof = lambda rows, evidence, source: rows.select(*edges.columns, evidence.alias("evidence"), source.alias("source"))
    customers = edges.where("child_kind = 'business-object'")
    stated = customers.join(order, F.col("child") == F.col("customer")).withColumn("owner", F.col("order"))
    flagged = edges.where("child_kind = 'logical-model'").join(order, F.col("child") == F.col("order")).join(flags, F.col("o_orderkey") == F.col("l_orderkey"))
    return (
        proof(edges.where("child_kind = 'topic'"), none, F.lit("file:taxonomy"))
        .unionByName(proof(customers, none, none))
        .unionByName(proof(stated, F.col("row"), F.col("file")))
        .unionByName(proof(flagged, F.col("flag"), F.col("file")))
    )


@R.query(
    "edge_provenance",
    f"""WITH {PROVENANCE_SQL} SELECT edge_id, 'owner' AS kind, owner AS item FROM ce UNION SELECT edge_id, 'evidence', evidence FROM ce WHERE evidence IS NOT NULL
    UNION SELECT edge_id, 'source', source FROM ce WHERE source IS NOT NULL""",
)
def edge_provenance(spark, sf):
    return P.provenance_rows(*P.merge_provenance(contributions(spark, sf)))


@R.query(
    "edge_provenance_counts",
    f"WITH {PROVENANCE_SQL} SELECT edge_id, max(confidence) AS confidence, count(DISTINCT owner) AS owner_count, count(DISTINCT evidence) AS evidence_count, count(DISTINCT source) AS source_count FROM ce GROUP BY edge_id",
)
def edge_provenance_counts(spark, sf):
    merged, _ = P.merge_provenance(contributions(spark, sf))
    return merged.select("edge_id", "confidence", "owner_count", "evidence_count", "source_count")


@R.query(
    "evidence_existence",
    f"""WITH {PROVENANCE_SQL}, kn AS (SELECT 'flag:' || l_returnflag || l_linestatus AS evidence FROM lineitem WHERE l_returnflag <> 'N' UNION SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT 'evidence_not_found' AS code, edge_id AS subject, count(DISTINCT evidence) AS missing FROM ce WHERE evidence IS NOT NULL AND evidence NOT IN (SELECT evidence FROM kn) GROUP BY edge_id""",
)
def evidence_existence(spark, sf):
    """Edges that rest on evidence which is not on record: open lines and open orders are not."""
    flags = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.concat(F.lit("flag:"), "l_returnflag", "l_linestatus").alias("evidence"))
    rows = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("order:"), "o_orderkey").alias("evidence"))
    return P.evidence_issues(*P.merge_provenance(contributions(spark, sf)), flags.union(rows))


@R.query(
    "page_integrity",
    f"""WITH {ORG_SQL}, cx AS (SELECT path FROM og WHERE NOT virtual),
    pg AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'data://views/domain/topic/' END || 'data://topics/' || n_nationkey AS path, 'data://topics/' || n_nationkey AS node, n_nationkey % 3 = 1 AS old FROM nation
      UNION ALL SELECT path, path, false FROM og WHERE virtual),
    bl AS (SELECT ancestor, node AS member FROM cl JOIN cx ON cx.path = cl.node),
    op AS (SELECT 'data://logical-models/' || o_orderkey AS member FROM orders WHERE o_orderstatus = 'P')
    SELECT 'page_path_collision' AS code, path AS subject FROM pg WHERE path IN (SELECT path FROM cx)
    UNION ALL SELECT 'view_uri_mismatch', path FROM pg WHERE path NOT LIKE 'data://views/domain/%'
    UNION ALL SELECT DISTINCT 'aggregate_member_mismatch', pg.path FROM pg JOIN bl ON bl.ancestor = pg.node JOIN op USING (member) WHERE old""",
)
def page_integrity(spark, sf):
    """Branch pages of nations and regions, some stored below a wrong path, some before the orders in progress were known."""
    closed = cut_lineage(H.closure(active(spark, sf)))
    real = org_nodes(spark, sf).where("NOT virtual").select("path")
    n = table(spark, sf, "nation")
    topic = F.concat(F.lit("data://topics/"), "n_nationkey")
    nations = n.select(F.when(F.col("n_nationkey") % 5 == 0, topic).otherwise(F.concat(F.lit("data://views/domain/topic/"), topic)).alias("path"), topic.alias("node"), (F.col("n_nationkey") % 3 == 1).alias("old"))
    regions = org_nodes(spark, sf).where("virtual").select("path", F.col("path").alias("node"), F.lit(False).alias("old"))
    pages = nations.unionByName(regions).withColumn("view", F.lit("domain"))
    below = closed.join(real.select(F.col("path").alias("node")), "node", "left_semi").select("view", F.col("ancestor"), F.col("node").alias("member"))
    running = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("data://logical-models/"), "o_orderkey").alias("member"), F.lit(True).alias("running"))
    stored = below.join(pages.select("view", F.col("node").alias("ancestor"), "path", "old"), ["view", "ancestor"]).join(running, "member", "left")
    return P.page_issues(pages.drop("old"), stored.where("NOT old OR running IS NULL").select("path", "member"), closed, real)


# ----------------------------------------------------------------------------- upkeep
def earlier_and_now(spark, sf):
    """The organisation of the tables, and an earlier state of it: other contexts, and placements that have moved since."""
    placements = org_edges(spark, sf)

    def marked(nodes, rows):
        held = rows.groupBy(F.col("owner").alias("path")).agg(F.array_sort(F.collect_list(F.struct("parent", "status", "method"))).alias("held"))
        return nodes.select("path", "context_type").join(held, "path", "left").select("path", "context_type", F.sha2(F.to_json(F.struct("path", "held")), 256).alias("fingerprint"))

    topic = lambda k: F.concat(F.lit("data://topics/"), k)
    number = lambda c: F.substring_index(c, "/", -1).try_cast("int")
    moved = F.when((F.col("owner") == "data://topics/5"), F.lit("data://views/domain/topic-domain/ASIA")).when(
        F.col("owner").startswith("data://business-objects/") & (number("owner") % 11 == 3), topic((number("parent") + 3) % 25)
    ).otherwise(F.col("parent"))
    before = placements.withColumn("parent", moved)
    # Some contexts are new since, some have gone, and their placements with them.
    born = F.col("path").startswith("data://logical-models/") & (number("path") % 13 == 5)
    nodes = org_nodes(spark, sf)
    left = nodes.where("context_type = 'logical-model'").where(number("path") % 17 == 2).withColumn("path", F.concat("path", F.lit("-gone")))
    earlier = nodes.where(~born).unionByName(left)
    last = before.where("child_kind = 'logical-model'").where(number("owner") % 17 == 2)
    last = last.withColumns({c: F.concat(c, F.lit("-gone")) for c in ("owner", "child")})
    before = before.join(earlier.select(F.col("path").alias("owner")), "owner", "left_semi").unionByName(last)
    return U.build(marked(earlier, before), before), marked(nodes, placements), placements


def updated(spark, sf):
    then, now, placements = earlier_and_now(spark, sf)
    place = lambda paths: placements.join(paths.withColumnRenamed("path", "owner"), "owner", "left_semi")
    return U.update(then, now, place)


@R.query("incremental_closure", f"WITH {ORG_SQL} SELECT * FROM cl")
def incremental_closure(spark, sf):
    return updated(spark, sf)[0].closed


@R.query(
    "incremental_hierarchy",
    f"""WITH {ORG_SQL}, mb AS (SELECT view, ancestor AS branch, count(*) AS member_count, count(*) FILTER (context_type = 'logical-model') AS logical_models,
      count(*) FILTER (context_type = 'physical-model') AS physical_models FROM cl JOIN og ON og.path = cl.node GROUP BY ALL),
    eb AS (SELECT parent AS branch, status FROM ae UNION ALL SELECT cl.ancestor, status FROM ae JOIN cl ON cl.node = ae.parent),
    ct AS (SELECT branch, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'DERIVED') AS derived, count(*) FILTER (status = 'CANDIDATE') AS candidate FROM eb GROUP BY ALL)
    SELECT mb.*, confirmed, derived, candidate, round((confirmed + derived) / greatest(1, confirmed + derived + candidate), 6) AS quality FROM mb LEFT JOIN ct USING (branch)""",
)
def incremental_hierarchy(spark, sf):
    """Branch sums kept up from an earlier state, against a rebuild."""
    return updated(spark, sf)[0].summary


VALUES_SQL = "v AS (SELECT DISTINCT 'data://logical-models/' || o_orderkey AS path, 'metrics' AS section, p_name AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


@R.query(
    "aggregate_top_values",
    f"""WITH {ORG_SQL}, {VALUES_SQL}, c AS (SELECT view, ancestor AS branch, section, value, count(*) AS members FROM v JOIN cl ON cl.node = v.path GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY view, branch, section ORDER BY members DESC, value) AS rank FROM c QUALIFY rank <= 12""",
)
def aggregate_top_values(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    v = li.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("data://logical-models/"), "l_orderkey").alias("path"), F.lit("metrics").alias("section"), F.col("p_name").alias("value")
    )
    return H.branch_top_values(H.closure(active(spark, sf)), v)


@R.query(
    "branch_preview",
    f"""WITH {ORG_SQL}, m AS (SELECT view, ancestor AS branch, path, context_type FROM cl JOIN og ON og.path = cl.node)
    SELECT *, row_number() OVER (PARTITION BY view, branch ORDER BY path) AS position FROM m QUALIFY position <= 1000""",
)
def branch_preview(spark, sf):
    return H.branch_preview(H.closure(active(spark, sf)), org_nodes(spark, sf))


@R.query(
    "reference_view_edges",
    f"""WITH {RESOLVED_SQL} SELECT 'domain' AS view, target_path AS parent, source AS child, 'topic' AS parent_kind, 'business-object' AS child_kind, relation AS source_relation
    FROM rr WHERE status = 'CONFIRMED' AND relation = 'part_of'""",
)
def reference_view_edges(spark, sf):
    from .q_compile import resolved

    e = H.reference_edges(resolved(spark, sf), contexts(spark, sf))
    return e.select("view", "parent", "child", "parent_kind", "child_kind", "source_relation")


# Parts as physical models with governed labels: type > brand > the two words of the name.
def part_labels(spark, sf):
    p = table(spark, sf, "part").withColumn("ctx_id", F.concat(F.lit("data://physical-models/p"), "p_partkey"))
    words = F.split("p_name", " ")
    status = F.when(F.col("p_size") > 25, "EXPLICIT").otherwise("DERIVED").alias("status")
    one = lambda section, c: p.select("ctx_id", F.lit(section).alias("section"), c.alias("label"), status)
    rows = one("topic_domain", F.col("p_type")).unionByName(one("topic", F.col("p_brand")))
    for section in ("primary_objects", "scenarios"):
        rows = rows.unionByName(p.select("ctx_id", F.lit(section).alias("section"), F.explode(words).alias("label"), status))
    return rows.unionByName(one("analysis_purposes", F.col("p_type"))).unionByName(one("analysis_purposes", F.col("p_brand")))


def part_contexts(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("data://physical-models/p"), "p_partkey").alias("path"), F.lit("physical-model").alias("context_type"), F.concat(F.lit("p"), "p_partkey").alias("name")
    )


LABELS_SQL = """
pl AS (SELECT 'data://physical-models/p' || p_partkey AS owner, p_type, p_brand, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
  CASE WHEN p_size > 25 THEN 'EXPLICIT' ELSE 'DERIVED' END AS status FROM part),
lb AS (SELECT owner, 'domain' AS view, 2 AS step, 'topic-domain' AS kind, p_type AS label, status FROM pl UNION ALL SELECT owner, 'domain', 3, 'topic', p_brand, status FROM pl
  UNION ALL SELECT owner, 'domain', 4, 'business-object', w1, status FROM pl UNION ALL SELECT owner, 'domain', 4, 'business-object', w2, status FROM pl
  UNION ALL SELECT owner, 'analysis', 4, 'business-object', w1, status FROM pl UNION ALL SELECT owner, 'analysis', 4, 'business-object', w2, status FROM pl
  UNION ALL SELECT owner, 'analysis', 0, 'scenario', w1, status FROM pl UNION ALL SELECT owner, 'analysis', 0, 'scenario', w2, status FROM pl
  UNION ALL SELECT owner, 'analysis', 1, 'analysis-purpose', p_type, status FROM pl UNION ALL SELECT owner, 'analysis', 1, 'analysis-purpose', p_brand, status FROM pl),
ln AS (SELECT *, 'data://views/' || view || '/' || kind || '/' || replace(label, '#', '%23') AS node FROM lb),
sp AS (SELECT DISTINCT 'analysis' AS view, 'data://views/analysis/scenario/' || w1 AS parent, 'data://views/analysis/analysis-purpose/' || p_type AS child FROM pl WHERE status = 'EXPLICIT' AND w2 = 'ring')"""


def labelled(spark, sf):
    return H.resolve_nodes(H.section_labels(part_labels(spark, sf)), part_contexts(spark, sf))


@R.query(
    "section_placements",
    f"""WITH {LABELS_SQL} SELECT DISTINCT view, node AS parent, owner AS child, kind AS parent_kind, CASE WHEN status = 'EXPLICIT' THEN 'CONFIRMED' ELSE 'DERIVED' END AS status,
    CASE WHEN status = 'DERIVED' THEN 'governed-section-projection' END AS rule_id FROM ln""",
)
def section_placements(spark, sf):
    e = H.section_edges(labelled(spark, sf), part_contexts(spark, sf))
    return e.select("view", "parent", "child", "parent_kind", "status", "rule_id").distinct()


@R.query(
    "co_class_guard",
    f"""WITH {LABELS_SQL}, d AS (SELECT DISTINCT owner, view, step, kind, node FROM ln), z AS (SELECT owner, view, step, count(*) AS size FROM d GROUP BY ALL),
    nx AS (SELECT *, lag(step) OVER (PARTITION BY owner, view ORDER BY step) AS ps, lag(size) OVER (PARTITION BY owner, view ORDER BY step) AS pz FROM z)
    SELECT nx.owner, nx.view, a.node AS parent, b.node AS child, pz AS parent_cardinality, size AS child_cardinality FROM nx JOIN d a ON a.owner = nx.owner AND a.view = nx.view AND a.step = nx.ps
      JOIN d b ON b.owner = nx.owner AND b.view = nx.view AND b.step = nx.step LEFT JOIN sp ON sp.view = nx.view AND sp.parent = a.node AND sp.child = b.node
    WHERE a.node <> b.node AND (pz = 1 OR size = 1 OR sp.parent IS NOT NULL)""",
)
def co_class_guard(spark, sf):
    p = table(spark, sf, "part").where("p_size > 25 AND p_name LIKE '% ring'")
    refs = p.select(
        F.concat(F.lit("data://views/analysis/scenario/"), F.split("p_name", " ")[0]).alias("source"), F.lit("has_purpose").alias("relation"),
        F.concat(F.lit("data://views/analysis/analysis-purpose/"), "p_type").alias("target_path"), F.lit("CONFIRMED").alias("status"),
    )
    e = H.co_classification(labelled(spark, sf), H.supported_pairs(refs))
    return e.select("owner", "view", "parent", "child", "parent_cardinality", "child_cardinality")


@R.query(
    "element_projection",
    """SELECT 'data://logical-models/' || l_orderkey AS parent, 'hierarchy://elements/asset/order%3A' || l_orderkey || '/line%20' || r AS child FROM
    (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r FROM lineitem) WHERE r < 8""",
)
def element_projection(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    f = top_per_group(li, ["l_orderkey"], order, 8).select(
        F.concat(F.lit("order:"), "l_orderkey").alias("canonical_id"), F.concat(F.lit("data://logical-models/"), "l_orderkey").alias("path"),
        (F.col("rank") - 1).alias("position"), F.concat(F.lit("line "), F.col("rank") - 1).alias("field"),
    )
    return H.element_edges(f).select("parent", "child")


@R.query(
    "tag_mapping",
    """SELECT 'domain' AS view, 'data://views/domain/business-category/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE 'Home%20and%20Living' END AS parent,
    'data://business-objects/' || c_custkey AS child, 'DERIVED' AS status, CASE c_mktsegment WHEN 'BUILDING' THEN 'tag-1' ELSE 'tag-2' END AS rule_id, 0.95::DOUBLE AS confidence
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE')""",
)
def tag_mapping(spark, sf):
    tags = table(spark, sf, "customer").select(F.concat(F.lit("data://business-objects/"), "c_custkey").alias("path"), F.col("c_mktsegment").alias("tag"))
    maps = spark.createDataFrame(
        [("BUILDING", "domain", "business-category", "Construction", "tag-1"), ("HOUSEHOLD", "domain", "business-category", "Home and Living", "tag-2"),
         ("FURNITURE", "domain", "business-category", "Home and Living", "tag-2")],
        "tag string, view string, kind string, label string, rule_id string",
    )
    return H.tag_edges(tags, maps).select("view", "parent", "child", "status", "rule_id", "confidence")


@R.query(
    "taxonomy_transition_check",
    f"WITH {ORG_SQL} SELECT edge_id FROM ae WHERE parent_kind = 'topic-domain' AND child_kind <> 'topic'",
)
def taxonomy_transition_check(spark, sf):
    return H.transition_errors(active(spark, sf)).select("edge_id")
