"""Identity, fusion and references over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion as FU
from ..operators import identity as I
from ..operators import references as RF
from .registry import Registry
from .tables import (
    CONTEXTS_SQL, FRAGMENT_AUTHORITY, FRAGMENTS_SQL, RESOLVED_SQL, contexts, fragments, norm_sql, references, table,
)

R = Registry()
AUTH = {"formula": FRAGMENT_AUTHORITY}

FOLD_SQL = f"""{FRAGMENTS_SQL},
sr AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY seq) AS i,
  CASE source_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank
  FROM fr WHERE section = 'formula' AND status <> 'CANDIDATE'),
fold AS (
  SELECT ctx_id, i, seq AS arrived, seq, value, source_type, status, rank, NULL::VARCHAR AS kept, NULL::VARCHAR AS discarded, NULL::VARCHAR AS kept_source, NULL::VARCHAR AS discarded_source FROM sr WHERE i = 1
  UNION ALL
  SELECT s.ctx_id, s.i, s.seq,
    CASE WHEN s.value <> f.value AND s.rank > f.rank THEN s.seq ELSE f.seq END,
    CASE WHEN s.value <> f.value AND s.rank > f.rank THEN s.value ELSE f.value END,
    CASE WHEN s.value <> f.value AND s.rank > f.rank THEN s.source_type ELSE f.source_type END,
    CASE WHEN s.value <> f.value AND s.rank > f.rank THEN s.status ELSE f.status END,
    CASE WHEN s.value <> f.value AND s.rank > f.rank THEN s.rank ELSE f.rank END,
    CASE WHEN s.value = f.value THEN NULL WHEN s.rank > f.rank THEN s.value ELSE f.value END,
    CASE WHEN s.value = f.value THEN NULL WHEN s.rank > f.rank THEN f.value ELSE s.value END,
    CASE WHEN s.value = f.value THEN NULL WHEN s.rank > f.rank THEN s.source_type ELSE f.source_type END,
    CASE WHEN s.value = f.value THEN NULL WHEN s.rank > f.rank THEN f.source_type ELSE s.source_type END
  FROM fold f JOIN sr s ON s.ctx_id = f.ctx_id AND s.i = f.i + 1)"""


@R.query(
    "scalar_fusion_winner",
    f"""WITH RECURSIVE {FOLD_SQL} SELECT ctx_id, 'formula' AS section, seq, value, source_type, status FROM fold
    QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY i DESC) = 1""",
)
def scalar_fusion_winner(spark, sf):
    return FU.fuse_scalars(FU.scalar_states(fragments(spark, sf), AUTH)).drop("rank")


@R.query(
    "scalar_fusion_conflicts",
    f"""WITH RECURSIVE {FOLD_SQL} SELECT ctx_id, 'formula' AS section, arrived AS seq, kept, discarded, kept_source, discarded_source FROM fold WHERE kept IS NOT NULL""",
)
def scalar_fusion_conflicts(spark, sf):
    fr = fragments(spark, sf)
    return FU.scalar_conflicts(fr, FU.scalar_states(fr, AUTH), AUTH)


@R.query(
    "list_fusion_union",
    f"WITH {FRAGMENTS_SQL} SELECT ctx_id, section, value, min(seq) AS first_seq, count(*) AS mentions FROM fr WHERE section = 'metrics' AND status <> 'CANDIDATE' GROUP BY ALL",
)
def list_fusion_union(spark, sf):
    return FU.fuse_lists(fragments(spark, sf))


@R.query(
    "fusion_status_min",
    f"""WITH {FRAGMENTS_SQL} SELECT ctx_id, section, CASE min(CASE status WHEN 'EXPLICIT' THEN 3 ELSE 2 END) WHEN 3 THEN 'EXPLICIT' ELSE 'DERIVED' END AS status
    FROM fr WHERE status <> 'CANDIDATE' GROUP BY ALL""",
)
def fusion_status_min(spark, sf):
    return FU.combined_status(fragments(spark, sf))


@R.query("candidate_sections", f"WITH {FRAGMENTS_SQL} SELECT ctx_id, section, seq, value, status FROM fr WHERE status = 'CANDIDATE'")
def candidate_sections(spark, sf):
    return FU.candidate_sections(fragments(spark, sf)).select("ctx_id", "section", "seq", "value", "status")


@R.query(
    "stable_id_hash",
    r"""SELECT p_partkey, 'tpl-' || substr(sha256('part.json' || chr(31) || '/parts/' || p_partkey || chr(31) || p_type || chr(31) || p_name || chr(31) || 'identity'), 1, 20) AS fragment_id,
    sha256(p_name) AS name_hash FROM part""",
)
def stable_id_hash(spark, sf):
    p = table(spark, sf, "part")
    parts = [F.lit("part.json"), F.concat(F.lit("/parts/"), "p_partkey"), F.col("p_type"), F.col("p_name"), F.lit("identity")]
    return p.select(
        "p_partkey", F.concat(F.lit("tpl-"), T.short_hash(T.pair_key(*parts))).alias("fragment_id"), F.sha2("p_name", 256).alias("name_hash")
    )


@R.query(
    "slug_normalize",
    rf"""SELECT c_custkey, {norm_sql('c_name')} AS norm,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name)), '[\s_]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g'), '-') AS slug,
    'data://business-objects/' || trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name)), '[\s_]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g'), '-') AS path FROM customer""",
)
def slug_normalize(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", T.normalize(F.col("c_name")).alias("norm"), T.slug(F.col("c_name")).alias("slug"),
        I.path_of(F.lit("business-object"), F.col("c_name")).alias("path"),
    )


@R.query(
    "canonical_id_suffix",
    r"""WITH b AS (SELECT p_partkey, 'metric:' || replace(p_name, ' ', '-') AS base FROM part)
    SELECT p_partkey AS "group", CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS canonical_id FROM
    (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS r FROM b)""",
)
def canonical_id_suffix(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("group"), F.lit("metric").alias("context_type"), F.col("p_name").alias("name"))
    return I.canonical_ids(p).select("group", "canonical_id")


# Part names serve as catalog names: many parts share a name, so lookups can be uncertain.
PART_NAMES = "pn AS (SELECT DISTINCT 'metric' AS context_type, p_brand || ':' || p_type AS path, p_name AS name FROM part)"


def part_names(spark, sf):
    return table(spark, sf, "part").select(
        F.lit("metric").alias("context_type"), F.concat_ws(":", "p_brand", "p_type").alias("path"), F.col("p_name").alias("name")
    ).distinct()


@R.query(
    "alias_lookup",
    f"""WITH {CONTEXTS_SQL}, k AS (SELECT context_type, {norm_sql('name')} AS key, min(path) AS a, max(path) AS b FROM cx GROUP BY ALL),
    w AS (SELECT 'physical-model' AS context_type, upper(s_name) AS name FROM supplier UNION ALL SELECT 'topic', 'nation ' || (n_nationkey * 2) FROM nation)
    SELECT w.context_type, w.name, CASE WHEN a IS NULL THEN 'DIFFERENT' WHEN a = b THEN 'SAME' ELSE 'UNCERTAIN' END AS decision, CASE WHEN a = b THEN a END AS path
    FROM w LEFT JOIN k ON k.context_type = w.context_type AND k.key = {norm_sql('w.name')}""",
)
def alias_lookup(spark, sf):
    s = table(spark, sf, "supplier").select(F.lit("physical-model").alias("context_type"), F.upper("s_name").alias("name"))
    n = table(spark, sf, "nation").select(
        F.lit("topic").alias("context_type"), F.concat(F.lit("nation "), F.col("n_nationkey") * 2).alias("name")
    )
    return I.lookup_names(s.unionByName(n), contexts(spark, sf))


@R.query(
    "ambiguous_identity",
    f"WITH {PART_NAMES} SELECT context_type, {norm_sql('name')} AS key, count(DISTINCT path) AS owners FROM pn GROUP BY ALL HAVING count(DISTINCT path) > 1",
)
def ambiguous_identity(spark, sf):
    return I.ambiguous_keys(I.name_keys(part_names(spark, sf)), ["context_type", "key"], "path")


@R.query(
    "identity_hint_lookup",
    """WITH h AS (SELECT DISTINCT 'business-object' AS t, 'segment_nation' AS hint, lower(c_mktsegment) || c_nationkey AS v, 'c' || c_custkey AS path FROM customer
      UNION ALL SELECT 'business-object', 'number', CAST(c_custkey AS VARCHAR), 'c' || c_custkey FROM customer),
    w AS (SELECT o_orderkey AS id, 'number' AS hint, CAST(o_custkey AS VARCHAR) AS v FROM orders
      UNION ALL SELECT o_orderkey, 'segment_nation', 'building' || (o_orderkey % 25) FROM orders WHERE o_orderstatus = 'F')
    SELECT id, min(path) AS path FROM w JOIN h ON h.hint = w.hint AND h.v = w.v GROUP BY id HAVING count(DISTINCT path) = 1""",
)
def identity_hint_lookup(spark, sf):
    c = table(spark, sf, "customer").withColumn("path", F.concat(F.lit("c"), "c_custkey"))
    bo = F.lit("business-object").alias("context_type")
    known = c.select(bo, F.lit("segment_nation").alias("hint"), F.concat(F.lower("c_mktsegment"), F.lit("_"), "c_nationkey").alias("value"), "path")
    known = known.unionByName(c.select(bo, F.lit("number").alias("hint"), F.col("c_custkey").cast("string").alias("value"), "path"))
    o = table(spark, sf, "orders")
    asked = o.select(F.col("o_orderkey").alias("id"), bo, F.lit("number").alias("hint"), F.col("o_custkey").cast("string").alias("value"))
    asked = asked.unionByName(
        o.where("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("id"), bo, F.lit("segment_nation").alias("hint"), F.concat(F.lit("BUILDING-"), F.col("o_orderkey") % 25).alias("value")
        )
    )
    return I.lookup_hints(asked, known)


@R.query(
    "fuzzy_identity",
    """WITH f AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS n, p_brand AS v FROM part),
    c AS (SELECT DISTINCT p_type AS path, split_part(p_name, ' ', 1) AS cn, p_brand AS v FROM part)
    SELECT DISTINCT id, path, 0.88::DOUBLE AS confidence FROM f JOIN c ON f.v = c.v AND (contains(n, cn) OR contains(cn, n))""",
)
def fuzzy_identity(spark, sf):
    p = table(spark, sf, "part")
    frag = p.select(
        F.col("p_partkey").alias("id"), F.lit("metric").alias("context_type"), F.col("p_name").alias("name"), F.lit("brand").alias("feature"), F.col("p_brand").alias("value")
    )
    short = F.split_part("p_name", F.lit(" "), F.lit(1))
    known = p.select(
        F.col("p_type").alias("path"), F.lit("metric").alias("context_type"), short.alias("name"), F.lit("brand").alias("feature"), F.col("p_brand").alias("value")
    ).distinct()
    return I.fuzzy_containment(frag, known)


@R.query(
    "fragment_grouping",
    """WITH RECURSIVE l AS (SELECT c_custkey AS seq, c_nationkey || '|' || CAST(floor(c_acctbal / 10) AS BIGINT) AS key FROM customer
      UNION ALL SELECT c_custkey, c_mktsegment || '|' || CAST(floor(c_acctbal / 10) AS BIGINT) FROM customer),
    e AS (SELECT DISTINCT a.seq AS x, b.seq AS y FROM l a JOIN l b USING (key)),
    w AS (SELECT x, y FROM e UNION SELECT w.x, e.y FROM w JOIN e ON w.y = e.x)
    SELECT x AS seq, min(y) AS "group" FROM w GROUP BY x""",
)
def fragment_grouping(spark, sf):
    c = table(spark, sf, "customer").withColumn("bucket", F.floor(F.col("c_acctbal") / 10))
    links = c.select(F.col("c_custkey").alias("seq"), F.concat_ws("|", "c_nationkey", "bucket").alias("key")).unionByName(
        c.select(F.col("c_custkey").alias("seq"), F.concat_ws("|", "c_mktsegment", "bucket").alias("key"))
    )
    return I.group_fragments(links)


@R.query("reference_resolution", f"WITH {RESOLVED_SQL} SELECT * FROM rr")
def reference_resolution(spark, sf):
    return resolved(spark, sf)


def resolved(spark, sf):
    return RF.resolve_references(references(spark, sf), contexts(spark, sf))


BACK = f"""{RESOLVED_SQL}, bk AS (SELECT target_path AS target, source, relation FROM rr JOIN cx ON cx.path = rr.source
  WHERE status = 'CONFIRMED' AND identity_status NOT IN ('INFERRED', 'CANDIDATE'))"""


@R.query("backrefs", f"WITH {BACK} SELECT * FROM bk")
def backrefs(spark, sf):
    return RF.backrefs(resolved(spark, sf), contexts(spark, sf))


@R.query("graph_projection", f"WITH {BACK} SELECT DISTINCT source AS src, relation, target AS dst FROM bk")
def graph_projection(spark, sf):
    return RF.graph_edges(resolved(spark, sf), contexts(spark, sf))


@R.query(
    "missing_targets",
    f"WITH {RESOLVED_SQL} SELECT source, relation, target_path FROM rr WHERE status = 'CONFIRMED' AND target_path NOT IN (SELECT path FROM cx WHERE source_id <> 'src-geo')",
)
def missing_targets(spark, sf):
    kept = contexts(spark, sf).where("source_id <> 'src-geo'")  # the geography source was withdrawn
    return RF.missing_targets(resolved(spark, sf), kept).select("source", "relation", "target_path")


@R.query(
    "orphans",
    f"""WITH {RESOLVED_SQL} SELECT path FROM cx WHERE identity_status NOT IN ('INFERRED', 'CANDIDATE') AND path NOT IN
    (SELECT source FROM rr WHERE status = 'CONFIRMED' UNION SELECT target_path FROM rr WHERE status = 'CONFIRMED')""",
)
def orphans(spark, sf):
    return RF.orphans(resolved(spark, sf), contexts(spark, sf)).select("path")


@R.query(
    "cross_source",
    f"""WITH {RESOLVED_SQL}, ls AS (SELECT DISTINCT path, source_id FROM cx UNION SELECT path, 'src-geo' FROM cx WHERE identity_status = 'CANDIDATE' UNION SELECT path, 'modeling-standard:3.1' FROM cx),
    ms AS (SELECT * FROM ls WHERE source_id NOT LIKE 'modeling-standard:%')
    SELECT DISTINCT source, relation, target_path AS target FROM rr WHERE status = 'CONFIRMED' AND NOT EXISTS
    (SELECT 1 FROM ms a JOIN ms b ON a.source_id = b.source_id WHERE a.path = rr.source AND b.path = rr.target_path)""",
)
def cross_source(spark, sf):
    cx = contexts(spark, sf)
    extra = cx.where("identity_status = 'CANDIDATE'").select("path", F.lit("src-geo").alias("source_id"))
    std = cx.select("path", F.lit("modeling-standard:3.1").alias("source_id"))
    return RF.cross_source(resolved(spark, sf), cx.select("path", "source_id").unionByName(extra).unionByName(std))


@R.query(
    "association_report",
    f"""WITH {RESOLVED_SQL} SELECT relation, status, count(*) AS refs, CAST(grouping(relation, status) AS BIGINT) AS level FROM rr
    GROUP BY GROUPING SETS ((relation, status), (relation), (status), ())""",
)
def association_report(spark, sf):
    return RF.association_counts(resolved(spark, sf))


@R.query(
    "candidate_isolation",
    f"""WITH {BACK} SELECT source AS src, relation, target_path AS dst FROM rr WHERE status = 'CANDIDATE' AND target_path IS NOT NULL
    INTERSECT SELECT source, relation, target FROM bk""",
)
def candidate_isolation(spark, sf):
    refs, cx = resolved(spark, sf), contexts(spark, sf)
    return RF.candidate_leaks(refs, RF.graph_edges(refs, cx))
