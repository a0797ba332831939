"""Multi-view organisation: edge derivation, arbitration, closure, status, checks, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import (
    BRANCH_PREVIEW, EDGE_STATUS_RANK, IMPORTANT_ELEMENT_LIMIT, MODEL_TYPES, RELATION_VIEWS, SECTION_VIEWS, SUMMARY_TOP,
    TAXONOMY_TRANSITIONS, TRUSTED, VIEWS,
)
from ..functions import text as T
from ..scale import cut_lineage, salted_join, top_per_group

EDGE = ["view", "parent", "child"]


def view_path(view: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("data://views"), view, kind, T.percent_encode(name))


def edge_id() -> Column:
    """Stable id of (view, parent, child, status, method, rule)."""
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("view", "parent", "child", "status", "method")]
    rule = F.coalesce(F.concat(F.lit('"'), F.col("rule_id"), F.lit('"')), F.lit("null"))
    return F.concat(F.lit("he-"), T.short_hash(F.concat(F.lit("["), F.concat_ws(", ", *quoted, rule), F.lit("]"))))


def status_rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EDGE_STATUS_RANK.items() for x in kv]), status), F.lit(0))


def applicable(view: Column, kind: Column) -> Column:
    test = F.lit(False)
    for v, kinds in VIEWS.items():
        test = test | ((view == v) & kind.isin(*kinds))
    return test


# ----------------------------------------------------------------------------- edge derivation
def reference_edges(refs: DataFrame, contexts: DataFrame) -> DataFrame:
    """View edges from confirmed typed references (lineage between models is not containment)."""
    table = F.array(
        *[
            F.struct(F.lit(rel).alias("rel"), F.lit(view).alias("view"), F.lit(direction).alias("direction"))
            for rel, rows in RELATION_VIEWS.items()
            for view, direction in rows
        ]
    )
    kinds = contexts.select("path", F.col("context_type").alias("kind"))
    rows = refs.where((F.col("status") == "CONFIRMED") & F.col("target_path").isNotNull())
    rows = rows.where(F.col("relation").isin(*RELATION_VIEWS))
    rows = salted_join(rows, kinds.select(F.col("path").alias("source"), F.col("kind").alias("source_kind")), ["source"], ["target_path"])
    rows = salted_join(rows, kinds.select(F.col("path").alias("target_path"), F.col("kind").alias("target_kind")), ["target_path"], ["source"])
    rows = rows.where(~((F.col("relation") == "uses_model") & F.col("source_kind").isin(*MODEL_TYPES)))
    rows = rows.withColumn("d", F.explode(F.filter(table, lambda d: d["rel"] == F.col("relation"))))
    part_view = F.when(F.col("source_kind").isin("scenario", "analysis-purpose"), "analysis").otherwise("domain")
    rows = rows.where((F.col("relation") != "part_of") | (F.col("d.view") == part_view))
    swap = F.col("relation").isin("uses_metric", "requires_metric", "uses_dimension", "requires_dimension") & F.col("source_kind").isin(*MODEL_TYPES)
    forward = (F.col("d.direction") == "forward") != swap
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    edges = rows.select(
        F.col("d.view").alias("view"), pick("source", "target_path").alias("parent"), pick("target_path", "source").alias("child"),
        pick("source_kind", "target_kind").alias("parent_kind"), pick("target_kind", "source_kind").alias("child_kind"),
        F.lit("CONFIRMED").alias("status"), F.lit("explicit").alias("method"), F.lit(None).cast("string").alias("rule_id"),
        F.lit(1.0).alias("confidence"), F.col("source").alias("owner"), F.col("relation").alias("source_relation"),
    )
    return accepted(edges)


def accepted(edges: DataFrame) -> DataFrame:
    """Edges whose ends differ and belong to the view; the rest is reported by ``rejected``."""
    fits = applicable(F.col("view"), F.col("parent_kind")) & applicable(F.col("view"), F.col("child_kind"))
    return edges.where((F.col("parent") != F.col("child")) & fits)


def rejected(edges: DataFrame) -> DataFrame:
    fits = applicable(F.col("view"), F.col("parent_kind")) & applicable(F.col("view"), F.col("child_kind"))
    return edges.where((F.col("parent") != F.col("child")) & ~fits).withColumn("code", F.lit("entity_placed_in_non_applicable_view"))


def section_labels(sections: DataFrame) -> DataFrame:
    """Ordered governed labels: (owner, view, step, kind, label, status) from (ctx_id, section, label, status)."""
    table = F.array(
        *[
            F.struct(F.lit(sec).alias("sec"), F.lit(view).alias("view"), F.lit(i).alias("step"), F.lit(kind).alias("kind"))
            for view, rows in SECTION_VIEWS.items()
            for i, (sec, kind) in enumerate(rows)
        ]
    )
    rows = sections.where(F.col("status").isin(*TRUSTED))
    rows = rows.withColumn("d", F.explode(F.filter(table, lambda d: d["sec"] == F.col("section"))))
    return rows.select(
        F.col("ctx_id").alias("owner"), F.col("d.view").alias("view"), F.col("d.step").alias("step"), F.col("d.kind").alias("kind"), "label", "status"
    )


def resolve_nodes(labels: DataFrame, contexts: DataFrame, governed: DataFrame | None = None) -> DataFrame:
    """Label -> node: governed taxonomy label, else the one context of that kind and name, else virtual.

    Names held by several contexts give no node (``ambiguous`` is true).
    """
    names = contexts.select(F.col("context_type").alias("kind"), T.fold(F.col("name")).alias("key"), "path")
    if "aliases" in contexts.columns:
        more = contexts.select(F.col("context_type").alias("kind"), F.explode("aliases").alias("a"), "path")
        names = names.unionByName(more.select("kind", T.fold(F.col("a")).alias("key"), "path"))
    owners = names.groupBy("kind", "key").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    keyed = labels.withColumn("key", T.fold(F.col("label")))
    rows = salted_join(keyed, owners, ["kind", "key"], ["owner"], how="left")
    if governed is not None:
        gov = governed.select("view", "kind", T.fold(F.col("label")).alias("key"), F.col("path").alias("gov")).dropDuplicates(["view", "kind", "key"])
        rows = salted_join(rows, gov, ["view", "kind", "key"], ["owner"], how="left")
    else:
        rows = rows.withColumn("gov", F.lit(None).cast("string"))
    ambiguous = F.col("gov").isNull() & F.col("lo").isNotNull() & (F.col("lo") != F.col("hi"))
    node = F.coalesce("gov", F.when(F.col("lo") == F.col("hi"), F.col("lo")), view_path(F.col("view"), F.col("kind"), F.col("label")))
    return rows.select(*labels.columns, F.when(~ambiguous, node).alias("node"), ambiguous.alias("ambiguous"))


def section_edges(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Placement edges from resolved section labels; analysis order decides which end is parent."""
    order = {k: i for i, k in enumerate(VIEWS["analysis"])}
    pos = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    kinds = contexts.select(F.col("path").alias("owner"), F.col("context_type").alias("owner_kind"))
    rows = nodes.where(F.col("node").isNotNull() & (F.col("node") != F.col("owner")))
    rows = salted_join(rows, kinds, ["owner"], ["node"]).where(applicable(F.col("view"), F.col("owner_kind")))
    flip = (F.col("view") == "analysis") & (F.try_element_at(pos, F.col("owner_kind")) < F.try_element_at(pos, F.col("kind")))
    pick = lambda a, b: F.when(flip, F.col(a)).otherwise(F.col(b))
    explicit = F.col("status") == "EXPLICIT"
    return rows.select(
        "view", pick("owner", "node").alias("parent"), pick("node", "owner").alias("child"),
        pick("owner_kind", "kind").alias("parent_kind"), pick("kind", "owner_kind").alias("child_kind"),
        F.when(explicit, "CONFIRMED").otherwise("DERIVED").alias("status"), F.when(explicit, "explicit").otherwise("domain_rule").alias("method"),
        F.when(~explicit, "governed-section-projection").alias("rule_id"), F.lit(1.0).alias("confidence"), "owner",
        F.concat(F.lit("section:"), "kind").alias("source_relation"),
    )


def supported_pairs(refs: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """(view, parent, child) pairs backed by a confirmed reference or an explicit taxonomy edge."""
    rows = refs.where((F.col("status") == "CONFIRMED") & F.col("target_path").isNotNull())
    pairs = None
    for relation, views in RELATION_VIEWS.items():
        for view, direction in views:
            a, b = ("source", "target_path") if direction == "forward" else ("target_path", "source")
            part = rows.where(F.col("relation") == relation).select(F.lit(view).alias("view"), F.col(a).alias("parent"), F.col(b).alias("child"))
            pairs = part if pairs is None else pairs.unionByName(part)
    if taxonomy is not None:
        pairs = pairs.unionByName(taxonomy.select(*EDGE))
    return pairs.distinct()


def co_classification(nodes: DataFrame, supported: DataFrame) -> DataFrame:
    """Edges between consecutive label levels of one context.

    When both levels hold several labels (M x N) a pair is kept only if other evidence supports
    it. The unsupported product is never built: supported pairs are found by an equi-join of
    labels with the support table, and only 1 x N or N x 1 levels are crossed.
    """
    placed = nodes.where(F.col("node").isNotNull() & (F.col("node") != F.col("owner"))).select("owner", "view", "step", "kind", "node").distinct()
    levels = placed.groupBy("owner", "view", "step", "kind").agg(F.count("*").alias("size"), F.min("node").alias("only"))
    w = Window.partitionBy("owner", "view").orderBy("step")  # a handful of levels per context
    for c in ("step", "kind", "size", "only"):
        levels = levels.withColumn(f"prev_{c}", F.lag(c).over(w))
    levels = levels.where("prev_step IS NOT NULL")
    levels = levels.where(~((F.col("view") == "analysis") & F.col("prev_kind").isin("metric", "dimension") & F.col("kind").isin("metric", "dimension")))
    narrow = levels.where((F.col("size") == 1) | (F.col("prev_size") == 1))
    one_parent = narrow.where("prev_size = 1").select("owner", "view", "step", F.col("prev_only").alias("parent"), "prev_size", "size")
    downs = one_parent.join(placed.select("owner", "view", "step", F.col("node").alias("child")), ["owner", "view", "step"])
    one_child = narrow.where("size = 1 AND prev_size > 1").select(
        "owner", "view", F.col("prev_step").alias("step"), F.col("only").alias("child"), "prev_size", "size"
    )
    ups = one_child.join(placed.select("owner", "view", "step", F.col("node").alias("parent")), ["owner", "view", "step"])
    wide = levels.where("size > 1 AND prev_size > 1")
    parents = wide.join(
        placed.select("owner", "view", F.col("step").alias("prev_step"), F.col("node").alias("parent")), ["owner", "view", "prev_step"]
    )
    backed = salted_join(parents, supported, ["view", "parent"], ["owner"])
    crossed = backed.join(placed.select("owner", "view", "step", F.col("node").alias("child")), ["owner", "view", "step", "child"])
    cols = ["owner", "view", "parent", "child", "prev_size", "size"]
    rows = downs.select(*cols).unionByName(ups.select(*cols)).unionByName(crossed.select(*cols)).where("parent <> child")
    return rows.select(
        "owner", *EDGE, F.lit("DERIVED").alias("status"), F.lit(0.95).alias("confidence"),
        F.col("prev_size").cast("long").alias("parent_cardinality"), F.col("size").cast("long").alias("child_cardinality"),
    )


def element_edges(fields: DataFrame, limit: int = IMPORTANT_ELEMENT_LIMIT) -> DataFrame:
    """First ``limit`` important fields of each physical model as element nodes: (canonical_id, path, position, field)."""
    rows = fields.where(F.col("position") < limit)
    child = F.concat_ws("/", F.lit("hierarchy://elements"), F.lit("asset"), T.percent_encode(F.col("canonical_id")), T.percent_encode(F.col("field")))
    return rows.select(
        F.lit("asset").alias("view"), F.col("path").alias("parent"), child.alias("child"), F.lit("physical-model").alias("parent_kind"),
        F.lit("element").alias("child_kind"), F.lit("DERIVED").alias("status"), F.lit("domain_rule").alias("method"),
        F.lit("important-element-projection/v1").alias("rule_id"), F.lit(1.0).alias("confidence"), F.col("path").alias("owner"),
        F.lit("important_fields").alias("source_relation"),
    )


def tag_edges(tags: DataFrame, mappings: DataFrame) -> DataFrame:
    """Plain tags mapped by rule (DERIVED .95): tags (path, tag), mappings (tag, view, kind, label, rule_id)."""
    rows = salted_join(tags, mappings, ["tag"], ["path"])
    return rows.select(
        "view", view_path(F.col("view"), F.col("kind"), F.col("label")).alias("parent"), F.col("path").alias("child"),
        F.col("kind").alias("parent_kind"), F.lit("DERIVED").alias("status"), F.lit("domain_rule").alias("method"), "rule_id", F.lit(0.95).alias("confidence"),
    )


# ----------------------------------------------------------------------------- merge and arbitration
def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id with its number of owners (owners stay rows in the input)."""
    keyed = edges.withColumn("edge_id", edge_id())
    return keyed.groupBy("edge_id", *EDGE, "parent_kind", "child_kind", "status", "method", "rule_id").agg(
        F.max("confidence").alias("confidence"), F.count_distinct("owner").alias("owners")
    )


def arbitrate(edges: DataFrame) -> DataFrame:
    """Mark the active edges per (view, child, parent kind): best status, explicit taxonomy first.

    The best priority is an aggregate joined back, so a child with very many placements is
    not sorted in one task. Candidate edges are never active.
    """
    slot = ["view", "child", "parent_kind"]
    priority = F.struct((F.col("method") == "explicit_taxonomy").alias("t"), status_rank(F.col("status")).alias("s"))
    ranked = edges.withColumn("priority", priority)
    best = ranked.groupBy(*slot).agg(
        F.max("priority").alias("best"), F.min("parent").alias("lo"), F.max("parent").alias("hi"),
        F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"),
    )
    joined = salted_join(ranked, best, slot, ["parent"])
    return joined.select(
        *edges.columns,
        ((F.col("status") != "CANDIDATE") & (F.col("priority") == F.col("best"))).alias("active"),
        F.when(F.col("lo") != F.col("hi"), F.when(F.col("confirmed") > 1, "conflicting_confirmed_placement").otherwise("placement_conflict")).alias("conflict"),
    )


# ----------------------------------------------------------------------------- closure and navigation
def closure(edges: DataFrame) -> DataFrame:
    """(view, ancestor, node, depth) over active edges; each pair once, with its least depth, for hierarchies of any depth.

    The reach doubles each round: a pair further apart than the reach passes a node exactly
    one reach below its ancestor, so only pairs of that depth meet the known ones, and of these
    only those whose lower end has something below it: leaves, most of the nodes, are not
    shuffled to meet nothing. Known pairs are dropped, so cycles end the loop.
    """
    base = edges.where("active AND parent <> child").select("view", F.col("parent").alias("ancestor"), F.col("child").alias("node")).distinct()
    known, reach = cut_lineage(base.withColumn("depth", F.lit(1).cast("long"))), 1
    inner = cut_lineage(known.select("view", "ancestor").distinct())
    found = known
    while True:
        far = found.where(F.col("depth") == reach).select("view", F.col("ancestor").alias("top"), F.col("node").alias("ancestor"))
        far = cut_lineage(salted_join(far, inner, ["view", "ancestor"], ["top"], how="left_semi"))
        if far.isEmpty():
            return known
        step = salted_join(known, far, ["view", "ancestor"], ["node"]).where("top <> node")
        new = step.groupBy("view", F.col("top").alias("ancestor"), "node").agg((F.min("depth") + reach).alias("depth"))
        found = cut_lineage(new.join(known.select("view", "ancestor", "node"), ["view", "ancestor", "node"], "left_anti"))
        if found.isEmpty():
            return known
        known, reach = known.unionByName(found), reach * 2


def breadcrumbs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(view, node, trail, depth): names from the top down, following one best parent per step.

    Virtual parents are preferred, then the smaller path. Trails climb until they end or meet
    themselves, however deep the hierarchy is.
    """
    virtual = nodes.select(F.col("path").alias("parent"), "virtual")
    active = edges.where("active").select(*EDGE)
    best = cut_lineage(
        salted_join(active, virtual, ["parent"], ["child"])
        .groupBy("view", "child").agg(F.min(F.struct(~F.col("virtual"), "parent")).alias("b"))
        .select("view", "child", F.col("b.parent").alias("parent"))
    )
    names = nodes.select("path", "name")
    trail = best.select("view", F.col("child").alias("node")).union(best.select("view", "parent")).distinct()
    trail = trail.join(names.withColumnRenamed("path", "node"), "node").select(
        "view", "node", F.col("node").alias("at"), F.array("name").alias("trail"), F.array("node").alias("seen")
    )
    trail = cut_lineage(trail)
    finished = None
    while True:
        up = best.select("view", F.col("child").alias("at"), "parent")
        step = salted_join(trail, up, ["view", "at"], ["node"], how="left")
        stop = F.col("parent").isNull() | F.array_contains("seen", F.col("parent"))
        step = cut_lineage(step.withColumn("stop", F.coalesce(stop, F.lit(True))))
        ended = step.where("stop").select("view", "node", "trail")
        finished = ended if finished is None else finished.unionByName(ended)
        moving = step.where("NOT stop")
        trail = salted_join(moving, names.select(F.col("path").alias("parent"), F.col("name").alias("up_name")), ["parent"], ["node"]).select(
            "view", "node", F.col("parent").alias("at"), F.concat(F.array("up_name"), "trail").alias("trail"), F.concat("seen", F.array("parent")).alias("seen")
        )
        if moving.limit(1).count() == 0:
            break
    return finished.select("view", "node", F.array_join("trail", " > ").alias("trail"), F.size("trail").cast("long").alias("depth"))


def classification_status(contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """classified / partially_classified / unclassified per context with the views it is missing."""
    placed = edges.where("active AND status IN ('CONFIRMED', 'DERIVED')").select("view", F.col("child").alias("path")).distinct()
    per = placed.groupBy("path").agg(F.array_sort(F.collect_set("view")).alias("placed"))  # at most three views
    views = F.array_compact(F.array(*[F.when(F.col("context_type").isin(*kinds), F.lit(v)) for v, kinds in VIEWS.items()]))
    rows = contexts.select("path", "context_type", views.alias("applicable")).join(per, "path", "left")
    have = F.array_intersect("applicable", F.coalesce("placed", F.array().cast("array<string>")))
    missing = F.array_except("applicable", have)
    status = (
        F.when((F.size("applicable") > 0) & (F.size(missing) == 0), "classified")
        .when(F.size(have) > 0, "partially_classified").otherwise("unclassified")
    )
    return rows.select("path", status.alias("status"), F.array_join(F.array_sort(missing), ",").alias("missing_views"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes left after stripping, round by round, all nodes without parents: they lie on or under a cycle.

    Candidate edges count too. Each round takes away at least one edge or is the last.
    """
    left = cut_lineage(edges.select(*EDGE).where("parent <> child").distinct())
    while True:
        held = left.select("view", F.col("child").alias("parent")).distinct()
        kept = cut_lineage(left.join(held, ["view", "parent"], "left_semi"))
        if left.join(kept, ["view", "parent", "child"], "left_anti").isEmpty():
            return kept.select("view", F.col("child").alias("node")).distinct()
        left = kept


def integrity_issues(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, subject) rows of broken edges; empty means the organisation is sound."""
    known = nodes.select("path")
    ends = edges.select(F.col("parent").alias("path"), "edge_id").unionByName(edges.select(F.col("child").alias("path"), "edge_id"))
    checks = [
        ends.join(known, "path", "left_anti").select(F.lit("broken_parent_reference").alias("code"), F.col("edge_id").alias("subject")).distinct(),
        edges.where(~F.col("view").isin(*VIEWS)).select(F.lit("invalid_hierarchy_type"), "edge_id"),
        edges.where(~F.col("status").isin(*EDGE_STATUS_RANK)).select(F.lit("invalid_hierarchy_status"), "edge_id"),
        edges.where("confidence IS NULL OR confidence < 0 OR confidence > 1").select(F.lit("confidence_out_of_range"), "edge_id"),
        edges.where("status = 'CANDIDATE' AND active").select(F.lit("candidate_as_classified"), "edge_id"),
        edges.where("status = 'CONFIRMED' AND method NOT IN ('explicit', 'explicit_taxonomy')").select(F.lit("candidate_promoted_without_policy"), "edge_id"),
        edges.where("status = 'DERIVED' AND (method <> 'domain_rule' OR rule_id IS NULL)").select(F.lit("missing_rule_inputs"), "edge_id"),
        edges.where(~(applicable(F.col("view"), F.col("parent_kind")) & applicable(F.col("view"), F.col("child_kind")))).select(
            F.lit("entity_placed_in_non_applicable_view"), "edge_id"
        ),
        edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_edge"), "edge_id"),
        edges.where("conflict IS NOT NULL").select(F.col("conflict"), "edge_id"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def transition_errors(edges: DataFrame) -> DataFrame:
    """Explicit taxonomy edges whose parent and child kinds may not follow each other."""
    allowed = F.lit(False)
    for view, rows in TAXONOMY_TRANSITIONS.items():
        for parent, children in rows.items():
            allowed = allowed | ((F.col("view") == view) & (F.col("parent_kind") == parent) & F.col("child_kind").isin(*children))
    return edges.where(~allowed)


# ----------------------------------------------------------------------------- aggregates
def members(closed: DataFrame, contexts: DataFrame) -> DataFrame:
    """(view, branch, path, context_type): contexts below each branch node."""
    rows = closed.select("view", F.col("ancestor").alias("branch"), F.col("node").alias("path"))
    return rows.join(contexts.select("path", "context_type"), "path")


def branch_summary(closed: DataFrame, contexts: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per branch: member and model counts, placement counts by status, share of supported placements.

    ``only`` (view, branch) restricts the result to some branches.
    """
    if only is not None:
        closed = closed.join(only.withColumnRenamed("branch", "ancestor"), ["view", "ancestor"], "left_semi")
    rows = members(closed, contexts).groupBy("view", "branch").agg(
        F.count("*").alias("member_count"),
        F.count_if(F.col("context_type") == "logical-model").alias("logical_models"),
        F.count_if(F.col("context_type") == "physical-model").alias("physical_models"),
    )
    # An edge belongs to a branch when its parent is the branch or below it.
    own = edges.select("view", F.col("parent").alias("branch"), "status")
    # Edge statuses are counted per parent before they are spread over the parent's ancestors.
    per_parent = edges.groupBy("view", "parent", "status").agg(F.count("*").alias("n"))
    below = salted_join(
        per_parent, closed.select("view", F.col("ancestor").alias("branch"), F.col("node").alias("parent")), ["view", "parent"], ["status"]
    ).select("view", "branch", "status", "n")
    counts = own.groupBy("view", "branch", "status").agg(F.count("*").alias("n")).unionByName(below)
    total = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s.lower())
    counts = counts.groupBy("view", "branch").agg(total("CONFIRMED"), total("DERIVED"), total("CANDIDATE"))
    supported = F.col("confirmed") + F.col("derived")
    quality = supported / F.greatest(F.lit(1), supported + F.col("candidate"))
    return rows.join(counts, ["view", "branch"], "left").withColumn("quality", F.round(quality, 6))


def branch_top_values(closed: DataFrame, values: DataFrame, top: int = SUMMARY_TOP) -> DataFrame:
    """Most frequent section values per branch, counted once per member: values (path, section, value)."""
    once = values.select("path", "section", "value").distinct()
    rows = salted_join(once, closed.select("view", F.col("ancestor").alias("branch"), F.col("node").alias("path")), ["path"], ["section", "value"])
    counted = rows.groupBy("view", "branch", "section", "value").agg(F.count("*").alias("members"))
    return top_per_group(counted, ["view", "branch", "section"], [F.desc("members"), F.asc("value")], top)


def branch_preview(closed: DataFrame, contexts: DataFrame, limit: int = BRANCH_PREVIEW) -> DataFrame:
    """First members of each branch in path order (fallback reading list)."""
    return top_per_group(members(closed, contexts), ["view", "branch"], [F.asc("path")], limit, "position")


def resolve_legacy(path: Column) -> Column:
    """Old model addresses: one part is a layer, two a topic domain, three a topic."""
    rest = F.split(F.substring_index(path, "hierarchy://models/", -1), "/")
    old = path.startswith("hierarchy://models/")
    to = lambda view, kind, i: F.concat(F.lit(f"data://views/{view}/{kind}/"), F.get(rest, F.lit(i)))
    return (
        F.when(old & (F.size(rest) == 1), to("asset", "layer", 0)).when(old & (F.size(rest) == 2), to("domain", "topic-domain", 1))
        .when(old & (F.size(rest) == 3), to("domain", "topic", 2)).otherwise(path)
    )
