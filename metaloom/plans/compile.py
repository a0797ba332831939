"""Build pipeline: fragments -> contexts, sections, references, organisation, pages, index tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LIST_SECTIONS
from ..functions import text as T
from ..operators import classification as CL
from ..operators import elements as E
from ..operators import fusion as FU
from ..operators import hierarchy as H
from ..operators import identity as I
from ..operators import mapping as MP
from ..operators import pages as PG
from ..operators import quality as Q
from ..operators import references as RF
from ..operators import search as S
from ..scale import cut_lineage, salted_join
from ..sources import templates as TP


@dataclass
class Catalog:
    """Compiled tables; every member is a DataFrame keyed by context path."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def index(self, materialize: bool = True) -> S.PageIndex:
        return S.build_index(self.pages, materialize)


def compile_templates(spark: SparkSession, root: str) -> Catalog:
    return compile_fragments(TP.load_all(spark, root))


def compile_fragments(fragments: DataFrame) -> Catalog:
    """Compile fragment rows in delivery order.

    ``fragments``: the columns of :data:`metaloom.sources.templates.COLUMNS` with fragment_id.
    Identity grouping joins fragments of one kind that share a normalised name. Order within the
    delivery is (source, pointer, section, position).
    """
    from ..scale import global_rank

    ordered = fragments.withColumn("g", F.lit(0))
    ordered = global_rank(ordered, ["g"], [F.asc("source_id"), F.asc("pointer"), F.asc("section"), F.asc("position"), F.asc("value"), F.asc("relation")], "seq").drop("g")
    ordered = cut_lineage(ordered.withColumn("key", F.concat_ws(":", "context_type", T.normalize(F.col("name")))))

    # identity: the key alone decides here, so one aggregation is the whole grouping
    groups = ordered.groupBy("key").agg(F.min("seq").alias("group"), F.min_by("name", "seq").alias("name"), F.min_by("context_type", "seq").alias("context_type"))
    ids = cut_lineage(I.canonical_ids(groups.select("group", "context_type", "name")).join(groups.select("group", "key"), "group"))
    frags = salted_join(ordered, ids.select("key", "canonical_id", F.col("path").alias("ctx_id")), ["key"], ["seq"])
    contexts = ids.select("path", "canonical_id", "context_type", "name", F.lit("EXPLICIT").alias("identity_status"), F.array().cast("array<string>").alias("aliases"))

    # sections
    rows = frags.where("section NOT IN ('identity', 'references')").select("ctx_id", "section", "seq", "value", "source_type", "status", "position")
    lists = salted_join(FU.fuse_lists(rows), FU.combined_status(rows), ["ctx_id", "section"], ["first_seq"])
    lists = lists.select("ctx_id", "section", "value", F.col("first_seq").alias("position"), "status")
    scalar_rows = rows.where(~F.col("section").isin(*LIST_SECTIONS))
    states = FU.scalar_states(scalar_rows)
    scalars = FU.fuse_scalars(states).select("ctx_id", "section", "value", F.lit(0).cast("long").alias("position"), "status")
    conflicts = FU.scalar_conflicts(scalar_rows, states)
    sections = cut_lineage(lists.unionByName(scalars))

    # classification of models
    raw = sections.where("section IN ('classification.layer_raw', 'classification.topic_domain_raw', 'classification.topic_raw')")
    wide = raw.groupBy("ctx_id").agg(
        *[F.max(F.when(F.col("section") == f"classification.{a}_raw", F.col("value"))).alias(b) for a, b in
          (("layer", "layer_raw"), ("topic_domain", "domain_raw"), ("topic", "topic_raw"))]
    )
    classified = CL.classify(wide)
    formal = classified.select("ctx_id", F.explode(F.array(*[
        F.struct(F.lit(sec).alias("section"), F.col(c).alias("value"), CL.formal_status(F.col(f"{c}_status")).alias("status"))
        for sec, c in (("classification.layer", "layer"), ("topic_domain", "domain"), ("topic", "topic"))])).alias("f")).select("ctx_id", "f.*")
    formal = formal.where("value IS NOT NULL AND status <> 'CANDIDATE'").withColumn("position", F.lit(0).cast("long"))
    sections = sections.join(formal.select("ctx_id", "section"), ["ctx_id", "section"], "left_anti").unionByName(formal)

    # references
    refs = frags.where("section = 'references'").select(F.col("ctx_id").alias("source"), "relation", F.col("value").alias("raw_target"), "target_type", F.lit("UNRESOLVED").alias("status"))
    objects = sections.where("section IN ('primary_objects', 'related_objects')").select(F.col("ctx_id").alias("path"), "section", "value", "status")
    refs = refs.distinct()
    refs = refs.unionByName(MP.object_references(objects, refs).drop("confidence"))
    refs = cut_lineage(RF.resolve_references(refs, contexts))
    edges = RF.graph_edges(refs, contexts, sections.where("section LIKE 'lineage.%'").select(F.col("ctx_id").alias("path"), "section", "value"))

    # organisation
    labels = sections.select("ctx_id", "section", F.col("value").alias("label"), "status")
    nodes = H.resolve_nodes(H.section_labels(labels), contexts)
    placed = H.reference_edges(refs, contexts).unionByName(H.section_edges(nodes, contexts))
    org = cut_lineage(H.arbitrate(H.merge_edges(placed)))
    virtual = nodes.where("node LIKE 'data://views/%'").select(F.col("node").alias("path"), F.col("label").alias("name"), F.col("kind").alias("context_type"), F.lit(True).alias("virtual"))
    org_nodes = contexts.select("path", "name", "context_type", F.lit(False).alias("virtual")).unionByName(virtual.dropDuplicates(["path"]))
    trails = H.breadcrumbs(org, org_nodes)
    statuses = org.where("active").groupBy("view", F.col("child").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("status")), "/").alias("statuses"))
    shown = trails.where("depth > 1").join(statuses, ["view", "node"]).select(F.col("node").alias("path"), "view", "statuses", "trail")

    # pages
    lines = PG.render_members(sections.where(F.col("section").isin(*LIST_SECTIONS)).select(F.col("ctx_id").alias("path"), "section", "position", "value"))
    singles = sections.where(~F.col("section").isin(*LIST_SECTIONS)).select(F.col("ctx_id").alias("path"), "section", F.col("value").alias("rendered"))
    confirmed = RF.confirmed(refs).select(F.col("source").alias("path"), "relation", "target_path")
    pages = PG.render_pages(contexts, lines.unionByName(singles), confirmed, shown)
    pages = pages.join(contexts.select("path", "canonical_id", "identity_status"), "path")
    for facet in ("layer", "topic_domain", "topic"):
        pages = pages.withColumnRenamed(f"facet_{facet}", facet)
    flags = MP.coverage_flags(contexts, sections.select(F.col("ctx_id").alias("path"), "section").distinct())
    members = sections.select(
        F.col("ctx_id").alias("path"), F.lit("EXPLICIT").alias("identity_status"), "section", (F.col("position")).alias("offset"), "value", "status", F.col("value").startswith("{").alias("is_json")
    )
    evidenced = sections.select(F.col("ctx_id").alias("path"), "section").distinct().withColumn("evidenced", F.lit(True))
    issues = Q.quality_issues(contexts, refs, evidenced)
    return Catalog({
        "fragments": frags, "contexts": contexts, "sections": sections, "conflicts": conflicts, "references": refs, "edges": edges, "org_edges": org,
        "org_nodes": org_nodes, "pages": cut_lineage(pages), "coverage": flags, "elements": E.build_elements(members), "issues": issues,
        "classification": classified, "candidates": FU.candidate_sections(rows),
    })
