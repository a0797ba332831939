"""Query API over a compiled catalogue; every call answers a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COVERAGE_RESOLVED
from ..functions import text as T
from ..operators import bundle as BU
from ..operators import coverage as C
from ..operators import elements as E
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import mentions as M
from ..operators import pages as PG
from ..operators import planning as P
from ..operators import search as S
from ..scale import cut_lineage, top_per_group
from .compile import Catalog


class Engine:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.index = catalog.index()

    # ------------------------------------------------------------------ search / read / expand / source
    def search(self, queries: DataFrame, top_k: int = 8, bundle_k: int | None = None, token_budget: int | None = None, max_per_type: int | None = None,
               intent: str | None = None, seen: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """(query_id, path, level, tokens, position): seeds, related pages, diversified order, budget.

        ``limit`` bounds the postings read for each query; without it every page that shares a word is scored.
        """
        if top_k < 1 or (bundle_k is not None and bundle_k < 1) or (token_budget is not None and token_budget < 1):
            raise ValueError("limits must be positive")
        pages = self.catalog.pages
        seeds = self.seeds(queries, top_k, limit)
        allowed = S.indexable(pages).select("path")
        pool = G.complete_bundles(seeds, self.catalog.edges, allowed, intent, top_k)
        flags = self.catalog.coverage
        names = [c for c in flags.columns if c != "path"]
        aspects = flags.select("path", F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in names])).alias("aspects"))
        info = pages.select("path", "context_type", F.length("l1").alias("l1_length")).join(aspects, "path", "left")
        info = info.withColumn("aspects", F.coalesce("aspects", F.array().cast("array<string>")))
        ready = pool.join(info, "path").withColumn("is_seed", F.col("reason") == "seed")
        order = BU.greedy_rerank(ready)
        cost = pages.select("path", "context_type", T.token_estimate(F.col("l1")).alias("l1_tokens"), T.token_estimate(F.col("l0")).alias("l0_tokens"))
        ranked = order.join(cost, "path")
        if seen is not None:
            ranked = ranked.join(seen.select("query_id", "path").withColumn("seen", F.lit(True)), ["query_id", "path"], "left")
            ranked = ranked.withColumn("seen", F.coalesce("seen", F.lit(False)))
        else:
            ranked = ranked.withColumn("seen", F.lit(False))
        return BU.budgeted_select(ranked, bundle_k or top_k * 2, token_budget, max_per_type)

    def seeds(self, queries: DataFrame, top_k: int, limit: int | None = None) -> DataFrame:
        """BM25 and exact-name channels, fused; over bounded candidates if ``limit`` is given."""
        if limit is None:
            bm = cut_lineage(S.score_all(self.index, queries))
        else:
            cands = S.fill_candidates(S.bounded_candidates(self.index, queries, limit), queries, self.catalog.pages, limit)
            bm = S.score_candidates(self.index, queries, cut_lineage(cands.select("query_id", "path")))
        named = self.mentions(queries).where("source = 'page'").select("query_id", F.col("target").alias("path")).distinct()
        exact = named.withColumn("score", F.lit(1.0))
        fused = S.fuse_many({"exact": exact, "bm25": bm}, ["query_id"], top_k)
        return fused.select("query_id", "path", "score", F.col("rank").alias("position"))

    def mentions(self, queries: DataFrame) -> DataFrame:
        pages = S.indexable(self.catalog.pages).select(
            F.explode(F.array(T.fold(F.col("name")), T.fold(F.col("canonical_id")), T.fold(F.col("path")))).alias("key"), F.lit("page").alias("source"),
            F.col("path").alias("target"), F.col("context_type").alias("kind"),
        ).where("key <> ''").distinct()
        els = E.element_keys(self.catalog.elements).join(self.catalog.elements.select("element_id", "path", "kind"), "element_id")
        els = els.select("key", F.lit("element").alias("source"), F.col("path").alias("target"), "kind").distinct()
        return M.resolve_mentions(queries, pages.unionByName(els))

    def read(self, paths: DataFrame, level: str = "L1", sections: list[str] | None = None) -> DataFrame:
        if level.upper() == "L2":
            rows = self.catalog.sections.withColumnRenamed("ctx_id", "path")
            return PG.read_sections(rows, paths, sections)
        return PG.read_page(self.catalog.pages.join(paths.select("path").distinct(), "path", "left_semi"), level)

    def expand(self, paths: DataFrame, what: list[str], top_k: int = 20, intent: str | None = None) -> dict[str, DataFrame]:
        """Requested expansions as tables keyed by path."""
        if top_k < 1:
            raise ValueError("expansion budgets must be positive")
        cat, out = self.catalog, {}
        wanted = paths.select("path").distinct()
        for name in what:
            if name in ("lineage", "impact", "related", "backrefs"):
                rows = G.related(cat.edges, cat.pages, wanted, top_k, intent, lineage=name in ("lineage", "impact"))
                out[name] = rows.where("side = 'incoming'") if name == "backrefs" else rows
            elif name in ("parents", "children"):
                own, other = ("child", "parent") if name == "parents" else ("parent", "child")
                rows = cat.org_edges.join(wanted.withColumnRenamed("path", own), own, "left_semi")
                out[name] = top_per_group(rows, [own], [F.asc("view"), F.asc(other)], top_k, "n")
            elif name == "hierarchy":
                out[name] = H.classification_status(cat.contexts.join(wanted, "path", "left_semi"), cat.org_edges)
            elif name == "conflicts":
                out[name] = cat.conflicts.join(wanted.withColumnRenamed("path", "ctx_id"), "ctx_id", "left_semi")
            elif name == "candidates":
                out[name] = cat.candidates.join(wanted.withColumnRenamed("path", "ctx_id"), "ctx_id", "left_semi")
            elif name == "business_mapping":
                out[name] = self.read(wanted, "L2", ["primary_objects", "related_objects", "object_attributes", "topic_domain", "topic"])
            elif name == "evidence":
                out[name] = self.source(wanted)
            else:
                out[name] = E.expand_sections(cat.elements, wanted, [name], top_k)
        return out

    def source(self, paths: DataFrame, section: str | None = None) -> DataFrame:
        rows = self.catalog.fragments.select(F.col("ctx_id").alias("path"), "section", "source_id", "pointer").distinct()
        return PG.read_sources(rows, paths, section)

    # ------------------------------------------------------------------ explore
    def explore(self, queries: DataFrame, token_budget: int | None = None) -> dict[str, DataFrame]:
        """Route, plan, search, assess coverage and say what is still missing, for all queries at once."""
        plan = P.plan(P.route(queries))
        hits = cut_lineage(self.search(queries, top_k=6, bundle_k=12, token_budget=token_budget))
        sections = self.catalog.sections.select(
            F.col("ctx_id").alias("path"), "section", "status", F.lit(True).alias("evidenced"), F.lit(False).alias("conflicted"), F.lit(False).alias("truncated"),
            F.lit(None).cast("string").alias("coverage_status"), F.lit(False).alias("authoritative"), F.lit(False).alias("complete"),
            F.lit(None).cast("string").alias("selector"), F.lit(None).cast("string").alias("reason"),
        ).distinct()
        facts = C.support_facts(sections, self.catalog.contexts.withColumn("evidenced", F.lit(True)))
        anchors = hits.where("position = 1").join(plan.select("query_id", F.explode(F.split("required", ",")).alias("aspect")), "query_id")
        reqs = anchors.select(
            F.concat_ws(":", F.col("query_id").cast("string"), "path", "aspect").alias("req_id"), F.col("path").alias("entity"), F.col("path").alias("entity_name"), "aspect",
            F.lit("REFERENCE").alias("layer"), F.lit(None).cast("string").alias("selector"), "query_id",
        )
        assessed = C.assess(reqs.drop("query_id"), C.proofs(reqs, facts, self.catalog.edges)).join(reqs.select("req_id", "query_id"), "req_id")
        missing = assessed.where(~F.col("status").isin(*COVERAGE_RESOLVED)).select("query_id", "aspect")
        open_count = missing.groupBy("query_id").agg(F.count("*").alias("open"))
        confidence = hits.select("query_id").distinct().join(open_count, "query_id", "left").select(
            "query_id", BU.bundle_confidence(F.coalesce("open", F.lit(0)), F.lit(0), F.lit(0), F.lit(True)).alias("confidence"),
            F.when(F.col("open").isNull(), "coverage_complete").otherwise("incomplete_after_focused_expand").alias("stop_reason"),
        )
        return {"plan": plan, "hits": hits, "coverage": assessed, "missing": missing, "expand": P.expansions(missing), "summary": confidence}
