"""Asset catalogue search, gateway result merging and the similarity linker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scale import salted_join
from .overlap import top_overlaps


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total


def _when(test: Column, value: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def _keys(query: str, spark, expr) -> tuple[str, list[str]]:
    """Fold one caller-given query text with the same expressions the rows use."""
    row = spark.range(1).select(expr[0](F.lit(query)).alias("k"), expr[1](F.lit(query)).alias("t")).first()
    return row["k"], list(row["t"])


def _finish(scored: DataFrame, limit: int) -> DataFrame:
    return scored.where("score > 0").orderBy(F.desc("score"), F.asc("id")).limit(min(max(limit, 1), 100))


def search_assets(assets: DataFrame, query: str, types: list[str] | None = None, domain: str | None = None, limit: int = 20) -> DataFrame:
    """Catalogue scoring: exact code 1, name .95, alias .9, partial .55, words up to .5, description .2; at most 1.

    ``assets``: (id, type, code, name, description, aliases, domain). One scan, no shuffle but the top-k.
    """
    key, words = _keys(query, assets.sparkSession, (T.catalog_key, T.catalog_tokens))
    rows = assets
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if domain:
        rows = rows.where(T.catalog_key(F.col("domain")) == T.catalog_key(F.lit(domain)))
    code, name = T.catalog_key(F.col("code")), T.catalog_key(F.col("name"))
    hay = F.lower(F.concat_ws(" ", "code", "name", "description", F.array_join("aliases", " ")))
    hits = _sum([F.contains(hay, F.lit(w)).cast("int") for w in words])
    score = _sum([
        _when(code == key, 1.0), _when(name == key, 0.95), _when(F.array_contains(F.transform("aliases", T.catalog_key), key), 0.9),
        _when(F.contains(code, F.lit(key)) | F.contains(name, F.lit(key)), 0.55), F.least(F.lit(0.5), hits / max(len(words), 1) / 2),
        _when(F.contains(T.catalog_key(F.col("description")), F.lit(key)), 0.2),
    ])
    return _finish(rows.select("id", F.round(F.least(score, F.lit(1.0)), 9).alias("score")), limit)


def search_entities(entities: DataFrame, query: str, types: list[str] | None = None, filters: dict | None = None, limit: int = 20) -> DataFrame:
    """Fact-graph scoring: partial matches work both ways, word share weighs .45.

    ``entities``: (id, type, code, name, description, aliases, properties map).
    """
    key, words = _keys(query, entities.sparkSession, (T.fact_key, T.fact_tokens))
    rows = entities
    if types:
        rows = rows.where(F.col("type").isin(*types))
    for k, v in (filters or {}).items():
        rows = rows.where(T.fact_key(F.try_element_at("properties", F.lit(k))) == T.fact_key(F.lit(v)))
    code, name = T.fact_key(F.col("code")), T.fact_key(F.col("name"))
    hay = F.lower(F.concat_ws(" ", "code", "name", "description", F.array_join("aliases", " "), F.array_join(F.map_values("properties"), " ")))
    share = _sum([F.contains(hay, F.lit(w)).cast("int") for w in words]) / max(len(words), 1)

    def near(c: Column) -> Column:
        return (F.length(c) >= 2) & (F.contains(c, F.lit(key)) | F.contains(F.lit(key), c))

    score = _sum([
        _when((code != "") & (code == key), 1.0), _when(name == key, 0.95), _when(F.array_contains(F.transform("aliases", T.fact_key), key), 0.9),
        _when(F.lit(len(key) >= 2) & (near(code) | near(name)), 0.55), F.least(F.lit(0.45), share * 0.45),
    ])
    return _finish(rows.select("id", F.least(F.round(score, 4), F.lit(1.0)).alias("score")), limit)


def gateway_score(query: str, spark) -> Column:
    """1 / .98 / .95 / .7 for code, name, alias, text; everything scores 1 for an empty query."""
    key, _ = _keys(query, spark, (T.catalog_key, T.catalog_tokens))
    if not key:
        return F.lit(1.0)
    code, name, aliases = T.catalog_key(F.col("code")), T.catalog_key(F.col("name")), F.transform("aliases", T.catalog_key)
    text = F.concat(code, name, F.array_join(aliases, ""), T.catalog_key(F.col("description")))
    return (
        F.when(code == key, 1.0).when(name == key, 0.98).when(F.array_contains(aliases, key), 0.95).when(F.contains(text, F.lit(key)), 0.7).otherwise(0.0)
    )


def merge_routes(assets: DataFrame, routes: DataFrame, max_fanout: int) -> tuple[DataFrame, DataFrame]:
    """Assets of the first ``max_fanout`` routes, one row per id (first route wins), and a one-row summary.

    ``assets``: (route, id, …); ``routes``: (route, complete, truncated). The answer is complete
    only if every used route was and none was left out.
    """
    used = routes.orderBy("route").limit(max_fanout)
    left_out = routes.agg((F.count("*") > max_fanout).alias("x")).scalar()
    rows = assets.join(used.select("route"), "route", "left_semi")
    other = [c for c in assets.columns if c not in ("route", "id")]
    merged = rows.groupBy("id").agg(F.min_by(F.struct(*other), F.col("route")).alias("a")).select("id", *[f"a.{c}" for c in other])
    summary = used.agg(
        (F.coalesce(F.bool_and("complete"), F.lit(False)) & ~left_out).alias("complete"),
        (F.coalesce(F.bool_or("truncated"), F.lit(False)) | left_out).alias("truncated"), F.count("*").alias("routes"),
    )
    return merged, summary


def capability_errors(assets: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Returned assets whose type the answering route does not offer: capabilities (route, asset_type)."""
    offered = capabilities.select("route", F.col("asset_type").alias("type")).distinct()
    return assets.join(offered, ["route", "type"], "left_anti")


def link_similar(requirements: DataFrame, models: DataFrame, top: int = 8) -> DataFrame:
    """(requirement, model, score, confidence): share of the requirement's terms a model's text holds.

    ``requirements`` / ``models``: (id, text). Best ``top`` per requirement, confidence .5 + .3 x share.
    """
    left = requirements.select("id", F.explode(T.overlap_terms(F.col("text"))).alias("key"))
    right = models.select("id", F.explode(T.overlap_terms(F.col("text"))).alias("key"))
    size = left.distinct().groupBy("id").agg(F.count("*").alias("terms"))
    best = top_overlaps(left, right, top).join(size, "id")
    score = F.col("shared") / F.col("terms")
    return best.select(
        F.col("id").alias("requirement"), F.col("other").alias("model"), F.round(score, 6).alias("score"),
        # Halves are decided on the binary value, as two-digit formatting of a double does.
        (F.floor((0.5 + F.least(score, F.lit(1.0)) * 0.3) * 100 + 0.5) / 100).alias("confidence"), "rank",
    )


def edge_evidence(edges: DataFrame, assets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with their end names and one row per piece of evidence: edges (edge_id, src, dst, refs)."""
    names = assets.select("id", "name")
    rows = edges.select("edge_id", "src", "dst", F.explode("refs").alias("evidence_id"))
    rows = salted_join(rows, evidence, ["evidence_id"], ["edge_id"])
    for end in ("src", "dst"):
        rows = salted_join(rows, names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), [end], ["edge_id", "evidence_id"])
    return rows
