"""Query understanding over a table of queries: scope, intent, policy and retrieval strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXPANSIONS, INTENT_LIMITS, INTENT_REQUIREMENTS, INTENT_VIEWS, KNOWN_TECHNOLOGY, LAYER_WORDS, STRONG_ANCHORS


def _any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def intent(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when((text.contains("模型") | low.contains("model")) & (text.contains("提供") | text.contains("哪些")), "metric_to_models")
        .when(_any(text, ("需要哪些数据", "需要什么数据")), "analysis_data_requirement")
        .when(_any(text, ("业务对象", "粒度", "字段")), "model_understanding")
        .when(text.contains("影响") & (text.contains("下游") | low.contains("impact")), "impact_analysis")
        .otherwise("generic")
    )


def symbols(text: Column) -> Column:
    """Upper-case identifiers that are not layer names."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*LAYER_WORDS))


def technology(text: Column) -> Column:
    low = F.lower(text)
    pick = F.lit(None).cast("string")
    for t in reversed(KNOWN_TECHNOLOGY):
        pick = F.when(low.contains(t.lower()), t).otherwise(pick)
    return pick


def route(queries: DataFrame) -> DataFrame:
    """(query_id, text, intent, symbol, technology, layer_asked, topic_asked)."""
    low = F.lower(F.col("text"))
    return queries.select(
        "query_id", "text", intent(F.col("text")).alias("intent"), F.try_element_at(symbols(F.col("text")), F.lit(1)).alias("symbol"),
        technology(F.col("text")).alias("technology"), low.rlike(r"(?<![a-z0-9_])(ods|sdl|odi|ads|dwd|dws)(?![a-z0-9_])").alias("layer_asked"),
        _any(low, ("主题", "domain", "topic")).alias("topic_asked"),
    )


def plan(routed: DataFrame) -> DataFrame:
    """Limits and required aspects per intent; unknown intents use the generic policy."""
    def lookup(values: dict) -> Column:
        table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
        return F.coalesce(F.try_element_at(table, F.col("intent")), values["generic"])

    req = {k: F.lit(",".join(v)) for k, v in INTENT_REQUIREMENTS.items()}
    return routed.select(
        "*", lookup(req).alias("required"), *[lookup({k: F.lit(v[i]).cast("long") for k, v in INTENT_LIMITS.items()}).alias(n)
              for i, n in enumerate(("top_k", "bundle_k", "token_budget"))]
    )


def expansions(missing: DataFrame) -> DataFrame:
    """(query_id, expand) sections to read for the aspects a bundle still lacks."""
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    rows = missing.select("query_id", F.explode(F.try_element_at(table, F.col("aspect"))).alias("expand"))
    return rows.distinct()


def strategy(routed: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, mode, views, confidence) from intent, scope words and verified anchor kinds.

    ``anchors``: (query_id, kind) of exact matches in the index.
    """
    strong = anchors.where(F.col("kind").isin(*STRONG_ANCHORS)).select("query_id").distinct().withColumn("anchored", F.lit(True))
    rows = routed.join(strong, "query_id", "left").withColumn("anchored", F.coalesce("anchored", F.lit(False)))
    low = F.lower(F.col("text"))
    cross = _any(low, ("还需要", "还能", "跨域", "结合", "what else", "across domains", "additional data"))
    asset = low.rlike(r"\b(ods|sdl|odi|ads|dwd|dws)\b") | _any(low, ("数仓", "分层"))
    by_intent = F.try_element_at(F.create_map(*[F.lit(x) for kv in INTENT_VIEWS.items() for x in kv]), F.col("intent"))
    first = (
        F.when(asset, "asset").when(by_intent.isNotNull(), by_intent)
        .when(_any(low, ("主题", "业务对象", "domain", "topic", "网络资源配置", "归到")), "domain")
        .when(_any(low, ("资产", "模型清单", "asset inventory")), "asset").otherwise("analysis")
    )
    lead = F.when(cross & _any(low, ("分析", "覆盖", "场景", "指标")), F.array(F.lit("analysis"), first)).otherwise(F.array(first))
    mode = F.when(F.col("anchored") & cross, "hybrid").when(F.col("anchored"), "direct").otherwise("hierarchical")
    views = F.when(mode == "direct", F.lit("")).otherwise(F.array_join(F.slice(F.array_distinct(lead), 1, 2), ","))
    confidence = F.when(F.col("anchored"), 0.99).when(by_intent.isNotNull(), 0.95).otherwise(0.75)
    return rows.select("query_id", mode.alias("mode"), views.alias("views"), confidence.alias("confidence"))
