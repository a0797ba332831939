"""Layer, domain and topic normalisation of models against the controlled catalogue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CLASSIFICATION_VERSION, CONTROLLED_LAYERS, DOMAIN_ALIASES, DOMAIN_TOPICS, LAYER_ALIASES, LAYER_APPROXIMATE, PARTIAL_DOMAINS, TOPIC_ALIASES,
)
from ..functions import text as T

_SEP = "\u001f"


def _key(value: str) -> str:
    return re.sub(r"[\s_\-:/（）()]+", "", value.strip().lower())


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _tables():
    layers, domains, topics = {}, {}, {}
    for code, aliases in LAYER_ALIASES.items():
        approx = {_key(a) for a in LAYER_APPROXIMATE.get(code, ())}
        for a in aliases:
            k = _key(a)
            layers.setdefault(k, f"{code}{_SEP}" + ("APPROXIMATE_ALIAS" if k in approx else "EXACT" if k == _key(code) else "ALIAS"))
    for layer, rows in DOMAIN_ALIASES.items():
        for name, aliases in rows.items():
            for a in (*aliases, name):
                domains.setdefault(f"{layer}{_SEP}{_key(a)}", f"{name}{_SEP}" + ("EXACT" if _key(a) == _key(name) else "ALIAS"))
            for t in DOMAIN_TOPICS.get(name, ()):
                topics.setdefault(f"{layer}{_SEP}{name}{_SEP}{_key(t)}", f"{t}{_SEP}EXACT")
            for a, t in TOPIC_ALIASES.get(name, {}).items():
                topics.setdefault(f"{layer}{_SEP}{name}{_SEP}{_key(a)}", f"{t}{_SEP}ALIAS")
    return layers, domains, topics


def classify(models: DataFrame) -> DataFrame:
    """Add layer, domain, topic (canonical), their match status, overall status and issue codes.

    ``models`` carries layer_raw, domain_raw and topic_raw. Everything is a literal-map lookup.
    """
    layers, domains, topics = _tables()
    raw = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    part = lambda c, i: F.split(c, _SEP)[i]
    df = models.withColumn("_lr", raw("layer_raw")).withColumn("_dr", raw("domain_raw")).withColumn("_tr", raw("topic_raw"))
    df = df.withColumn("_l", F.try_element_at(_map(layers), T.normalize(F.col("_lr"))))
    df = df.withColumn("layer", part(F.col("_l"), 0)).withColumn(
        "layer_status", F.when(F.col("_lr").isNull(), "MISSING").when(F.col("_l").isNull(), "UNRESOLVED").otherwise(part(F.col("_l"), 1))
    )
    controlled = F.coalesce(F.col("layer").isin(*CONTROLLED_LAYERS), F.lit(False))
    df = df.withColumn("_d", F.try_element_at(_map(domains), F.concat_ws(_SEP, "layer", T.normalize(F.col("_dr")))))
    df = df.withColumn("domain", F.when(controlled, part(F.col("_d"), 0)).otherwise(F.col("_dr"))).withColumn(
        "domain_status",
        F.when(F.col("_dr").isNull(), "MISSING").when(~controlled, "UNCONTROLLED").when(F.col("_d").isNull(), "UNRESOLVED").otherwise(part(F.col("_d"), 1)),
    )
    df = df.withColumn("_t", F.try_element_at(_map(topics), F.concat_ws(_SEP, "layer", "domain", T.normalize(F.col("_tr")))))
    df = df.withColumn("topic", F.when(controlled, part(F.col("_t"), 0)).otherwise(F.col("_tr"))).withColumn(
        "topic_status",
        F.when(F.col("_tr").isNull(), "MISSING").when(~controlled, "UNCONTROLLED").when(F.col("_t").isNull(), "UNRESOLVED").otherwise(part(F.col("_t"), 1)),
    )
    is_ = lambda c, v: F.col(c) == v
    codes = F.array_compact(F.array(
        F.when(is_("layer_status", "MISSING"), "missing_model_layer").when(is_("layer_status", "UNRESOLVED"), "unknown_model_layer"),
        F.when(controlled & is_("domain_status", "MISSING"), "missing_topic_domain").when(controlled & is_("domain_status", "UNRESOLVED"), "unknown_topic_domain"),
        F.when(controlled & is_("topic_status", "MISSING"), "missing_model_topic")
        .when(controlled & is_("topic_status", "UNRESOLVED") & F.col("domain").isin(*PARTIAL_DOMAINS), "topic_catalog_incomplete")
        .when(controlled & is_("topic_status", "UNRESOLVED") & F.col("domain").isNotNull(), "topic_not_in_domain")
        .when(controlled & is_("topic_status", "UNRESOLVED"), "topic_domain_unresolved"),
    ))
    aliased = F.greatest(*[F.col(c).isin("ALIAS", "APPROXIMATE_ALIAS") for c in ("layer_status", "domain_status", "topic_status")])
    df = df.withColumn("issues", F.array_join(codes, ",")).withColumn(
        "status", F.when(F.size(codes) > 0, "REVIEW").when(aliased, "NORMALIZED").otherwise("VALID")
    )
    return df.withColumn("taxonomy_version", F.lit(CLASSIFICATION_VERSION)).drop("_lr", "_dr", "_tr", "_l", "_d", "_t")


def formal_status(status: Column) -> Column:
    """Provenance of a formal section: aliases make it derived, unresolved text stays a candidate."""
    return F.when(status.isin("ALIAS", "APPROXIMATE_ALIAS"), "DERIVED").when(status == "UNRESOLVED", "CANDIDATE").when(status != "MISSING", "EXPLICIT")


def contains_term(text: Column, value: str) -> Column:
    """Latin terms need identifier borders; other terms match anywhere."""
    if re.fullmatch(r"[A-Za-z0-9 /_-]+", value):
        return text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(value)}(?![A-Za-z0-9_])")
    return F.contains(F.lower(text), F.lit(value.lower()))


def _longest(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Canonical name of the longest alias found in the text (first listed wins a tie)."""
    found = [
        F.when(contains_term(text, a), F.struct(F.lit(len(a)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
        for i, (name, a) in enumerate((name, a) for name, aliases in table.items() for a in aliases)
    ]
    return F.array_max(F.array_compact(F.array(*found)))["name"]


def query_scope(queries: DataFrame) -> DataFrame:
    """(query_id, layer, topic_domain, topic) named explicitly in each query."""
    text = F.col("text")
    layer = _longest(text, LAYER_ALIASES)
    df = queries.withColumn("layer", layer)
    within = {lay: {d: (*a, d) for d, a in rows.items()} for lay, rows in DOMAIN_ALIASES.items()}
    anywhere = {f"{lay}:{d}": a for lay, rows in within.items() for d, a in rows.items()}
    pick = F.when(F.col("layer") == "SDL", F.concat(F.lit("SDL:"), _longest(text, within["SDL"]))).when(
        F.col("layer") == "ODI", F.concat(F.lit("ODI:"), _longest(text, within["ODI"]))
    ).otherwise(_longest(text, anywhere))
    df = df.withColumn("_dom", pick)
    df = df.withColumn("layer", F.coalesce("layer", F.split("_dom", ":")[0])).withColumn("topic_domain", F.split("_dom", ":")[1])
    topics = {}
    for lay, rows in DOMAIN_ALIASES.items():
        for d in rows:
            for t in DOMAIN_TOPICS.get(d, ()):
                topics[f"{lay}:{d}:{t}"] = (t, *[a for a, target in TOPIC_ALIASES.get(d, {}).items() if target == t])
    by_layer = {lay: {k: v for k, v in topics.items() if k.startswith(lay + ":")} for lay in DOMAIN_ALIASES}
    hit = F.when(F.col("layer") == "SDL", _longest(text, by_layer["SDL"])).when(F.col("layer") == "ODI", _longest(text, by_layer["ODI"])).otherwise(_longest(text, topics))
    df = df.withColumn("_top", hit)
    same = F.col("topic_domain").isNull() | (F.col("topic_domain") == F.split("_top", ":")[1])
    return df.select(
        "query_id", F.coalesce("layer", F.split("_top", ":")[0]).alias("layer"), F.coalesce("topic_domain", F.split("_top", ":")[1]).alias("topic_domain"),
        F.when(same, F.split("_top", ":")[2]).alias("topic"),
    )
