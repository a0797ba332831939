"""Document elements: sheet regions and headers, heading sections, HTML parts, table rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scale import carry_forward, global_rank, salted_join, top_per_group

# Column headings per role, in the order they are tried.
ROLE_ALIASES = {
    "model": ("model", "model name", "table", "table name", "模型", "模型名称", "表", "表名"),
    "field": ("field", "field name", "column", "column name", "字段", "字段名"),
    "description": ("description", "desc", "说明", "描述", "定义", "模型描述", "字段描述"),
    "layer": ("layer", "分层", "模型层级"),
    "topic_domain": ("topic domain", "domain", "主题域", "数据域"),
    "topic": ("topic", "subject", "主题", "业务主题"),
    "metric": ("metric", "metric name", "kpi", "kqi", "指标", "指标名称"),
    "formula": ("formula", "calculation", "公式", "计算公式", "计算逻辑"),
    "dimension": ("dimension", "dimensions", "维度"),
    "purpose": ("purpose", "analysis purpose", "分析目的", "分析项", "分析能力"),
    "scenario": ("scenario", "use case", "场景", "业务场景"),
    "source": ("source", "data source", "source table", "数据源", "源表", "来源"),
    "grain": ("grain", "粒度", "统计粒度"),
    "object": ("business object", "object", "业务对象"),
    "attribute": ("attribute", "object attribute", "对象属性", "属性"),
}
# Fixed values: (name, source types, context type, name role, role -> section, role -> (relation, target type)).
PROFILES = (
    ("asset_model", ("asset_catalog", "asset_catalogs", "data_dictionary", "data_dictionaries"), "physical-model", "model",
     {"description": "summary", "layer": "classification.layer", "topic_domain": "topic_domain", "topic": "topic", "grain": "grain"}, {}),
    ("metric", ("kpi_definition", "kpi_kqi", "kpi", "metrics", "modeling_documents", "presales_usecases"), "metric", "metric",
     {"description": "summary", "formula": "formula", "dimension": "dimensions", "topic": "topic"}, {"source": ("supported_by", "physical-model")}),
    ("purpose", ("presales_usecases", "application_documents", "modeling_documents"), "analysis-purpose", "purpose",
     {"description": "summary", "scenario": "scenarios", "metric": "metrics", "dimension": "dimensions"}, {}),
    ("business_object", ("standards", "modeling_standards", "sid"), "business-object", "object",
     {"description": "summary", "attribute": "attributes", "topic_domain": "topic_domain", "topic": "topic"}, {}),
)
SPLIT_SECTIONS = ("dimensions", "metrics", "scenarios", "attributes", "grain")


def sheet_regions(rows: DataFrame) -> DataFrame:
    """Blocks of a sheet between fully blank rows: adds ``region`` (1, 2, …) and ``start_row``.

    ``rows``: (sheet, row, cells). The last blank row above is carried forward in runs, so one
    huge sheet is not walked by one task.
    """
    blank = ~F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    marked = rows.withColumn("_blank", F.when(blank, F.col("row")))
    filled = carry_forward(marked.withColumn("_edge", F.col("_blank")), ["sheet"], "row", ["_edge"])
    body = filled.where("_blank IS NULL").withColumn("_edge", F.coalesce("_edge", F.lit(0)))
    starts = body.groupBy("sheet", "_edge").agg(F.min("row").alias("start_row"))
    numbered = global_rank(starts, ["sheet"], [F.asc("_edge")], "region")
    return salted_join(body, numbered, ["sheet", "_edge"], ["row"]).drop("_edge", "_blank")


def is_text_cell(cell: Column) -> Column:
    """Cells are typed as text unless they read as a number."""
    return ~F.trim(cell).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def header_rows(regions: DataFrame) -> DataFrame:
    """(sheet, region, header_rows): 0, 1 or 2, from the first two rows of each region."""
    first = top_per_group(regions.select("sheet", "region", "row", "cells"), ["sheet", "region"], [F.asc("row")], 2, "n")
    filled = F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    share = F.when(F.size(filled) > 0, F.size(F.filter(filled, is_text_cell)) / F.size(filled)).otherwise(0.0)
    first = first.withColumn("_len", F.size(filled)).withColumn("_share", share)
    per = first.groupBy("sheet", "region").agg(
        *[F.max(F.when(F.col("n") == i, F.col(f"_{c}"))).alias(f"{c}{i}") for i in (1, 2) for c in ("len", "share")]
    )
    two = (F.col("len1") <= F.greatest(F.lit(2), F.floor(F.coalesce("len2", F.lit(0)) / 2))) & (F.coalesce("share2", F.lit(0.0)) >= 0.6) & F.col("len2").isNotNull()
    n = F.when((F.col("len1") < 2) | (F.col("share1") < 0.6), 0).when(two, 2).otherwise(1)
    return per.select("sheet", "region", n.cast("long").alias("header_rows"))


def heading_sections(elements: DataFrame) -> DataFrame:
    """Section path ``A > B`` of each element from the open headings of every level above it.

    ``elements``: (document, seq, level, text) with level null for non-headings. A heading closes
    deeper and equal ones; carried level by level, so a document of any length is split into runs.
    """
    levels = [1, 2, 3, 4, 5, 6]
    marked = elements
    for n in levels:
        # A heading of a higher level empties this level ("\u0000" marks "closed").
        value = F.when(F.col("level") == n, F.col("text")).when(F.col("level") < n, F.lit("\u0000"))
        marked = marked.withColumn(f"_l{n}", value)
    filled = carry_forward(marked, ["document"], "seq", [f"_l{n}" for n in levels])
    parts = F.filter(F.array(*[F.col(f"_l{n}") for n in levels]), lambda x: x.isNotNull() & (x != "\u0000"))
    return filled.withColumn("section", F.nullif(F.array_join(parts, " > "), F.lit(""))).drop(*[f"_l{n}" for n in levels])


def html_elements(pages: DataFrame) -> DataFrame:
    """(document, seq, kind, level, text) of headings, paragraphs and list items of raw pages."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<!--.*?-->", " "), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>.*?)(?=<(?:h[1-6]|p|li)\b|</(?:h[1-6]|p|li|ul|article|body)>)"), F.lit(1))
    rows = pages.select(F.col("page_id").alias("document"), F.posexplode(found).alias("seq", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("document", F.col("seq").cast("long").alias("seq"), tag.alias("tag"), text.alias("text"))
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    kind = F.when(level.isNotNull(), "heading").when(F.col("tag") == "li", "item").otherwise("paragraph")
    return rows.select("document", "seq", kind.alias("kind"), level.alias("level"), "text").where("text <> ''")


def text_elements(files: DataFrame) -> DataFrame:
    """One text element per file (whole content)."""
    return files.select("source_id", "path", "source_type", F.lit("text").alias("type"), F.decode("content", "UTF-8").alias("text"))


def raw_units(elements: DataFrame) -> DataFrame:
    """(unit_id, document, kind, literal): whole paragraphs and single cells for literal checks."""
    return elements.select(
        F.concat(F.lit("unit-"), T.short_hash(T.pair_key(F.col("document").cast("string"), F.col("seq").cast("string"), F.col("kind"), F.col("text")))).alias("unit_id"),
        "document", "kind", F.col("text").alias("literal"),
    )


def map_columns(headers: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """(table_id, role, position): which column plays which role.

    ``headers``: (table_id, position, header). Aliases are tried in order; for each one an equal
    heading wins over a containing one.
    """
    table = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(i).alias("n"), F.lit(a).alias("alias"))
        for role, aliases in ROLE_ALIASES.items() if not roles or role in roles for i, a in enumerate(aliases)
    ])
    h = headers.withColumn("_h", T.normalize(F.col("header"))).withColumn("d", F.explode(table)).withColumn("_a", T.normalize(F.col("d.alias")))
    equal = F.col("_h") == F.col("_a")
    part = (F.col("_h") != "") & (F.contains(F.col("_h"), F.col("_a")) | F.contains(F.col("_a"), F.col("_h")))
    h = h.where(equal | part)
    best = h.groupBy("table_id", "d.role").agg(F.min(F.struct(F.col("d.n").alias("n"), (~equal).alias("loose"), "position")).alias("b"))
    return best.select("table_id", "role", F.col("b.position").alias("position"))


def extract_rows(tables: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Fragments of table rows by profile: (table_id, row, context_type, name, section, value, position, relation, target_type).

    ``tables``: (table_id, source_type); ``cells``: (table_id, row, position, value); ``roles`` from
    :func:`map_columns`. Rows without a name are skipped; list sections are split into members.
    """
    spec = F.array(*[
        F.struct(
            F.lit(name).alias("profile"), F.array(*[F.lit(t) for t in types]).alias("types"), F.lit(ctx).alias("context_type"), F.lit(key).alias("name_role"),
            F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("section"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("target")) for r, s in sections.items()]
                    + [F.struct(F.lit(r).alias("role"), F.lit("references").alias("section"), F.lit(rel).alias("relation"), F.lit(t).alias("target")) for r, (rel, t) in refs.items()]).alias("fields"),
        )
        for name, types, ctx, key, sections, refs in PROFILES
    ])
    plans = tables.withColumn("p", F.explode(F.filter(spec, lambda p: F.array_contains(p["types"], F.col("source_type"))))).select("table_id", "p.*")
    valued = salted_join(cells.withColumn("value", F.trim("value")).where("value <> ''"), roles, ["table_id", "position"], ["row"])
    names = valued.join(plans.select("table_id", "profile", "context_type", F.col("name_role").alias("role")), ["table_id", "role"])
    names = names.select("table_id", "row", "profile", "context_type", F.col("value").alias("name"))
    fields = plans.select("table_id", "profile", F.explode("fields").alias("f")).select("table_id", "profile", "f.*")
    body = salted_join(valued, fields, ["table_id", "role"], ["row"]).join(names, ["table_id", "row", "profile"])
    split = F.col("section").isin(*SPLIT_SECTIONS) | (F.col("section") == "references")
    parts = F.when(split, T.split_values(F.col("value"))).otherwise(F.array("value"))
    rows = body.select("table_id", "row", "context_type", "name", "section", F.posexplode(parts).alias("position", "value"), "relation", F.col("target").alias("target_type"))
    own = names.select("table_id", "row", "context_type", "name", F.lit("identity").alias("section"), F.lit(0).alias("position"), F.col("name").alias("value"),
                       F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("target_type"))
    return own.unionByName(rows)


def match_units(units: DataFrame, pattern: str, kind: str, file_pattern: str = "%", groups: tuple[str, ...] = ()) -> DataFrame:
    """Units of a kind and file whose text matches; each named group becomes a column by its position."""
    rows = units.where((F.col("kind") == kind) & F.col("document").cast("string").like(file_pattern) & F.col("literal").rlike(pattern))
    for i, g in enumerate(groups, 1):
        rows = rows.withColumn(g, F.regexp_extract("literal", pattern, i))
    return rows


def select_pointer(records: DataFrame, column: str, pointer: str, keep: list[str]) -> DataFrame:
    """JSON-pointer selection with ``*`` over a VARIANT column: (keep…, pointer, value)."""
    rows = records.select(*keep, F.lit("").alias("pointer"), F.col(column).alias("value"))
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        if key == "*":
            inner = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("_pos", "_key", "_val"))
            step = F.coalesce(F.col("_key"), F.col("_pos").cast("string"))
            rows = inner.select(*keep, F.concat("pointer", F.lit("/"), T.pointer_escape(step)).alias("pointer"), F.col("_val").alias("value"))
        else:
            path = f"$[{key}]" if key.isdigit() else f"$['{key}']"
            rows = rows.select(*keep, F.concat("pointer", F.lit("/" + part)).alias("pointer"), F.try_variant_get("value", path, "variant").alias("value"))
            rows = rows.where(F.col("value").isNotNull())
    return rows
