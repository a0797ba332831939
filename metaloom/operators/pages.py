"""Context pages: rendered text, facets and the three disclosure levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PAGE_FACETS, PAGE_ORDER

_SUMMARY_LIMIT = 700


def render_pages(contexts: DataFrame, sections: DataFrame, refs: DataFrame | None = None, trails: DataFrame | None = None) -> DataFrame:
    """(path, name, context_type, l0, l1, facets…) from sections.

    ``sections``: (path, section, rendered) one row per section, members already joined as lines.
    A page has at most 21 ordered sections, so they are pivoted into columns without shuffling
    members twice. ``refs``: confirmed (path, relation, target_path) shown with the page;
    ``trails``: (path, view, statuses, trail) organisation lines.
    """
    wanted = ["summary", *[k for k, _ in PAGE_ORDER]]
    per = sections.where(F.col("section").isin(*wanted)).groupBy("path").agg(
        *[F.max(F.when(F.col("section") == k, F.col("rendered"))).alias(f"s{i}") for i, k in enumerate(wanted)]
    )
    rows = contexts.select("path", "name", "context_type").join(per, "path", "left")
    summary = F.coalesce(F.nullif(F.col("s0"), F.lit("")), F.concat("name", F.lit(" ("), "context_type", F.lit(")")))
    lines = [F.concat(F.lit("# "), "name"), F.lit(""), summary]
    for i, (_, title) in enumerate(PAGE_ORDER, 1):
        lines.append(F.when(F.coalesce(F.col(f"s{i}"), F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n"), F.col(f"s{i}"))))
    if refs is not None:
        shown = refs.select("path", F.concat(F.lit("- "), "relation", F.lit(": "), "target_path").alias("line"))
        # The reference list belongs to one page and is part of its text.
        shown = shown.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("ref_lines"))
        rows = rows.join(shown, "path", "left")
        lines.append(F.when(F.col("ref_lines").isNotNull(), F.concat(F.lit("\n## References\n"), F.col("ref_lines"))))
    if trails is not None:
        text = F.concat(F.lit("\n## Organization: "), "view", F.lit(" ("), "statuses", F.lit(")\n"), "trail")
        org = trails.select("path", F.struct("view", text.alias("t")).alias("o")).groupBy("path").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["t"]), "\n").alias("org_lines")
        )
        rows = rows.join(org, "path", "left")
        lines.append(F.col("org_lines"))
    index = {k: i for i, k in enumerate(wanted)}
    facets = [F.col(f"s{index[sec]}").alias(f"facet_{name}") for name, sec in PAGE_FACETS.items()]
    return rows.select(
        "path", "name", "context_type", F.substring(summary, 1, _SUMMARY_LIMIT).alias("l0"), F.concat_ws("\n", *lines).alias("l1"), *facets
    )


def render_members(members: DataFrame) -> DataFrame:
    """List members as Markdown lines per section: members (path, section, position, value)."""
    rows = members.groupBy("path", "section").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("m"))
    lines = F.transform("m", lambda x: F.concat(F.lit("- "), x["value"]))
    return rows.select("path", "section", F.array_join(lines, "\n").alias("rendered"))


def read_page(pages: DataFrame, level: str = "L1") -> DataFrame:
    """L0 summary or L1 text of pages; column pruning keeps the other level out of the scan."""
    level = level.upper()
    if level not in {"L0", "L1"}:
        raise ValueError("page text has levels L0 and L1; sections are read with read_sections")
    return pages.select("path", F.lit(level).alias("level"), F.col(level.lower()).alias("content"))


def read_sections(sections: DataFrame, paths: DataFrame, names: list[str] | None = None) -> DataFrame:
    """L2: section rows of the given pages, optionally only some sections."""
    rows = sections if not names else sections.where(F.col("section").isin(*names))
    return rows.join(paths.select("path").distinct(), "path", "left_semi")


def read_sources(evidence: DataFrame, paths: DataFrame, section: str | None = None) -> DataFrame:
    """Source locations behind the given pages, optionally of one section."""
    rows = evidence if section is None else evidence.where(F.col("section") == section)
    return rows.join(paths.select("path").distinct(), "path", "left_semi")
