"""Section fusion: ordered, authority-aware merging of fragment payloads.

Fragments are rows (ctx_id, section, seq, source_type, value, status). Scalar sections are an
ordered fold: the first value stays until a *different* value with a *strictly higher* source
rank arrives. Ranks only rise, so one section changes value at most as often as there are
ranks. That turns the fold into a few aggregations instead of one long scan per group, which
also works when one context holds a third of all fragments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LIST_SECTIONS, PROVENANCE_RANK, SECTION_AUTHORITY, TRUSTED
from ..scale import cut_lineage, salted_join

KEYS = ["ctx_id", "section"]
NOT_SECTIONS = ("identity", "references")


def authority_rank(authority: Mapping[str, Sequence[str]] = SECTION_AUTHORITY) -> Column:
    """Rank of a source type for a section: list length minus position, 0 when not listed."""
    pairs = [
        (f"{section}\u001f{source}", len(order) - i)
        for section, order in authority.items()
        for i, source in enumerate(order)
    ]
    ranks = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.concat_ws("\u001f", "section", "source_type")), F.lit(0))


def provenance_rank(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PROVENANCE_RANK.items() for x in kv]), status)


def rank_name(rank: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in PROVENANCE_RANK.items() for x in (v, k)]), rank)


def trusted_fragments(fragments: DataFrame) -> DataFrame:
    return fragments.where(F.col("status").isin(*TRUSTED))


def candidate_sections(fragments: DataFrame) -> DataFrame:
    """Inferred and candidate payloads never enter a section; they are listed apart."""
    return fragments.where(~F.col("status").isin(*TRUSTED))


def fuse_lists(fragments: DataFrame, sections: Sequence[str] = LIST_SECTIONS) -> DataFrame:
    """Order-keeping union: one row per distinct member with the place it was first seen."""
    rows = trusted_fragments(fragments).where(F.col("section").isin(*sections))
    return rows.groupBy(*KEYS, "value").agg(F.min("seq").alias("first_seq"), F.count("*").alias("mentions"))


def combined_status(fragments: DataFrame) -> DataFrame:
    """Conservative status of a list section: the weakest of its fragments."""
    rows = trusted_fragments(fragments)
    return rows.groupBy(*KEYS).agg(rank_name(F.min(provenance_rank(F.col("status")))).alias("status"))


def scalar_rows(fragments: DataFrame, authority=SECTION_AUTHORITY) -> DataFrame:
    rows = trusted_fragments(fragments).where(~F.col("section").isin(*LIST_SECTIONS, *NOT_SECTIONS))
    return rows.select(*KEYS, "seq", "value", "source_type", "status", authority_rank(authority).alias("rank"))


STATE = ("seq", "value", "source_type", "status", "rank")


def scalar_states(fragments: DataFrame, authority=SECTION_AUTHORITY) -> DataFrame:
    """Every value a scalar section ever held: (keys, seq, value, source_type, status, rank)."""
    rows = scalar_rows(fragments, authority)
    # The first value may lack rank fields but never its seq, so a struct minimum is an ordered pick.
    first = rows.groupBy(*KEYS).agg(F.min(F.struct(*STATE)).alias("s")).select(*KEYS, "s.*")
    current = cut_lineage(first)
    states = current
    for step in range(1, max(len(order) for order in authority.values()) + 1):
        held = current.select(
            *KEYS, F.col("seq").alias("held_seq"), F.col("value").alias("held_value"), F.col("rank").alias("held_rank")
        )
        # After n replacements the rank is at least n, so only higher-ranked rows can matter now.
        rivals = salted_join(rows.where(F.col("rank") >= step), held, KEYS, ["seq"]).where(
            "seq > held_seq AND rank > held_rank AND NOT value <=> held_value"
        )
        current = cut_lineage(rivals.groupBy(*KEYS).agg(F.min(F.struct(*STATE)).alias("s")).select(*KEYS, "s.*"))
        states = states.unionByName(current)
    return states


def fuse_scalars(states: DataFrame) -> DataFrame:
    """Winning value per scalar section: the last state."""
    return states.groupBy(*KEYS).agg(F.max(F.struct(*STATE)).alias("s")).select(*KEYS, "s.*")


def scalar_conflicts(fragments: DataFrame, states: DataFrame, authority=SECTION_AUTHORITY) -> DataFrame:
    """One row per arrival that disagreed with the value held at that moment."""
    rows = scalar_rows(fragments, authority)
    # At most one state per rank, so the packed history is a handful of entries.
    history = states.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*STATE))).alias("history"))
    seen = salted_join(rows, history, KEYS, ["seq"])
    held = F.try_element_at(F.filter("history", lambda s: s["seq"] < F.col("seq")), F.lit(-1))
    taken = F.exists("history", lambda s: s["seq"] == F.col("seq"))
    seen = seen.where("seq > history[0].seq").withColumn("held", held).withColumn("taken", taken)
    seen = seen.where("NOT value <=> held.value")
    pick = lambda a, b: F.when(F.col("taken"), F.col(a)).otherwise(F.col(b))
    return seen.select(
        *KEYS,
        "seq",
        pick("value", "held.value").alias("kept"),
        pick("held.value", "value").alias("discarded"),
        pick("source_type", "held.source_type").alias("kept_source"),
        pick("held.source_type", "source_type").alias("discarded_source"),
    )
