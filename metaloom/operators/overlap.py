"""Exact top-k by number of shared keys, safe for keys that very many rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage, salted_join, top_per_group

HOT_KEY = 256
SUBSET_KEYS = 10
_SEP = "\u001f"


def _subsets(keys: str):
    """Every non-empty subset of a sorted key array, as (members joined, size)."""
    return F.expr(
        f"transform(sequence(1, shiftleft(1, size({keys})) - 1), mask -> struct("
        f"array_join(filter({keys}, (k, i) -> (shiftright(mask, i) & 1) = 1), '{_SEP}') AS subset, bit_count(mask) AS size))"
    )


def _hot_limit(right: DataFrame, held: DataFrame, hot: int) -> int:
    """Smallest tried limit above which no id holds more than ``SUBSET_KEYS`` hot keys."""
    sized = cut_lineage(salted_join(right, held, ["key"], ["id"]).select("id", "holders"))
    while True:
        most = sized.where(F.col("holders") > hot).groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n").alias("m")).first()["m"]
        if not most or most <= SUBSET_KEYS:
            return hot
        hot *= 4


def top_overlaps(left: DataFrame, right: DataFrame, top: int, hot: int = HOT_KEY, distinct_sides: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """(id, other, shared, rank): for each left id the ``top`` right ids sharing the most keys.

    ``left`` / ``right``: (id, key). Keys held by at most ``hot`` right ids join member by
    member. Hotter keys never do. For them each right id is listed under every subset of its hot
    keys (at most 2^10, ``hot`` is raised until that holds), and only the first ``top`` + 1 ids
    of a subset are kept. That is exact: a right id whose shared hot keys are S and that is not
    among the first ids of S has at least ``top`` ids before it that share S and come earlier.
    Ids that also share a rarer key are scored exactly. Ties go to the smaller id. With
    ``distinct_sides`` false an id never meets itself. ``extra``: (id, other) pairs that count as
    one more shared key.
    """
    left, right = cut_lineage(left.distinct()), cut_lineage(right.distinct())
    held = right.groupBy("key").agg(F.count("*").alias("holders"))
    hot = _hot_limit(right, held, hot)
    hot_keys = cut_lineage(held.where(F.col("holders") > hot).select("key"))
    rare = right.join(hot_keys, "key", "left_anti").withColumnRenamed("id", "other")
    pairs = salted_join(left, rare, ["key"], ["id"]).select("id", "other", F.lit(1).alias("one"))
    if extra is not None:
        pairs = pairs.unionByName(extra.select("id", "other").distinct().withColumn("one", F.lit(1)))
    met = pairs.groupBy("id", "other").agg(F.sum("one").alias("shared"))

    def hot_sets(side: DataFrame) -> DataFrame:
        common = side.join(hot_keys, "key", "left_semi")
        return cut_lineage(common.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys")))

    mine, theirs = hot_sets(left), hot_sets(right)
    none = F.array().cast("array<string>")
    met = salted_join(met, mine, ["id"], ["other"], how="left").withColumnRenamed("keys", "mine")
    met = salted_join(met, theirs.withColumnRenamed("id", "other"), ["other"], ["id"], how="left")
    exact = met.select("id", "other", (F.col("shared") + F.size(F.array_intersect(F.coalesce("mine", none), F.coalesce("keys", none)))).alias("shared"))
    listed = theirs.select(F.col("id").alias("other"), F.explode(_subsets("keys")).alias("s")).select("other", "s.subset")
    lead = top_per_group(listed, ["subset"], [F.asc("other")], top + 1, "n").drop("n")
    # Equal left sets ask once.
    asked = mine.select("keys").distinct().where(F.size("keys") <= SUBSET_KEYS)
    asked = asked.select("keys", F.explode(_subsets("keys")).alias("s")).select("keys", "s.subset", "s.size")
    options = salted_join(asked, lead, ["subset"], ["keys"]).groupBy("keys", "other").agg(F.max("size").alias("shared"))
    best = top_per_group(options, ["keys"], [F.desc("shared"), F.asc("other")], top + 1, "n").drop("n")
    folded = salted_join(mine, best, ["keys"], ["id"]).select("id", "other", "shared")
    # A left id with more hot keys than that asks only for listed subsets it fully holds.
    wide = mine.where(F.size("keys") > SUBSET_KEYS).select("id", F.explode("keys").alias("key"))
    parts = lead.select("subset").distinct().withColumn("members", F.split("subset", _SEP))
    parts = parts.select("subset", F.size("members").alias("size"), F.explode("members").alias("key"))
    held_subsets = salted_join(parts, wide, ["key"], ["subset"]).groupBy("id", "subset", "size").agg(F.count("*").alias("n")).where("n = size")
    direct = salted_join(held_subsets, lead, ["subset"], ["id"]).groupBy("id", "other").agg(F.max("size").cast("long").alias("shared"))
    merged = exact.unionByName(folded.select("id", "other", F.col("shared").cast("long").alias("shared"))).unionByName(direct)
    if not distinct_sides:
        merged = merged.where("id <> other")
    merged = merged.groupBy("id", "other").agg(F.max("shared").cast("long").alias("shared"))
    return top_per_group(merged, ["id"], [F.desc("shared"), F.asc("other")], top)
