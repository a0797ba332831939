"""Exact mentions of known keys inside query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scale import salted_join, top_per_group

SYMBOL = r"[a-z0-9_]+(?:[.:/\-][a-z0-9_]+)*"


def direct_candidates(queries: DataFrame) -> DataFrame:
    """Symbols and their parts, quoted phrases and the whole text: (query_id, key)."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("q"))
    symbols = F.regexp_extract_all("q", F.lit(SYMBOL), F.lit(0))
    parts = F.flatten(F.transform(symbols, lambda s: F.split(s, r"[.:/\-]")))
    quoted = F.transform(F.regexp_extract_all("q", F.lit('["“「](.*?)["”」]'), F.lit(1)), lambda s: F.trim(s))
    keys = F.array_distinct(F.concat(symbols, parts, quoted, F.array("q")))
    return q.select("query_id", F.explode(keys).alias("key")).where("key <> ''")


def phrase_candidates(queries: DataFrame, lengths: Column) -> DataFrame:
    """Stretches of text that do not cut through an identifier: (query_id, key).

    Only lengths some known key has are cut out, so a text yields at most
    characters x distinct key lengths rows.
    """
    at = lambda i: F.substring(F.col("q"), i, F.lit(1))
    q = queries.select("query_id", F.lower(F.trim("text")).alias("q")).where("q <> ''")
    places = F.sequence(F.lit(1), F.length("q"))
    starts = F.filter(places, lambda i: ~((i > 1) & at(i).rlike("[a-z0-9]") & at(i - 1).rlike("[a-z0-9_]")))
    spans = q.withColumn("lens", lengths).select("query_id", "q", "lens", F.explode(starts).alias("s"))
    spans = spans.select("query_id", "q", "s", F.explode("lens").alias("n"))
    stop = F.col("s") + F.col("n") - 1
    cut = at(stop).rlike("[a-z0-9]") & (stop < F.length("q")) & at(stop + 1).rlike("[a-z0-9_]")
    return spans.where((stop <= F.length("q")) & ~cut).select("query_id", F.substring(F.col("q"), F.col("s"), F.col("n")).alias("key"))


def resolve_mentions(queries: DataFrame, keys: DataFrame, target_limit: int | None = None) -> DataFrame:
    """Every mention of every query, longest keys first.

    ``keys``: (key, source, target, kind) with folded keys. Symbol keys match only as symbols of
    the text; other keys match anywhere between identifier borders. One-letter keys count only
    when they are the whole text. With ``target_limit`` a query gets so many targets at most, and
    a column ``truncated`` tells whether it had more.
    """
    symbol = F.col("key").rlike(f"^{SYMBOL}$")
    heads = keys
    if target_limit is not None:  # a query cannot use more of one key than its budget, and one more row shows that there are more
        heads = top_per_group(keys, ["key", "source"], [F.asc("target")], target_limit + 1, "pos").drop("pos")
    # Distinct key lengths: never more numbers than the longest key has characters.
    lengths = keys.where(~symbol).agg(F.coalesce(F.collect_set(F.length("key")), F.array().cast("array<int>")).alias("n")).scalar()
    direct = salted_join(direct_candidates(queries), heads, ["key"], ["query_id"])
    phrases = salted_join(phrase_candidates(queries, lengths), heads.where(~symbol), ["key"], ["query_id"])
    rows = direct.unionByName(phrases).dropDuplicates(["query_id", "key", "source", "target"])
    whole = queries.select("query_id", F.lower(F.trim("text")).alias("whole"))
    short = rows.where(F.length("key") < 2).join(whole, "query_id").where("key = whole").drop("whole")
    rows = rows.where(F.length("key") >= 2).unionByName(short)
    method = F.when(symbol, "exact_symbol").otherwise("exact_alias")
    found = rows.select("query_id", "key", "source", "target", "kind", method.alias("match_method"))
    if target_limit is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("key")), F.asc("key"), F.desc("source"), F.asc("target"))
    numbered = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= target_limit + 1)
    more = F.max("n").over(Window.partitionBy("query_id")) > target_limit
    return numbered.withColumn("truncated", more).where(F.col("n") <= target_limit).drop("n")
