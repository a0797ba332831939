"""Incremental upkeep of the page index from a stream of page changes.

A change row is (path, name, context_type, l0, l1, identity_status, version, deleted). Every
micro-batch is reduced to the newest version per page; pages whose content did not change are
skipped; what the rest gained and lost becomes one delta segment of the stored index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import UNTRUSTED
from ..functions import text as T
from ..operators import search as S
from ..operators.quality import row_fingerprint
from .segments import DeltaIndex

PAGE_COLUMNS = ("path", "name", "context_type", "l0", "l1", "identity_status")
PAGE_SCHEMA = ", ".join(f"{c} string" for c in PAGE_COLUMNS)


def latest_changes(batch: DataFrame) -> DataFrame:
    """Newest change per page; a struct maximum pre-aggregates, so one busy page is no hot group."""
    cols = [c for c in batch.columns if c not in ("path", "version")]
    newest = batch.groupBy("path").agg(F.max_by(F.struct(*cols), F.col("version")).alias("c"), F.max("version").alias("version"))
    return newest.select("path", "version", *[f"c.{c}" for c in cols])


def merge_pages(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, changed paths) after a batch; pages carry their content fingerprint."""
    newest = latest_changes(batch)
    marked = newest.withColumn("fingerprint", row_fingerprint(*PAGE_COLUMNS))
    same = marked.where("NOT deleted").join(current.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi").select("path")
    changed = newest.select("path").join(same, "path", "left_anti")
    kept = current.join(changed, "path", "left_anti")
    fresh = marked.where("NOT deleted").join(same, "path", "left_anti").select(*PAGE_COLUMNS, "fingerprint")
    return kept.unionByName(fresh), changed


def merge_postings(postings: DataFrame, pages: DataFrame, changed: DataFrame) -> DataFrame:
    """Only changed pages are tokenized again."""
    kept = postings.join(changed, "path", "left_anti")
    touched = pages.join(changed, "path", "left_semi")
    return kept.unionByName(S.postings(touched))


def token_entries(space: Column, tokens: Column, member: Column) -> Column:
    """Entries of a text: each distinct token once with its count."""
    return F.transform(T.counted(tokens), lambda t: F.struct(space.alias("space"), t["token"].alias("key"), member.alias("member"), t["tf"].alias("weight")))


class StreamingIndex:
    """Pages and their postings as a delta index under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = DeltaIndex(spark, root)

    def tables(self, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(pages with fingerprint, postings (path, token, tf)) as of a batch or now."""
        stored = self.store.read("owners", as_of=as_of).select(F.from_json("payload", PAGE_SCHEMA).alias("p"))
        pages = stored.select("p.*").withColumn("fingerprint", row_fingerprint(*PAGE_COLUMNS))
        posts = self.store.postings(as_of)
        return pages, posts.select(F.col("member").alias("path"), F.col("key").alias("token"), F.col("weight").alias("tf"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch target; a batch that is retried writes its own segment again, one that is committed is left alone."""
        newest = latest_changes(batch)
        tokens = F.when(F.col("identity_status").isin(*UNTRUSTED), F.array().cast("array<string>")).otherwise(T.tokens(S.index_text(newest)))
        rows = newest.withColumn("tokens", tokens).select(
            F.col("path").alias("owner"), F.to_json(F.struct(*PAGE_COLUMNS)).alias("payload"),
            token_entries(F.lit("page"), F.col("tokens"), F.col("path")).alias("entries"), "deleted",
        )
        self.store.apply(rows, batch_id)
        self.store.compact()

    def start(self, changes: DataFrame, checkpoint: str, available_now: bool = True):
        """Run over a streaming frame of change rows."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
