"""Helpers shared by the operators: input normalisation, per-document Arrow maps, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.scale import cut_lineage


BATCH_BYTES = 8 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """Have Spark cut its Arrow batches by size, so that long texts do not meet in one; a smaller setting of the session stays."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return docs


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; all other columns, clashing names included, stay behind."""
    return bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory of a Python worker to the system: idle workers share the executor with the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim:
        trim(0)


def text_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Document ids and texts of each Arrow batch as Python lists."""
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()
        del batch
    give_back()


class Memo(dict):
    """Results of a pure function by key, in two generations of bounded size; very long keys are not kept."""

    def __init__(self, compute: Callable, limit: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def fresh(self, keys: set) -> list:
        """The keys without a result; results of the others move to the younger generation."""
        new = []
        for key in keys:
            if key not in self:
                value = self.old.get(key)
                if value is None:
                    new.append(key)
                else:
                    self.keep(key, value)
        return new

    def keep(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node it can reach.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the
    hooks to their ends by pointer jumping, and contracts the edges to the ends, until no
    edge is left. A round costs joins on the edges that remain; a hub only ever meets one
    parent row, so no neighbour list is gathered anywhere. Self-loops count as nodes; null
    ends are ignored; without edges the result is empty.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut_lineage(edges.distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    open_edges = edges.where("a <> b")
    while not open_edges.isEmpty():
        both = open_edges.union(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent")))
        while True:
            ends = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("end"))
            hooks = cut_lineage(hooks.join(ends, "parent").select("node", F.col("end").alias("parent"), (F.col("end") != F.col("parent")).alias("moved")))
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("node", "parent")
        roots = cut_lineage(roots.join(hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        for end in ("a", "b"):
            open_edges = open_edges.join(hooks.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("parent", end)
        open_edges = cut_lineage(open_edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots.select("node", "root")
