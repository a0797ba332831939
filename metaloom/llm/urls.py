"""URL filters (operator 13): host and path rules in a memory-mapped sorted array of 64-bit digests."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import bounded_batches
from metaloom.scale import CUT_BYTES, SALTS, cut_lineage, ensure_checkpoint_dir, salted_join

#: The rules, as host/path, and their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The block list of the query: hosts of advertising, spam and adult sites, asked where no rule fits.
LISTED = tuple(f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Kinds of entries; of two rules with the same text the one that blocks holds.
ALLOW, BLOCK, LIST = 0, 1, 2
#: Largest array that is sent to the executors as a file; longer lists are joined instead.
ARRAY_BYTES = 256 << 20
SHARD_ROWS = 100_000
RESULT = "page_id long, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and without ``://``; only A-Z are lower-cased."""
    host, path = (F.coalesce(F.regexp_extract(url, URL, g), F.lit("")) for g in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _entries(spark: SparkSession, rules: DataFrame | Sequence, listed: DataFrame | Sequence) -> DataFrame:
    """Distinct (entry, kind, host_size, path_size, digest) of both lists; an entry without a slash fits every path of its host."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "rule string, verdict string")
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(e,) for e in listed], "entry string")
    both = rules.select(F.col("rule").alias("entry"), F.when(F.col("verdict") == "block", BLOCK).otherwise(ALLOW).alias("kind")).union(listed.select("entry", F.lit(LIST)))
    host = F.translate(F.substring_index("entry", "/", 1), string.ascii_uppercase, string.ascii_lowercase)
    named = both.where(host != "").select(F.concat(host, F.expr("substr(entry, length(substring_index(entry, '/', 1)) + 1)")).alias("entry"), F.length(host).alias("host_size"), "kind")
    return named.distinct().withColumns({"path_size": F.length("entry") - F.col("host_size"), "digest": F.xxhash64("entry")})


def _shards(entries: DataFrame, rows: int) -> DataFrame:
    """The sorted array in pieces (first, n, keys, kinds, sizes, texts): range partitions by unsigned digest, packed in the tasks."""
    unsigned = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            keys = batch.column(0).to_numpy().view(np.uint64)
            row = [int(batch.column(3)[0].as_py()), len(texts), keys.tobytes(), batch.column(1).to_numpy().astype(np.uint8).tobytes(), np.array([len(t) for t in texts], np.uint32).tobytes(), b"".join(texts)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["first", "n", "keys", "kinds", "sizes", "texts"])

    placed = entries.select("digest", F.col("kind").cast("int").alias("kind"), "entry", unsigned.alias("place"))
    ordered = placed.repartitionByRange(max(1, -(-rows // SHARD_ROWS)), "place").sortWithinPartitions("place", "entry", "kind")
    return ordered.mapInArrow(pack, "first long, n int, keys binary, kinds binary, sizes binary, texts binary")


def _send_array(shards: DataFrame, spark: SparkSession) -> str:
    """Write the array piece by piece as four raw files of the shared folder and have every executor fetch them; gives their name."""
    name = f"digests-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for column in ("keys", "kinds", "sizes", "texts"):
        path = hadoop.Path(f"{ensure_checkpoint_dir(spark)}/{name}.{column}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        for shard in shards.orderBy("first").select(column).toLocalIterator():
            out.write(bytearray(shard[0]))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return name


class DigestArray:
    """Sorted 64-bit digests, kinds and full texts of the entries, mapped from files; probes are binary searches of many digests at once."""

    def __init__(self, name: str, rows: int) -> None:
        def view(part: str, kind: type) -> np.ndarray:
            return np.memmap(SparkFiles.get(f"{name}.{part}"), kind, "r") if rows else np.zeros(0, kind)

        self.keys, self.kinds, self.texts = view("keys", np.uint64), view("kinds", np.uint8), view("texts", np.uint8)
        self.ends = np.cumsum(view("sizes", np.uint32), dtype=np.int64)

    def text(self, i: int) -> bytes:
        return self.texts[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, texts: list[bytes]) -> list[list[int]]:
        """Kinds of the entries equal to each text; entries of one digest stand side by side and are told apart by their texts."""
        digests = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)
        first, after = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found: list[list[int]] = [[] for _ in texts]
        for k in np.flatnonzero(after > first).tolist():
            found[k] = [int(self.kinds[i]) for i in range(first[k], after[k]) if self.text(i) == texts[k]]
        return found


@lru_cache(maxsize=2)
def mapped(name: str, rows: int) -> DigestArray:
    return DigestArray(name, rows)


def candidates(host: str, path: str, longest_host: int, path_sizes: Sequence[int]) -> list[str]:
    """Texts of all entries that would fit: the host and its parents, no longer than any entry's host, with the path's beginnings of known lengths."""
    found, at = [], 0
    if len(host) > longest_host:  # parents that are short enough only
        at = host.find(".", len(host) - longest_host - 1) + 1
        if not at:
            return found
    while True:
        found += [host[at:] + path[:size] for size in path_sizes if size <= len(path)]
        dot = host.find(".", at)
        if dot < 0:
            return found
        at = dot + 1


def _by_array(pages: DataFrame, name: str, rows: int, longest_host: int, path_sizes: list[int]) -> DataFrame:
    deepest = max(path_sizes, default=0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = mapped(name, rows)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            heads = list(zip(hosts, (p[:deepest] for p in paths)))
            asked = {head: candidates(*head, longest_host, path_sizes) for head in dict.fromkeys(heads)}
            texts = list(dict.fromkeys(t for found in asked.values() for t in found))
            kinds = dict(zip(texts, array.find([t.encode("utf-8", "surrogatepass") for t in texts])))
            verdicts = {}
            for head, fitting in asked.items():
                rules = [(len(t), t, max(k for k in kinds[t] if k != LIST)) for t in fitting if any(k != LIST for k in kinds[t])]
                size, rule, kind = max(rules, default=(0, None, None))
                listed = any(LIST in kinds[t] for t in fitting)
                verdicts[head] = (rule, "block" if kind == BLOCK or (kind is None and listed) else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([verdicts[h][0] for h in heads], pa.string()), pa.array([verdicts[h][1] for h in heads], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.mapInArrow(judge, RESULT)


def _by_join(pages: DataFrame, entries: DataFrame, longest_host: int, path_sizes: list[int]) -> DataFrame:
    """The same verdicts by joining distinct candidates with the list: for lists beyond any executor's disk."""
    pages = cut_lineage(pages)
    deepest = max(path_sizes, default=0)
    head = pages.withColumn("head", F.left("path", F.lit(deepest)))
    # Of a host longer than any entry's only parents that are short enough: what follows a dot in its end.
    end = F.right("host", F.lit(longest_host + 1))
    short = F.when(F.length("host") <= longest_host, F.col("host")).when(F.contains(end, F.lit(".")), F.regexp_extract(end, r"(?s)^[^.]*\.(.*)$", 1))
    labels = F.split("short", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(s) for s in path_sizes]).cast("array<int>"), lambda s: s <= F.length("head"))
    texts = F.flatten(F.transform(parents, lambda h: F.transform(lengths, lambda s: F.concat(h, F.left(F.col("head"), s)))))
    asked = head.select("host", "head").distinct().withColumn("short", short).where("short IS NOT NULL").select("host", "head", F.explode(texts).alias("entry"))
    kinds = entries.groupBy("entry").agg(F.max(F.when(F.col("kind") != LIST, F.col("kind"))).alias("kind"), F.max(F.col("kind") == LIST).alias("listed"))
    fits = salted_join(asked, kinds, ["entry"], ["host", "head"], salts=SALTS, limit=CUT_BYTES)
    order = F.when(F.col("kind").isNotNull(), F.struct(F.length("entry"), "entry"))
    won = fits.groupBy("host", "head").agg(F.max_by(F.struct("entry", "kind"), order).alias("won"), F.max("listed").alias("listed"))
    judged = salted_join(head, won, ["host", "head"], ["page_id", "path"], how="left", salts=SALTS, limit=CUT_BYTES)
    blocked = F.coalesce(F.col("won.kind") == BLOCK, F.col("listed"), F.lit(False))
    return judged.select("page_id", "host", "path", F.col("won.entry").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str]] = RULES,
    listed: DataFrame | Sequence[str] = LISTED,
    id_col: str = "page_id",
    url_col: str = "url",
    array_bytes: int = ARRAY_BYTES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` (rule, verdict) and the block list ``listed`` (entry) hold texts host/path. One
    fits its host and all its subdomains if the url's path starts with its path; without a slash
    it fits every path. The longest fitting rule (of equal length the last in text order) gives
    ``rule`` and the verdict; where no rule fits, a fitting entry of the block list blocks, and
    all else is allowed.

    The lists are hashed and sorted by Spark into an array of 64-bit digests that every executor
    maps from a file. A batch of urls gives its distinct possible entries (the host's parents
    times the path's beginnings of lengths that occur in the lists), which are found by one
    vectorised binary search and confirmed by their full texts. Lists of more than
    ``array_bytes`` are joined with the candidates instead, with the same result.

    Null urls and urls without ``://`` have empty host and path and are allowed; null ids and
    repeated rows each get a row; empty tables give empty results, empty lists fit nothing. Other
    columns are ignored.
    """
    spark = pages.sparkSession
    entries = cut_lineage(_entries(spark, rules, listed))
    size = entries.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("entry") + 13), F.lit(0)).alias("bytes"), F.coalesce(F.max("host_size"), F.lit(0)).alias("longest")).first()
    path_sizes = sorted(r[0] for r in entries.select("path_size").distinct().collect())
    host, path = url_parts(pages[url_col].cast("string"))
    parts = bounded_batches(pages).select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if size.bytes > array_bytes:
        return _by_join(parts, entries, size.longest, path_sizes)
    name = _send_array(cut_lineage(_shards(entries, size.rows)), spark) if size.rows else ""
    return _by_array(parts, name, size.rows, size.longest, path_sizes)


def judge_sql(rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] = LISTED) -> str:
    """The same result in DuckDB SQL over ``pages``."""

    def table(entries: Sequence[tuple[str, str]]) -> str:
        return ", ".join(f"('{e}', '{e.split('/', 1)[0]}', '/{e.split('/', 1)[1]}', '{v}')" for e, v in entries)

    fits = "(host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)"
    return f"""
WITH rules(rule, h, t, verdict) AS (VALUES {table(rules)}),
listed(entry, h, t, verdict) AS (VALUES {table([(e, 'block') for e in listed])}),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
won AS (SELECT *, (SELECT arg_max(rule, length(rule)) FROM rules WHERE {fits}) AS rule, EXISTS (SELECT 1 FROM listed WHERE {fits}) AS bad FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT verdict FROM rules r WHERE r.rule = won.rule), CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM won"""
