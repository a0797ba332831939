"""Immutable, content-addressed snapshots of a compiled catalogue."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import fingerprint_diff, row_fingerprint

AUDIT_COLUMNS = ("created_at", "built_at")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that ignores row order and audit columns.

    Row hashes are summed in two wide decimals, so the aggregate is partial everywhere and the
    table is neither sorted nor collected.
    """
    cols = [c for c in df.columns if c not in AUDIT_COLUMNS]
    rows = df.select(row_fingerprint(*cols).alias("h"))
    part = lambda start: F.coalesce(F.sum(F.conv(F.substring("h", start, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("rows"), part(1).alias("a"), part(16).alias("b")).select(
        "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest")
    )


def _rename(spark: SparkSession, source: str, target: str, replace: bool) -> None:
    """One rename by the cluster's own file system; with ``replace`` readers see the old or the new file, never none."""
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[1].toUri(), spark._jsc.hadoopConfiguration()).rename(*paths, options)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Small file, staged and then renamed over the old one."""
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = staged.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    _rename(spark, staged.toString(), path, replace=True)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


class SnapshotStore:
    """``root/versions/<version>/<table>`` plus ``root/latest.json``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def version_of(self, tables: dict[str, DataFrame]) -> tuple[str, dict[str, dict]]:
        marks = {}
        for name in sorted(tables):
            row = table_fingerprint(tables[name]).first()
            marks[name] = {"rows": row["rows"], "digest": row["digest"]}
        joined = json.dumps(marks, sort_keys=True)
        digest = self.spark.range(1).select(F.sha2(F.lit(joined), 256).alias("d")).first()["d"]
        return f"context-{digest[:16]}", marks

    def save(self, tables: dict[str, DataFrame], issues: DataFrame | None = None) -> str:
        """Publish; errors in ``issues`` block it. An equal catalogue keeps its version and is not written twice."""
        if issues is not None:
            bad = issues.where("severity = 'error'").groupBy("code").agg(F.count("*").alias("n")).orderBy("code").limit(20).collect()
            if bad:
                raise ValueError("quality errors block publishing: " + ", ".join(f"{r['code']} x{r['n']}" for r in bad))
        version, marks = self.version_of(tables)
        base = f"{self.root}/versions/{version}"
        if not self._exists(f"{base}/manifest.json"):
            # A crash leaves only a staged folder behind; the version appears whole or not at all.
            staged = f"{self.root}/staged/{version}-{uuid.uuid4().hex}"
            for name, df in tables.items():
                df.write.mode("errorifexists").parquet(f"{staged}/{name}")
            _write_text(self.spark, f"{staged}/manifest.json", json.dumps({"version": version, "tables": marks}, sort_keys=True))
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
            _rename(self.spark, staged, base, replace=False)
        _write_text(self.spark, f"{self.root}/latest.json", json.dumps({"version": version}))
        return version

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def load(self, version: str | None = None, verify: bool = False) -> dict[str, DataFrame]:
        version = version or json.loads(_read_text(self.spark, f"{self.root}/latest.json"))["version"]
        base = f"{self.root}/versions/{version}"
        manifest = json.loads(_read_text(self.spark, f"{base}/manifest.json"))
        tables = {name: self.spark.read.parquet(f"{base}/{name}") for name in manifest["tables"]}
        if verify and self.version_of(tables)[0] != version:
            raise ValueError(f"snapshot {version} does not match its content")
        return tables


def apply_changes(current: DataFrame, incoming: DataFrame, key: str = "path", fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(merged, changes): keep unchanged rows, replace changed ones, drop removed ones.

    ``incoming`` is the full new state. Unchanged rows keep their old derived columns.
    """
    changes = fingerprint_diff(current, incoming, key, fingerprint)
    kept = current.join(changes.select(key), key, "left_anti")
    fresh = incoming.join(changes.where("change <> 'removed'").select(key), key, "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True), changes


def resume_plan(planned: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs that are not finished yet."""
    return planned.join(completed.select(*keys).distinct(), keys, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_pages(pages: DataFrame, path: str) -> DataFrame:
    """Evidence pages (path, l1) as JSON lines, and the inventory (path, sha256, bytes) of what was written."""
    pages.select("path", F.col("l1").alias("text")).write.mode("errorifexists").json(path)
    stored = pages.sparkSession.read.schema("path string, text string").json(path)
    return stored.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
