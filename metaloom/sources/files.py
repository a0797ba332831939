"""File inventories: recursive scan, fingerprints, delivery manifests, frozen corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Readable suffixes of a source folder.
SUFFIXES = ("xlsx", "xlsm", "docx", "txt", "md", "json", "sql")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, source_id, source_type, bytes, sha256, content) of every readable file below ``root``.

    The kind is the first folder name with dashes made underscores.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rel = F.element_at(F.split("path", F.lit(base), 2), -1)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.where(suffix.isin(*suffixes)).withColumn("rel", rel)
    parts = F.split("rel", "/")
    kind = F.when(F.size(parts) > 1, F.replace(parts[0], F.lit("-"), F.lit("_"))).otherwise("unknown")
    return rows.select(
        F.col("rel").alias("path"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "").alias("source_id"), kind.alias("source_type"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content",
    )


def manifest_sources(spark: SparkSession, manifest: str) -> DataFrame:
    """Sources listed by a JSON manifest ({"sources": [{id, path, type}]})."""
    raw = spark.read.schema("sources array<struct<id:string,path:string,type:string>>").json(manifest, multiLine=True)
    return raw.select(F.explode("sources").alias("s")).select("s.id", "s.path", F.coalesce("s.type", F.lit("unknown")).alias("type"))


def inventory_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem) of a delivery against its manifest: both carry (path, kind, sha256).

    An exact delivery gives no rows. Paths that leave the folder and repeated entries are
    problems of their own.
    """
    unsafe = declared.where(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."))
    twice = declared.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    a = actual.select("path", F.col("kind").alias("_kind"), F.col("sha256").alias("_sha"))
    both = declared.dropDuplicates(["path"]).join(a, "path", "full_outer")
    problem = (
        F.when(F.col("_sha").isNull(), "extra_in_manifest").when(F.col("sha256").isNull(), "missing_in_manifest")
        .when(~F.col("kind").eqNullSafe(F.col("_kind")), "kind_mismatch").when(F.col("sha256") != F.col("_sha"), "fingerprint_mismatch")
    )
    rows = both.select("path", problem.alias("problem")).where("problem IS NOT NULL")
    return rows.unionByName(unsafe.select("path", F.lit("unsafe_path").alias("problem"))).unionByName(twice.select("path", F.lit("duplicate_entry").alias("problem")))


def coverage_allowed(status: str, authoritative: bool) -> None:
    """A COMPLETE declaration needs an authoritative inventory."""
    if status == "COMPLETE" and not authoritative:
        raise ValueError("COMPLETE coverage requires an authoritative inventory")


def verify_frozen(frozen: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of a frozen corpus that vanished, appeared or changed: both carry (path, sha256, bytes)."""
    a = actual.select("path", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes"))
    rows = frozen.select("path", "sha256", "bytes").join(a, "path", "full_outer")
    change = (
        F.when(F.col("_sha").isNull(), "removed").when(F.col("sha256").isNull(), "added")
        .when((F.col("sha256") != F.col("_sha")) | (F.col("bytes") != F.col("_bytes")), "changed")
    )
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")
