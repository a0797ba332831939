"""Fragment hand-off in JSON or JSON lines with contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATION = "struct<source_id:string,path:string,sheet:string,section:string,table:string,row:int,column:int,cell:string>"
EVIDENCE = f"array<struct<source:{LOCATION},note:string>>"
FRAGMENT = (
    "fragment_id string, context_type string, candidate_name string, section_type string, payload string, aliases array<string>, identity_hints map<string,string>, "
    f"features map<string,string>, references array<struct<relation:string,raw_target:string,target_type:string,status:string,target_path:string,confidence:double,evidence:{EVIDENCE}>>, "
    f"evidence {EVIDENCE}, source_type string, confidence double, status string"
)
REQUIRED = ("fragment_id", "context_type", "candidate_name", "section_type", "payload")
STATUSES = ("EXPLICIT", "DERIVED", "INFERRED", "CANDIDATE")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one JSON document per file when the name ends in .json."""
    rows = spark.read.schema(FRAGMENT).option("multiLine", path.endswith(".json")).json(path)
    return rows.withColumn("status", F.coalesce("status", F.lit("EXPLICIT"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn(
        "source_type", F.coalesce("source_type", F.lit("unknown"))
    )


def fragment_errors(fragments: DataFrame) -> DataFrame:
    """(fragment_id, error) for every broken rule of the contract."""
    located = F.forall("evidence", lambda e: (F.coalesce(e["source"]["source_id"], F.lit("")) != "") & (F.coalesce(e["source"]["path"], F.lit("")) != ""))
    named = F.forall("references", lambda r: (F.coalesce(r["relation"], F.lit("")) != "") & (F.coalesce(r["raw_target"], F.lit("")) != ""))
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in REQUIRED]
    checks += [
        F.when(~F.col("status").isin(*STATUSES), "invalid_status"), F.when(~F.col("confidence").between(0.0, 1.0), "confidence_out_of_range"),
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "missing_evidence"), F.when(F.col("evidence").isNotNull() & ~located, "evidence_without_location"),
        F.when(F.col("references").isNotNull() & ~named, "incomplete_reference"),
    ]
    return fragments.select("fragment_id", F.explode(F.array_compact(F.array(*checks))).alias("error"))
