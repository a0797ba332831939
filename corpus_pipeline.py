"""Corpus cleaning pipeline: quality, repeated lines, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.bpe import encode_decode
from metaloom.llm.decontaminate import drop_contaminated
from metaloom.llm.lines import dedup_lines
from metaloom.llm.quality import keep_good
from metaloom.llm.simhash import keep_first_copies
from metaloom.scale import cut_lineage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document goes if nothing else was in it. ``n_chars`` follows the text."""
    lines = dedup_lines(docs)
    changed = F.col("n_removed") > 0
    kept = lines.where(~changed | (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles in common; SimHash links, and smallest hashes beyond them) the document with the smallest id stays."""
    return keep_first_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed, and decoded text of every document left."""
    coded = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: Hash functions, fitted weights and edit links have no equal in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
