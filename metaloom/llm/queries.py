"""Registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.codes import compress_sql
from metaloom.llm.secrets import scan_secrets, scan_sql
from metaloom.llm.urls import judge_sql
from metaloom.plans.registry import Registry
from metaloom.scale import ensure_checkpoint_dir

R = Registry()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@R.query("op8_bpe_encode_decode")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.bpe import encode_decode

    coded = encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@R.query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@R.query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.ctph import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


@R.query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


@R.query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.ecoc import identify_languages

    return identify_languages(documents(spark, sf_dir))


@R.query("op6_token_id_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.tokenids import read_token_files, write_token_files

    target = f"{ensure_checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), target, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, target).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@R.query("op1_secret_scan", scan_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


@R.query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.quality import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@R.query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.decontaminate import mark_contaminated

    return mark_contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@R.query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.lines import dedup_lines

    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


@R.query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@R.query("op12_vector_codes", compress_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.codes import compress

    coded = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.withColumns({c: F.col(c).try_cast("long") for c in ("error", "label_error")})


@R.query("op13_url_filters", judge_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaloom.llm.urls import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
