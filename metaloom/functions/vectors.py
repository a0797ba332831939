"""Vector expressions: unrolled dot products (code-generated) and the sparse concept encoder."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the versioned local concept encoder.
ENCODER_VERSION = "local-concept-subword/v1"
CONCEPTS = (
    ("signal strength", "无线信号强度", "接收信号功率", "rsrp"),
    ("weak coverage", "弱覆盖", "覆盖不足"),
    ("subscriber", "用户", "订户"),
    ("latency", "时延", "延迟"),
    ("throughput", "吞吐量", "传输速率"),
    ("packet loss", "丢包率", "丢包"),
)
CONCEPT_WEIGHT = 4.0
WORD_WEIGHT = 0.25
FIRST_SLOT = 32
HASHED_SLOTS = 480


def dot_literal(vector: Column, query: list[float]) -> Column:
    """Dot product with a constant vector, unrolled so it stays in generated code."""
    parts = [F.get(vector, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(query)]
    return reduce(lambda a, b: a + b, parts)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def valid_vector(vector: Column, size: int) -> Column:
    """Right length, all members finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == size) & finite & (norm(vector) > 0)


def cosine_literal(vector: Column, query: list[float]) -> Column:
    length = math.sqrt(sum(q * q for q in query))
    if not length:
        raise ValueError("the encoder returned a zero query vector")
    return dot_literal(vector, query) / (norm(vector) * F.lit(length))


def concept_slots(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slot, weight) rows of the sparse concept vector of each text."""
    low = F.lower(F.col(text))
    concepts = F.array(
        *[
            F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(i))
            for i, words in enumerate(CONCEPTS)
        ]
    )
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9_]+|[一-鿿]"), F.lit(0)))
    dims = df.select(key, F.explode(F.filter(concepts, lambda x: x.isNotNull())).alias("slot")).select(
        key, F.col("slot").cast("long").alias("slot"), F.lit(CONCEPT_WEIGHT).alias("w")
    )
    hashed = df.select(key, F.explode(words).alias("_word")).select(
        key,
        (F.conv(F.substring(F.sha2("_word", 256), 1, 8), 16, 10).cast("long") % HASHED_SLOTS + FIRST_SLOT).alias("slot"),
        F.lit(WORD_WEIGHT).alias("w"),
    )
    return dims.unionByName(hashed).groupBy(key, "slot").agg(F.sum("w").alias("w"))
