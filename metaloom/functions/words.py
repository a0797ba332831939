"""Words of whole texts, counted in Arrow batches: the words of ``text.tokens``, without sorting arrays of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

from .text import CJK

RUNS, WIDE = re.compile(f"[a-z0-9_]+|[{CJK}]+"), re.compile(f"[{CJK}]{{2}}")
COUNTED = "counts array<struct<token:string,tf:bigint,body:boolean>>, dl bigint"


def words(text: str | None) -> list[str]:
    """As ``text.tokens``: words of [a-z0-9_], and two-character windows over Chinese runs."""
    low = (text or "").lower()
    runs = RUNS.findall(low)
    if not WIDE.search(low):
        return runs
    wide = lambda r: r[0] >= CJK[0] and len(r) > 1
    return [w for r in runs for w in ([r[i : i + 2] for i in range(len(r) - 1)] if wide(r) else [r])]


def word_counts(df: DataFrame, keys: Sequence[str], short: Column, long: Column) -> DataFrame:
    """``keys``, counts (token, tf, body) of the words of both texts together, and their number; ``body`` tells whether the long text has the word."""
    rows = df.select(*keys, short.cast("string").alias("_short"), long.cast("string").alias("_long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tokens, tfs, bodies, lengths = [0], [], [], [], []
            for a, b in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()):
                inside = Counter(words(b))
                total = inside + Counter(words(a))
                tokens.extend(total)
                tfs.extend(total.values())
                bodies.extend(t in inside for t in total)
                at.append(len(tokens))
                lengths.append(sum(total.values()))
            items = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(tfs, pa.int64()), pa.array(bodies, pa.bool_())], names=["token", "tf", "body"])
            counts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)
            columns = [*(batch.column(i) for i in range(len(keys))), counts, pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "counts", "dl"])

    schema = StructType([rows.schema[k] for k in keys])
    for field in StructType.fromDDL(COUNTED):
        schema = schema.add(field)
    return rows.mapInArrow(count, schema)
