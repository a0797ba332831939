"""Language identification (operator 7): error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import bounded_batches, text_pairs, text_rows

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
EVIDENCE = 20.0  # the mean log ratio of a bit counts as that of so many n-grams
AMBIGUOUS = 0.8
EXHAUSTIVE = 6  # up to so many languages all two-way splits are used
PIECE = 1 << 20  # characters whose n-grams are counted at once


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed letter trigrams over a whole lower-cased text, other characters as word ends; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.concatenate(([32], np.where(is_letter, codes, 32), [32])).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes) - 2, PIECE):
        part = codes[at : at + PIECE + 2]
        keys = (part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA6B) + part[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)
        counts += np.bincount(keys[part[1:-1] != 32], minlength=BUCKETS)
    return counts


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of +1 and -1: all two-way splits of a few languages, else the best of fifty seeded random codes."""
    if n <= EXHAUSTIVE:
        splits = range(1, 1 << max(n - 1, 0))
        return np.array([[1 if split >> i & 1 else -1 for split in splits] for i in range(n)], np.int8).reshape(n, len(splits))
    draw, best, widest = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = draw.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T) // 2
        closest = apart[~np.eye(n, dtype=bool)].min()
        if closest > widest:
            best, widest = code, closest
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits


def fit_bits(languages: list[str], counts: np.ndarray) -> Model:
    """A binary n-gram classifier per bit: log ratio of the mean distributions of the languages on its two sides."""
    rates = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True) if len(languages) else np.zeros((0, BUCKETS))
    code = codewords(len(languages))
    sides = [np.log(rates[code[:, b] > 0].mean(axis=0)) - np.log(rates[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    return Model(languages, code, np.array(sides, np.float64).reshape(code.shape[1], BUCKETS).T)


def decode(model: Model, counts: np.ndarray) -> tuple[str, float, bool]:
    """Language with the least logistic loss over the bits, its share of the weight, and whether it is ambiguous."""
    if not model.languages:
        return "und", 0.0, True
    used = np.flatnonzero(counts)
    mean = counts[used] @ model.weights[used] / counts[used].sum()
    loss = np.logaddexp(0, -model.code * (mean * EVIDENCE)).sum(axis=1)
    weight = np.exp(loss.min() - loss)
    best = int(np.argmin(loss))
    score = float(weight[best] / weight.sum())
    return model.languages[best], score, score < AMBIGUOUS


def train(rows: DataFrame) -> Model:
    """Model from (doc_id, text, lang) rows; counts are summed by Spark, the driver gets one number per language and bucket.

    All rows are used. Each task adds up its rows and sends a sparse count per language, so
    the collected table is bounded by languages x 16,384 buckets.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts = gram_counts(text)
                if counts is not None:
                    sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["lang", "bucket", "n"])

    table = bounded_batches(rows).mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in table["lang"]], table["bucket"]] = table["n"]
    return fit_bits(languages, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text; ``und`` with score 0 for null texts and texts without letters."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_pairs(batches):
            found = []
            for text in texts:
                counts = gram_counts(text)
                found.append(("und", 0.0, True) if counts is None else decode(model, counts))
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return text_rows(docs, id_col, text_col).mapInArrow(decoded, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify_languages(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): languages learnt from the rows not held out, predicted for all.

    A row is held out if crc32 of its id as text (null: empty) leaves no remainder by
    ``folds``. Rows with a null language or text teach nothing. Texts without letters are
    ``und``; ties go to the language first in the alphabet; without any labelled row every
    text is ``und``. Repeated rows each get a row; an empty table gives an empty result;
    other columns are ignored. Learning and predicting each read the table once; nothing
    but counts is shuffled.
    """
    held_out = F.crc32(F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("")).cast("binary")) % folds == 0
    lessons = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out)
    lessons = lessons.select(lessons[id_col].cast("long").alias("doc_id"), lessons[text_col].cast("string").alias("text"), lessons[lang_col].cast("string").alias("lang"))
    found = predict(docs, train(lessons), id_col, text_col)
    return found.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
