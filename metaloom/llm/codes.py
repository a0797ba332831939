"""Vector code compression (operator 12): product codebooks trained with LAESA pivot bounds and exact integer distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.vectors import BLOCKS, Block, packed, read_blocks, vector_blocks
from metaloom.scale import CUT_BYTES, SALTS, cut_lineage, salted_join

SCALE = 4096
PARTS, ENTRIES, ROUNDS, PIVOTS = 8, 16, 6, 6
#: What rounding of two square roots and their difference can add to a bound, as a share of the larger one.
SLACK = 1e-12
RESULT = "vec_id long, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string"

Codebooks = list[list[list[int]]]


def split_parts(matrix: np.ndarray) -> np.ndarray:
    """(parts, rows, entries of a part): eight equal consecutive parts; a length that eight does not divide is filled with zeros."""
    rows, dim = matrix.shape
    size = -(-dim // PARTS)
    filled = np.pad(matrix, ((0, 0), (0, size * PARTS - dim))) if size * PARTS > dim else matrix
    return filled.reshape(rows, PARTS, size).transpose(1, 0, 2)


def _exact(values: np.ndarray | list) -> np.ndarray:
    """64-bit numbers if squared distances of such values fit them, else Python's own."""
    array = np.asarray(values)
    most = float(np.abs(array.astype(float)).max(initial=0.0))
    return array.astype(np.int64) if array.shape[-1] * (4 * most * most) < 2.0**62 else array.astype(object)


def _meet(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as exact numbers of one kind."""
    points, entries = _exact(points), _exact(entries)
    return (points, entries) if points.dtype == entries.dtype else (points.astype(object), entries.astype(object))


def choose_pivots(entries: np.ndarray, wanted: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen (ties: the first)."""
    entries = _exact(entries)
    chosen, gap = [0], None
    while len(chosen) < min(wanted, len(entries)):
        apart = ((entries - entries[chosen[-1]]) ** 2).sum(axis=1)
        gap = apart if gap is None else np.minimum(gap, apart)
        chosen.append(int(np.argmax(gap)))
    return entries[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows, pivots) as roots of exact squares."""
    points, pivots = _meet(points, pivots)
    return np.column_stack([np.sqrt(((points - p) ** 2).sum(axis=1).astype(float)) for p in pivots])


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, exact squared distance) of the nearest entry of every point, ties to the lower index, and how many distances that took.

    The difference of a point's and an entry's distance to a pivot is never above their own
    distance. Each point goes through the entries by rising bound and stops where the bound
    exceeds the best distance found; only the entries before that are evaluated.
    """
    points, entries = _meet(points, entries)
    bound = np.abs(to_pivots[:, None, 0] - entry_pivots[None, :, 0])
    for q in range(1, to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, None, q] - entry_pivots[None, :, q]), out=bound)
    slack = SLACK * (to_pivots.max(initial=0.0) + entry_pivots.max(initial=0.0) + 1)
    order = np.argsort(bound, axis=1, kind="stable")
    floor = np.maximum(np.take_along_axis(bound, order, axis=1) - slack, 0.0)
    floor *= floor * (1 - SLACK)
    code = order[:, 0].astype(np.int64)
    best = ((points - entries[code]) ** 2).sum(axis=1)
    open_rows, evaluated = np.arange(len(points)), len(points)
    for rank in range(1, len(entries)):
        open_rows = open_rows[floor[open_rows, rank] <= best[open_rows].astype(float)]
        if not len(open_rows):
            break
        tried = order[open_rows, rank]
        apart = ((points[open_rows] - entries[tried]) ** 2).sum(axis=1)
        evaluated += len(open_rows)
        held = best[open_rows]
        better = (apart < held) | ((apart == held) & (tried < code[open_rows]))
        best[open_rows[better]], code[open_rows[better]] = apart[better], tried[better]
    return code, best, evaluated


def _assign(block: Block, books: Codebooks, book_pivots: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, codes, squared distances) of each part of a block."""
    width = block.beside.shape[1] // PARTS
    for p, points in enumerate(split_parts(block.matrix)):
        code, apart, _ = nearest(points, block.beside[:, p * width : (p + 1) * width], np.array(books[p], dtype=object), book_pivots[p])
        yield points, code, apart


def _sums(blocks: DataFrame, books: Codebooks, book_pivots: list[np.ndarray]) -> dict[int, int]:
    """Sums and, at the place after the last entry, counts of the parts nearest to every codebook entry, exact; keys are places in the books."""
    size = len(books[0][0]) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, size), dtype=object)
        for block in read_blocks(batches):
            for p, (points, code, _) in enumerate(_assign(block, books, book_pivots)):
                member = code[None, :] == np.arange(ENTRIES)[:, None]
                small = points.dtype.itemsize < 8  # below 2^31: sums of a block are exact in doubles
                sums = (member.astype(float) @ points.astype(float)).astype(np.int64) if small else member.astype(object) @ points.astype(object)
                total[p, :, :-1] += sums.astype(object)
                total[p, :, -1] += member.sum(axis=1).astype(object)
        flat = total.ravel()
        used = [i for i, v in enumerate(flat) if v]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([str(flat[i]) for i in used], pa.string())], ["place", "total"])

    parts = blocks.mapInArrow(add, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {r.place: int(r.total) for r in parts.collect()}


def _first_vectors(blocks: DataFrame) -> np.ndarray:
    """The vectors of the smallest ids, null ids last, equal ids by vector."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for block in read_blocks(batches):
            ids = block.ids.to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            last = order[: ENTRIES][-1]
            near = [i for i in order if (ids[i] is None, ids[i] or 0) <= (ids[last] is None, ids[last] or 0)]
            held = sorted([*held, *((ids[i] is None, ids[i] or 0, block.matrix[i].tolist()) for i in near)])[:ENTRIES]
        yield pa.RecordBatch.from_arrays([pa.array([None if h[0] else h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.list_(pa.int64()))], ["id", "vec"])

    first = blocks.mapInArrow(heads, "id long, vec array<long>").orderBy(F.asc_nulls_last("id"), "vec").limit(ENTRIES).collect()
    return np.array([r.vec for r in first], dtype=np.int64)


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    Entries c become floor(4096 c). The eight codebooks start as the parts of the sixteen
    smallest ids; in each round every part is assigned to its nearest entry and entries move to
    the floor of their parts' mean. Distances of all parts to fixed pivots (far entries of the
    first codebook) are computed once and stored beside the vectors; each round compares the
    entries with the pivots only, and evaluates exactly what these bounds leave. Per round a task
    sends at most 8 x 16 x (entries of a part + 1) sums, which Spark adds up.

    Vectors that are null or hold null or non-finite entries are dropped, then those whose
    length is not the most frequent one (ties: the longer). A length that eight does not divide
    is filled with zeros. Null ids come last among the smallest and keep their rows; equal ids
    are told apart by their vectors; with fewer than sixteen vectors there are fewer entries.
    Entries of vectors beyond 2^53 / 4096 count as that. ``label_error`` sums ``error`` over
    rows of equal label, nulls together. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = table.sparkSession
    plain, dim = vector_blocks(table, SCALE, id_col, vec_col, label_col)
    if not dim:
        return spark.createDataFrame([], RESULT)
    books: Codebooks = split_parts(_first_vectors(plain)).tolist()
    pivots = [choose_pivots(np.array(book)) for book in books]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            yield packed(replace(block, beside=np.hstack([pivot_distances(points, pivots[p]) for p, points in enumerate(split_parts(block.matrix))])))

    blocks = cut_lineage(plain.mapInArrow(measure, BLOCKS))
    size = len(books[0][0])

    def book_distances() -> list[np.ndarray]:
        return [pivot_distances(np.array(book, dtype=object), pivots[p]) for p, book in enumerate(books)]

    for _ in range(rounds):
        sums = _sums(blocks, books, book_distances())
        for p, book in enumerate(books):
            for e in range(len(book)):
                base = (p * ENTRIES + e) * (size + 1)
                if count := sums.get(base + size):
                    book[e] = [sums.get(base + k, 0) // count for k in range(size)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    last = book_distances()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            found = [(code, apart) for _, code, apart in _assign(block, books, last)]
            codes = ["".join(f"{c:02x}" for c in row) for row in np.column_stack([c for c, _ in found]).tolist()]
            errors = [str(sum(row)) for row in zip(*(apart.tolist() for _, apart in found))]
            yield pa.RecordBatch.from_arrays([block.ids, block.labels, pa.array(codes, pa.string()), pa.array(errors, pa.string())], ["vec_id", "label", "code", "error"])

    coded = blocks.mapInArrow(encode, "vec_id long, label string, code string, error string")
    coded = cut_lineage(coded.select("vec_id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("label"), "code", F.col("error").cast("decimal(38,0)").alias("error")))
    totals = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    return salted_join(coded, totals, ["label"], ["vec_id", "code"], salts=SALTS, limit=CUT_BYTES).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress_sql(dim: int = 64) -> str:
    """The same result in DuckDB SQL over ``embeddings`` of one length."""
    size = dim // PARTS
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS m
  FROM parts JOIN book{i} USING (p) GROUP BY r, p)""")
        if i < ROUNDS:
            steps.append(f"""book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(moved.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT p, e, list(floor(total / n) ORDER BY k) AS c FROM (
      SELECT p, m.e AS e, k, sum(x[k]) AS total, count(*) AS n FROM near{i} JOIN parts USING (r, p), generate_series(1, {size}) AS s(k) GROUP BY p, m.e, k) GROUP BY p, e) moved
    ON moved.p = b.p AND moved.e = b.e)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
rows_ AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v FROM kept)),
parts AS MATERIALIZED (SELECT r, CAST(p AS INTEGER) AS p, v[p * {size} + 1:(p + 1) * {size}] AS x FROM rows_, generate_series(0, {PARTS - 1}) AS s(p)),
book0 AS MATERIALIZED (SELECT p, CAST(r - 1 AS INTEGER) AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(CAST(c[k] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS h FROM book{ROUNDS}, generate_series(1, {size}) AS s(k))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM rows_ JOIN coded USING (r)"""
