"""Embedding tables as packed blocks of whole numbers, written once and read by every pass of an operator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import bounded_batches
from metaloom.scale import cut_lineage

BLOCK_BYTES = 1 << 21
#: Entries beyond this count as it: their squares still add up exactly in 38 digits.
MOST = 2.0**53
BLOCKS = "dim int, n int, ids binary, labels binary, kind string, matrix binary, beside binary"
KINDS = ("<i2", "<i4", "<i8")


@dataclass
class Block:
    """Some vectors: ids (may hold nulls), labels, entries by row, and the numbers an operator packs beside them."""

    ids: pa.Array
    labels: pa.Array
    matrix: np.ndarray
    beside: np.ndarray


def _pack(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("c", column.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], ["c"]))
    return sink.getvalue().to_pybytes()


def packed(block: Block) -> pa.RecordBatch:
    """One row of a table of blocks."""
    columns = {
        "dim": pa.array([block.matrix.shape[1]], pa.int32()),
        "n": pa.array([len(block.matrix)], pa.int32()),
        "ids": pa.array([_pack(block.ids)], pa.binary()),
        "labels": pa.array([_pack(block.labels)], pa.binary()),
        "kind": pa.array([block.matrix.dtype.str], pa.string()),
        "matrix": pa.array([block.matrix.tobytes()], pa.binary()),
        "beside": pa.array([block.beside.astype("<f8").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _unpack(data: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(data.as_buffer()).read_all().column(0).combine_chunks()


def whole(entries: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * entry) in the narrowest type that holds all of them."""
    values = np.clip(np.floor(entries.astype(np.float64) * scale), -MOST, MOST)
    most = max(float(np.abs(values).max(initial=0.0)) + 1, 1.0)
    return values.astype(KINDS[0] if most < 2**15 else KINDS[1] if most < 2**31 else KINDS[2])


def vector_blocks(
    table: DataFrame,
    scale: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = None,
) -> tuple[DataFrame, int]:
    """(blocks, dimension): kept vectors as floor(scale * entry), packed into rows of about two megabytes of a written table.

    Vectors that are null or hold null or non-finite entries are left out, then those of
    another length than the most frequent one (the longer of two equally frequent ones);
    without vectors the dimension is 0. Nothing is shuffled: each task packs its own rows.
    """
    vec = table[vec_col].cast("array<double>")
    fine = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = table[label_col].cast("string") if label_col else F.lit(None).cast("string")
    rows = bounded_batches(table).where(fine).select(table[id_col].cast("long").alias("id"), label.alias("label"), table[vec_col].alias("vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, labels, parts = zip(*waiting.pop(dim))
            return packed(Block(pa.concat_arrays(ids), pa.concat_arrays(labels), whole(np.concatenate(parts), scale), np.zeros((0, 0))))

        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == dim))
                flat = vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                waiting.setdefault(dim, []).append((batch.column(0).take(at), batch.column(1).take(at), flat))
                if sum(len(p[2]) for p in waiting[dim]) * dim * 8 >= BLOCK_BYTES:
                    yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    blocks = cut_lineage(rows.mapInArrow(pack, BLOCKS))
    most = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = most.dim if most else 0
    return blocks.where(F.col("dim") == dim), dim


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of a task, one at a time; matrices are views of the Arrow buffers, nothing is copied."""
    for batch in batches:
        for dim, ids, labels, kind, matrix, beside in zip(*(batch.column(c) for c in ("dim", "ids", "labels", "kind", "matrix", "beside"))):
            entries = np.frombuffer(matrix.as_buffer(), kind.as_py()).reshape(-1, dim.as_py())
            numbers = np.frombuffer(beside.as_buffer(), "<f8")
            yield Block(_unpack(ids), _unpack(labels), entries, numbers.reshape(len(entries), -1) if len(numbers) else np.zeros((len(entries), 0)))
