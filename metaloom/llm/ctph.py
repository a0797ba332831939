"""Document fingerprints (operator 2): context-triggered piecewise hashing and its likeness."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.common import text_pairs, text_rows
from metaloom.scale import cut_lineage

WINDOW = 7
MULTIPLIERS = tuple(pow(0x01000193, k, 1 << 32) for k in range(WINDOW))
SPREADER = 0x9E3779B1
SMALLEST = 2  # smallest block size, as a power of two
WANTED = 32  # chunks at the chosen block size, at least, where the text has so many boundaries
LONGEST_RUN = 3  # equal neighbouring chunks beyond this say nothing more
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOL = 3  # characters of a chunk's signature
ENCODED = [a + b for a in DIGITS for b in DIGITS]


def _signature(data: bytes, ends: list[int]) -> str:
    """One symbol per chunk between boundaries, from the chunk's checksum."""
    out, start, last, run = [], 0, None, 0
    view = memoryview(data)
    for end in [*ends, len(data)]:
        if end == start:
            continue
        checksum = zlib.crc32(view[start:end])
        start = end
        run = run + 1 if checksum == last else 1
        last = checksum
        if run <= LONGEST_RUN:
            out.append(ENCODED[checksum & 4095] + DIGITS[checksum >> 12 & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the block size`` of a text's UTF-8 bytes.

    A hash rolls over the last seven bytes; a chunk ends where its leading bits are zero, so
    the boundaries at twice the block size are some of those at the block size. The block
    size is the largest power of two that still gives 32 boundaries (4 for short texts).
    """
    data = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    rolling = codes * np.uint32(1)
    for k in range(1, min(WINDOW, len(codes))):
        rolling[k:] += codes[: len(codes) - k] * np.uint32(MULTIPLIERS[k])
    rolling *= np.uint32(SPREADER)
    places = np.flatnonzero(rolling < np.uint32(1 << (32 - SMALLEST)))
    level = 32 - np.ceil(np.log2(rolling[places].astype(np.float64) + 1)).astype(np.int64)
    at_least = np.cumsum(np.bincount(level, minlength=33)[::-1])[::-1]
    enough = np.flatnonzero(at_least >= WANTED)
    size = max(SMALLEST, int(enough[-1])) if len(enough) else SMALLEST
    parts = [_signature(data, (places[level >= k] + 1).tolist()) for k in (size, size + 1)]
    return f"{1 << size}:{parts[0]}:{parts[1]}"


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit per symbol of ``a`` (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, symbol in enumerate(a):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for symbol in b:
        hit = row & masks.get(symbol, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - edit distance (a replacement counts two edits) over both lengths."""
    x, y = ([s[i : i + SYMBOL] for i in range(0, len(s), SYMBOL)] for s in (a, b))
    if not x or not y:
        return float(a == b)
    return 2 * common_length(x, y) / (len(x) + len(y))


def likeness(one: str, other: str) -> float:
    """0 to 1: best likeness of signatures at a block size that both fingerprints hold; 0 if they share none."""
    if one == other:
        return 1.0
    a, b = one.split(":"), other.split(":")
    small, large = int(a[0]), int(b[0])
    if small == large:
        return max(_alike(a[1], b[1]), _alike(a[2], b[2]))
    if small * 2 == large:
        return _alike(a[2], b[1])
    return _alike(a[1], b[2]) if large * 2 == small else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")] + ["kind", "place", "text"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]


def _compared(doc_id, text: str, own: str, following: str, of_following: str) -> tuple:
    changed = edited(text, following)
    of_changed = own if changed == text else fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, of_changed, likeness(own, of_changed), likeness(own, of_following)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and its likeness to both the edited and the next text.

    The next document is the one that follows by (doc_id, text), null ids first; the last
    one is followed by the first. Rows are range-partitioned by id once and compared while
    a task streams over them in order; the first and last text of each task (two per
    partition) are written beside the results and joined to close the gaps, so neither a
    global sort in one task nor the driver is needed. Null texts count as empty; a single
    document is its own next one; repeated rows each get a row; an empty table gives an
    empty result; other columns are ignored.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, previous = TaskContext.get().partitionId(), None
        for ids, texts in text_pairs(batches):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                own = fingerprint(text)
                if previous is None:
                    rows.append((doc_id, None, None, own, None, None, None, "head", place, text))
                else:
                    rows.append((*_compared(*previous, text, own), "row", place, None))
                previous = doc_id, text, own
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        if previous is not None:
            yield _batch([(previous[0], None, None, previous[2], None, None, None, "tail", place, previous[1])])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compared(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=False)], names=NAMES[:7])

    placed = text_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = cut_lineage(placed.mapInArrow(streamed, f"{COLUMNS}, kind string, place int, text string"))
    by_place = Window.orderBy("place")  # two rows per partition in all
    heads = parts.where("kind = 'head'").select("place", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = parts.where("kind = 'tail'").select("place", "doc_id", "text", "fingerprint")
    tails = tails.select("*", F.coalesce(F.lead("place").over(by_place), F.min("place").over(Window.partitionBy(F.lit(0)))).alias("next_place"))
    ends = tails.join(heads.withColumnRenamed("place", "next_place"), "next_place").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    rows = parts.where("kind = 'row'").select(*NAMES[:7])
    return rows.unionByName(ends.mapInArrow(closed, COLUMNS))
