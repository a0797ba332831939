"""Line dedup (operator 4): segment-partition edit join, verified by banded bit-parallel edit distance."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import bounded_batches, components, give_back
from metaloom.scale import broadcast_rows, counted_join, cut_lineage

EDITS = 2  # edits that make two lines the same
SHORTEST = 1  # characters of a line whose equal repeats go: every line that is not blank
LINKED = 20  # characters of a line that can be a copy by edits
FEW = 64  # index rows of a key up to which each is compared with every probe row of the key
BASE = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPREAD = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 18  # characters whose keys are computed at once
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: str) -> list[str]:
    """Lines of a text without outer blanks that are long enough to be copies by edits."""
    return [s for line in text.split("\n") if len(s := line.strip(BLANKS)) >= LINKED]


def spark_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, number, line, line_id): all lines but blank ones with their numbers, in the JVM; the id is a 64-bit hash of the line."""
    lines = rows.select(*keys, F.posexplode(F.split("text", "\n", -1)).alias("number", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    return lines.where(F.length("line") >= SHORTEST).withColumn("line_id", F.xxhash64("line"))


def line_id(line: str) -> int:
    """The same hash for one line."""
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


def segment(length, i: int, edits: int):
    """(start, size) of segment i of ``edits`` + 1 of lines of some lengths, the longer ones last."""
    small, longer = length // (edits + 1), length % (edits + 1)
    first_longer = edits + 1 - longer
    return i * small + np.maximum(i - first_longer, 0), small + (i >= first_longer)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(difference, segment, shift): where a line looks for segments of lines that are ``difference`` characters shorter.

    Segment i can begin ``shift`` places after its place in the shorter line only if the
    edits before it (shift) and behind it (difference - shift) fit what a first match from
    the left, or from the right, leaves: i on the left, edits - i on the right.
    """
    return [
        (d, i, shift)
        for d in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)
    ]


def ways(edits: int, probing: bool) -> list[tuple[int, int, int]]:
    """The (difference, segment, shift) of the probe rows, or of the index rows, of a line."""
    return probes(edits) if probing else [(0, i, 0) for i in range(edits + 1)]


def rest_of(text: str, short: int, budget: int, i: int, shift: int) -> tuple[str, list[tuple[str, int, int]]] | None:
    """What is the same if segment i of a string of ``short`` characters stands ``shift`` places later in ``text``, and what may differ.

    What may differ are parts (text, characters of the shorter string, edits): what stands
    before the segment within i edits, what stands behind it within the others. A part
    without edits is the same as well. None if the segment does not fit.
    """
    start, size = (int(x) for x in segment(short, i, budget))
    place = start + shift
    if place < 0 or place + size > len(text):
        return None
    same, parts = [text[place : place + size]], []
    for part, length, edits in ((text[:place], start, i), (text[place + size :], short - start - size, budget - i)):
        if edits:
            parts.append((part, length, edits))
        else:
            same.append(part)
    return "\0".join(same), parts


def next_keys(key: int, parts: list[tuple[str, int, int]], probing: bool) -> Iterator[tuple[int, list[tuple[str, int, int]], bool]]:
    """(key, parts, final): keys under which a row of one key is told apart from others by its parts that may still differ.

    Each part is split into one segment more than it may have edits, as lines are at first. A
    part with no more characters than edits is not split; final rows have only such parts.
    """
    choices = []
    for text, short, edits in parts:
        if short <= edits:
            choices.append([("", [(text, short, edits)])])
            continue
        d = len(text) - short
        found = []
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1) if probing else (0,):
                rest = rest_of(text, short, edits, i, shift)
                if rest:
                    found.append((f"{i}\0{rest[0]}", rest[1]))
        choices.append(found)
    for chosen in itertools.product(*choices):
        left = [part for _, rest in chosen for part in rest]
        name = "\0".join([str(key), *[same for same, _ in chosen]])
        yield line_id(name), left, all(short <= edits for _, short, edits in left)


@functools.lru_cache(maxsize=2)
def powers(n: int = BLOCK) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64 for a block of lines, or for one longer line."""
    return [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64)))) for b in (BASE, UNDO)]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of a rolling hash over the letters of a block of lines."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(max(BLOCK, len(codes)))[0][: len(codes)], dtype=np.uint64)))


def substring_keys(sums: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    """A 64-bit key of (length of the indexed line, segment, substring) for many substrings at once."""
    hashes = (sums[start + size] - sums[start]) * powers(max(BLOCK, len(sums) - 1))[1][start]
    keys = (hashes ^ (hashes >> np.uint64(29))) * SPREAD + (length * 16 + i).astype(np.uint64) * BASE
    return ((keys ^ (keys >> np.uint64(32))) * SPREAD).view(np.int64)


def blocks_of(lines: list[str]) -> Iterator[list[str]]:
    """Lines in blocks of bounded length; a longer line is a block of its own."""
    block, n = [], 0
    for line in lines:
        if n + len(line) > BLOCK and block:
            yield block
            block, n = [], 0
        block.append(line)
        n += len(line)
    if block:
        yield block


def key_columns(lines: list[str], edits: int, probing: bool) -> list[np.ndarray]:
    """Columns key, line_id, odd, length, way of the index rows or the probe rows of a block of lines.

    ``way`` is the place among ``ways``. ``odd`` tells which of 64 classes of characters occur an odd number of times in the line:
    an edit changes two classes at most.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.cumsum(length) - length
    ids = np.array(list(map(line_id, lines)), np.int64)
    odd = np.bitwise_xor.reduceat(np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), first).view(np.int64)
    sums, parts = prefix_sums(codes), []
    for way, (d, i, shift) in enumerate(ways(edits, probing)):
        start, size = segment(length - d, i, edits)
        place = start + shift
        fits = (place >= 0) & (place + size <= length)
        parts.append((substring_keys(sums, (first + place)[fits], size[fits], (length - d)[fits], i), ids[fits], odd[fits], length[fits].astype(np.int32), np.full(int(fits.sum()), way, np.int8)))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def within_edits(a: str, b: str, edits: int) -> bool:
    """Whether two strings are within ``edits`` edits: what differs between their common ends, by a bit-parallel band.

    The band of the distance matrix holds 2 x edits + 1 diagonals. Bit d of state e tells
    whether diagonal d is reached with e edits; a letter moves all states at once.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    a, b = _stripped(a, b)
    if len(a) <= edits and len(b) <= edits:
        return True
    # state e: bit (i - j + edits) set if a[:i] and b[:j] are within e edits, advanced row by row over a
    width = 2 * edits + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    # row i, bit k: column j = i + k - edits
    states = []
    for e in range(edits + 1):
        row = 0
        for k in range(width):
            if 0 <= k - edits <= e and k - edits <= len(b):
                row |= 1 << k
        states.append(row)
    for i, c in enumerate(a, 1):
        where = places.get(c, 0)
        shift = i - edits - 1  # bit k is set if b[i + k - edits - 1] == c
        match = (where >> shift if shift >= 0 else where << -shift) & full
        columns = full
        if i - edits < 0:
            columns &= full << (edits - i)
        if i + edits > len(b):
            over = i + edits - len(b)
            columns = columns & (full >> over) if over < width else 0
        new = []
        for e in range(edits + 1):
            row = states[e] & match  # equal letters keep the diagonal
            if e:
                row |= states[e - 1]  # replacement: same diagonal
                row |= states[e - 1] >> 1  # deletion from a: column j of the row before is one bit up there
                row |= new[e - 1] << 1  # insertion: column j - 1 of this row
            row &= columns
            new.append(row)
        states = new
        if not states[edits]:
            return False
    last = len(b) - len(a) + edits
    return bool(states[edits] >> last & 1)


def _stripped(a: str, b: str) -> tuple[str, str]:
    """Both strings without their common beginning and end."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(x) - n + start :][::-1] != y[len(y) - n + start :][::-1])
    end = int(differ[0]) if len(differ) else n - start
    return a[start : len(a) - end], b[start : len(b) - end]


def _substrings(rows: DataFrame, edits: int, probing: bool) -> DataFrame:
    """(key, line_id, odd, length): index or probe rows of every line; a line that a task has just seen is not listed again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            fresh = []
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    if line not in seen:
                        seen.add(line)
                        fresh.append(line)
            if len(seen) > 200_000:
                seen.clear()
            for block in blocks_of(fresh):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in key_columns(block, edits, probing)], names=["key", "line_id", "odd", "length", "way"])
        give_back()

    return bounded_batches(rows).select("text").mapInArrow(cut, "key long, line_id long, odd long, length int, way byte")


PARTS = "array<struct<text:string,short:int,edits:int>>"


def _likely(edits: int):
    """Condition on a pair of an index row and a probe row: each pair once, and classes of letters that agree."""
    return (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 * edits) & ((F.col("length_a") < F.col("length_b")) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b"))


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, line) of the wanted ids, each text once."""
    return cut_lineage(spark_lines(rows).select("line_id", "line").join(broadcast_rows(cut_lineage(wanted)), "line_id", "left_semi").distinct())


def _crowded(rows: DataFrame, index: DataFrame, probe: DataFrame, hot: DataFrame, edits: int) -> DataFrame:
    """(a, b): candidate pairs of the lines that meet under keys with more than ``FEW`` index rows.

    Lines made from one template share such keys, and what tells them apart is in the parts
    that may differ. These parts are split again, and once more for the keys that are still
    crowded, until few index rows share a key or a part has no more characters than edits.
    In the last case the index rows differ in so few characters that each is within the
    edits of all others, so one of them stands for all; only probe rows whose parts are
    longer meet every index row. A round moves rows, never pairs of a crowded key.
    """
    schema = f"key long, line_id long, odd long, length int, probing boolean, parts {PARTS}, final boolean"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, line, odd, length, way, probing, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                d, i, shift = ways(edits, probing)[way]
                rest = rest_of(text, length - d, edits, i, shift)
                if rest:
                    key = line_id("\0".join((str(key), str(length - d), str(i), rest[0])))
                    out.append((key, line, odd, length, probing, rest[1], all(short <= e for _, short, e in rest[1])))
            yield _batch(out)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, line, odd, length, probing, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for new, left, final in next_keys(key, [(p["text"], p["short"], p["edits"]) for p in parts], probing):
                    out.append((new, line, odd, length, probing, left, final))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    both = index.withColumn("probing", F.lit(False)).union(probe.withColumn("probing", F.lit(True)))
    met = cut_lineage(both.join(broadcast_rows(hot), "key", "left_semi").distinct())
    texts = _texts_of(rows, met.select("line_id").distinct())
    state = met.join(texts, "line_id").select("key", "line_id", "odd", "length", "way", "probing", "line").mapInArrow(begin, schema)
    found = []
    while True:
        state = cut_lineage(state)
        own = ~F.col("probing")
        counts = state.groupBy("key").agg(
            F.count_if(own).alias("n_index"), F.min(F.when(own, F.col("line_id"))).alias("least"), F.min("line_id").alias("low"), F.max("line_id").alias("high")
        )
        counts = cut_lineage(counts.where("n_index > 0 AND low <> high").select("key", "n_index", "least"))
        state = counted_join(state, counts, ["key"], ["line_id"])
        plain = F.col("final") | (F.col("n_index") <= FEW)
        fits = F.forall("parts", lambda p: F.greatest(F.length(p["text"]), p["short"]) <= p["edits"])
        alike = F.col("final") & (F.col("n_index") > FEW) & fits
        found.append(state.where(alike & (F.col("line_id") != F.col("least"))).select(F.col("least").alias("a"), F.col("line_id").alias("b")))
        left = state.where(plain & ~F.col("probing")).select("key", F.col("line_id").alias("a"), F.col("odd").alias("odd_a"), F.col("length").alias("length_a"))
        right = state.where(plain & F.col("probing") & ~alike).select("key", F.col("line_id").alias("b"), F.col("odd").alias("odd_b"), F.col("length").alias("length_b"))
        found.append(left.join(right, "key").where(_likely(edits)).select("a", "b"))
        open_rows = cut_lineage(state.where(~plain).select("key", "line_id", "odd", "length", "probing", "parts"))
        if open_rows.isEmpty():
            break
        state = open_rows.mapInArrow(go_on, schema).distinct()
    return functools.reduce(DataFrame.union, found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``_crowded`` as Arrow."""
    part = pa.struct([("text", pa.string()), ("short", pa.int32()), ("edits", pa.int32())])
    kinds = {"key": pa.int64(), "line_id": pa.int64(), "odd": pa.int64(), "length": pa.int32(), "probing": pa.bool_(), "parts": pa.list_(part), "final": pa.bool_()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    lists = [[dict(zip(("text", "short", "edits"), p, strict=True)) for p in parts] for parts in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(lists if name == "parts" else columns[i], kind) for i, (name, kind) in enumerate(kinds.items())], names=list(kinds))


def near_lines(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): ids of different lines of ``rows`` (doc_id, text) within ``edits`` edits.

    A line is split into ``edits`` + 1 segments by its length; of two lines within the edits
    the longer one holds some segment of the shorter one unchanged, near its place. Index
    rows (segments) and probe rows (substrings at those places) meet by a key of length,
    segment and text. Candidates must also agree on all but twice as many classes of letters
    as edits; only then are their texts fetched and compared. Keys with many index rows are
    split further (``_crowded``); there, lines that are all within the edits of one line are
    linked to it only, so pairs may be left out whose ends are linked through others.
    """
    index, probe = _substrings(rows, edits, False), _substrings(rows, edits, True)
    counts = index.groupBy("key").agg(F.count("*").alias("n"), F.min("line_id").alias("low"), F.max("line_id").alias("high"))
    hot = cut_lineage(counts.where((F.col("n") > FEW) & (F.col("low") != F.col("high"))).select("key"))
    crowded = not hot.isEmpty()
    left, right = index.drop("way").toDF("key", "a", "odd_a", "length_a"), probe.drop("way").toDF("key", "b", "odd_b", "length_b")
    if crowded:
        left = left.join(broadcast_rows(hot), "key", "left_anti")
    pairs = left.join(right, "key").where(_likely(edits)).select("a", "b")
    if crowded:
        pairs = pairs.union(_crowded(rows, index, probe, hot, edits))
    pairs = cut_lineage(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("line_id")).union(pairs.select(F.col("b").alias("line_id"))).distinct()
    texts = _texts_of(rows, wanted)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = [i for i in range(len(a)) if within_edits(x[i], y[i], edits)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("line_b")), "b")
    return both.select("a", "b", "line_a", "line_b").mapInArrow(compared, "a long, b long")


def repeated_lines(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, text_hash, numbers): the lines of each document that repeat an earlier line of the corpus.

    Lines with equal text or linked by ``near_lines``, directly or through others, are one
    group; its first line by (doc_id, text hash, number), null ids first, stays.
    """
    occurrences = cut_lineage(spark_lines(rows, "doc_id", "text_hash").drop("line"))
    lines = occurrences.groupBy("line_id").agg(F.min(F.struct("doc_id", "text_hash", "number")).alias("first"), F.count("*").alias("times"))
    lines = cut_lineage(lines)
    groups = components(near_lines(rows, edits)).withColumnRenamed("node", "line_id")
    joined = lines.join(groups, "line_id", "left").where((F.col("times") > 1) | F.col("root").isNotNull())
    linked = cut_lineage(joined.select("line_id", F.coalesce("root", "line_id").alias("root"), "first", "times"))
    firsts = linked.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("times").alias("all")).where(F.col("all") > 1)
    keepers = cut_lineage(linked.select("line_id", "root").join(firsts, "root").select("line_id", "keeper"))
    own = F.struct("doc_id", "text_hash", "number")
    doubled = counted_join(occurrences, keepers, ["line_id"], ["doc_id", "number"]).where(~own.eqNullSafe(F.col("keeper")))
    return doubled.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``n_lines`` and ``n_removed``, with repeated lines taken out of the text.

    Outer blanks aside, a line that equals a line that comes earlier by (doc_id, text), or that
    has ``LINKED`` characters or more and is linked to such a line by edits, is removed with
    its line end; blank lines stay. Rows with equal id and text lose the same lines. Null texts
    stay null; an empty table gives an empty result. Only removed line numbers are joined to
    the texts.
    """
    text_hash = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    removed = cut_lineage(repeated_lines(rows, edits)).select(F.col("doc_id").alias("_line_doc"), F.col("text_hash").alias("_line_hash"), F.col("numbers").alias("_numbers"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_line_doc")) & (text_hash == F.col("_line_hash"))
    joined = docs.join(broadcast_rows(removed), same, "left")
    lines = F.split(docs[text_col].cast("string"), "\n", -1)
    numbers = F.col("_numbers")
    kept = F.when(numbers.isNull(), docs[text_col].cast("string")).otherwise(F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(numbers, i)), "\n"))
    others = [docs[c] if c != text_col else kept.alias(text_col) for c in docs.columns]
    return joined.select(*others, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size(numbers), F.lit(0)).alias("n_removed"))
