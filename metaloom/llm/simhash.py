"""SimHash near-duplicates (operator 5): fuzzy keys from the Golay code, verified links, components.

The pipeline's stage links fingerprints of five words in the same way, compares the shingles of what
is linked, and looks for what four bits cannot give at similarity 0.8 by smallest shingle hashes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.common import components, give_back, text_pairs, text_rows
from metaloom.scale import broadcast_rows, counted_join, cut_lineage

SEED = 42
BLOCK = 1 << 15  # shingles whose bits are counted at once
#: Fixed value: generator polynomial of the perfect binary Golay code of length 23 and distance 7.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11
#: First bit and number of bits of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
RADIUS = 4
KEY_COLUMNS = "key int, fp long, root long"
FREE = 4  # bits of a block that may differ freely within the radius

STAGE_WIDTH, SIMILAR = 5, 0.8  # words of a shingle and share of common shingles of near copies, for the pipeline
#: Fingerprints of a text, smallest hashes in each, and the orders they are drawn from: pairs at 0.8, 0.7, 0.6, 0.5 and 0.3
#: share a fingerprint with probability 0.996, 0.85, 0.45, 0.14 and 0.003 (simulated), so that texts that merely hold a common
#: passage seldom meet.
PRINTS, ROWS, ORDERS = 40, 8, 128
#: Fingerprints (first, end) whose members are compared with one of them, round by round, before the others are looked at.
STAR_ROUNDS = ((0, 3), (3, 8))
LINKED = -1  # print of the keys of linked fingerprints, compared before the others
MINIMA_BLOCK = 1 << 12  # shingles whose hashes are permuted at once
SKETCH = 8  # words of 64 bits of the sketch of a set of shingles


def shingle_hashes(text: str, width: int) -> Iterator[bytes]:
    """64-bit hashes of the word shingles of a text (A-Z lower-cased, ASCII white space), joined by blocks; fewer words make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_digest
    starts, ends = starts[:n], ends[k - 1 :]
    for at in range(0, n, BLOCK):
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)])


def fingerprint(text: str, width: int) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed number."""
    return majority_bits(shingle_hashes(text, width))


def majority_bits(blocks: Iterable[bytes]) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
        n += len(bits)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Hashes of the different shingles of a text in rising order."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, width)), np.uint64))


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks and odd factors that put 64-bit hashes in different orders, and the orders of each fingerprint."""
    rnd = np.random.default_rng(SEED)
    masks, factors = rnd.integers(0, 1 << 64, (2, ORDERS), np.uint64)
    return masks, factors | np.uint64(1), np.array([rnd.choice(ORDERS, ROWS, replace=False) for _ in range(PRINTS)])


def minima_keys(shingles: np.ndarray) -> list[int]:
    """A key for each fingerprint: the hash of its number and of the smallest shingle in each of its orders."""
    masks, factors, drawn = permutations()
    least = np.full(ORDERS, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), MINIMA_BLOCK):
        least = np.minimum(least, ((shingles[at : at + MINIMA_BLOCK, None] ^ masks) * factors).min(axis=0))
    packed = least[drawn].tobytes()
    size = len(packed) // PRINTS
    return [_signed(xxhash.xxh64_intdigest(packed[i * size : (i + 1) * size], i)) for i in range(PRINTS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def syndrome(word: int) -> int:
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


@functools.cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high bits of a word, and the errors of weight four or less by syndrome (-1: none).

    A syndrome has one error of weight 0 to 2, or one of weight 3 and five of weight 4.
    """
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    errors: dict[int, list[int]] = {}
    for weight in range(5):
        for places in itertools.combinations(range(LENGTH), weight):
            error = sum(1 << p for p in places)
            errors.setdefault(syndrome(error), []).append(error)
    table = np.full((1 << CHECKS, 6), -1, np.int64)
    for s, found in errors.items():
        table[s, : len(found)] = found
    return low, high, table


def codeword_indices(segments: np.ndarray) -> np.ndarray:
    """Indices of all codewords within four bits of each segment: one or six, -1 for none.

    Two words of 23 bits that differ in at most two bits always share an index (checked over
    all cosets in the tests).
    """
    low, high, table = code_tables()
    errors = table[low[segments & 4095] ^ high[segments >> 12]]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> CHECKS)


def fuzzy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fingerprint, root) for each pair of segments and each pair of their codeword indices."""
    for batch in batches:
        prints, roots = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
        parts = [codeword_indices((prints.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)) for first, bits in SEGMENTS]
        for kind, (i, j) in enumerate(itertools.combinations(range(len(SEGMENTS)), 2)):
            a, b = parts[i][:, :, None], parts[j][:, None, :]
            row, x, y = np.nonzero((a >= 0) & (b >= 0))
            key = kind << 24 | parts[i][row, x] << 12 | parts[j][row, y]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(prints[row]), pa.array(roots[row])], names=["key", "fp", "root"])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([fingerprint(t, width) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return text_rows(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long")


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, root): linked groups of the distinct fingerprints in column ``fp``, all links of four bits or fewer kept.

    1. Fingerprints that agree outside one of sixteen blocks of four bits are linked for
       certain. A block's group has at most sixteen members; each is linked to the smallest.
       Dense clouds of near copies fall together here, without pairs.
    2. Four differing bits leave two of the three segments with at most two each. Every
       fingerprint is listed under all pairs of nearby codeword indices of two segments, so a
       linked pair shares a key. First each member of a key is compared with the key's
       smallest member only, which joins most of what is left of a large cloud without pairs.
    3. Then pairs that share a key but not yet a root are verified by counting bits in the
       join; roots are linked, not pairs listed.
    """
    distinct = cut_lineage(prints.select("fp").distinct())
    blocks = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64 // FREE - 1))).alias("block"))
    rest = F.expr(f"fp & ~shiftleft({(1 << FREE) - 1}L, block * {FREE})")
    stars = blocks.groupBy("block", rest.alias("rest")).agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    sure = cut_lineage(stars.select("a", F.explode("members").alias("b")).where("a <> b").distinct())
    near = _joined(distinct.select("fp", F.col("fp").alias("root")), sure)
    lowest = F.min(F.struct("fp", "root")).over(Window.partitionBy("key"))
    first = near.mapInArrow(fuzzy_keys, KEY_COLUMNS).withColumn("low", lowest)
    near = _joined(near, _root_links(first, F.col("fp"), F.col("root"), F.col("low")["fp"], F.col("low")["root"]))
    keys = near.mapInArrow(fuzzy_keys, KEY_COLUMNS)
    # Spark sizes the keys like the fingerprints they come from, so it would broadcast a hundred rows for each.
    met = keys.alias("x").hint("merge").join(keys.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _linked(F.col("x.fp"), F.col("x.root"), F.col("y.fp"), F.col("y.root")))
    return _joined(near, _root_links(met, F.col("x.fp"), F.col("x.root"), F.col("y.fp"), F.col("y.root")))


def _linked(fp: Column, root: Column, other: Column, other_root: Column) -> Column:
    return (root != other_root) & (F.bit_count(fp.bitwiseXOR(other)) <= RADIUS)


def _root_links(pairs: DataFrame, fp: Column, root: Column, other: Column, other_root: Column) -> DataFrame:
    """(a, b): the roots that verified links join, each once."""
    return cut_lineage(pairs.where(_linked(fp, root, other, other_root)).select(F.least(root, other_root).alias("a"), F.greatest(root, other_root).alias("b")).distinct())


def _joined(near: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) after the roots in ``links`` have been joined."""
    last = components(links).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return cut_lineage(near.join(last, "root", "left").select("fp", F.coalesce("last", "root").alias("root")))


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: documents whose fingerprints differ in at most four bits are linked.

    ``component_id`` is the smallest document id that can be reached, itself included. Texts
    without words, null ones among them, have fingerprint zero and are linked like any
    other; fewer words than ``width`` make one shingle. Equal fingerprints are joined once,
    as one node, so a group of copies of any size costs one row. Repeated rows each get a
    row; rows with a null id are linked but never name a component; an empty table gives an
    empty result; other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, width, id_col, text_col))
    groups = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = cut_lineage(link_fingerprints(groups).join(groups, "fp"))
    firsts = cut_lineage(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    named = linked.select("fp", "root").join(broadcast_rows(firsts), "root").select("fp", "component_id")
    return counted_join(prints, cut_lineage(named), ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingled(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, node, size, fp, keys): ``node`` is the hash of a text's set of shingles, ``fp`` its SimHash, ``keys`` those of its smallest hashes (none without words)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = list(shingle_hashes(text, width))
                shingles = np.unique(np.frombuffer(b"".join(hashes), np.uint64))
                prints.append(majority_bits(hashes))
                nodes.append(_signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)))
                sizes.append(len(shingles))
                keys.append(minima_keys(shingles) if len(shingles) else [])
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "fp", "keys"])
        give_back()

    return rows.select("doc_id", "text_hash", "text").mapInArrow(hashed, "doc_id long, text_hash long, node long, size int, fp long, keys array<long>")


def linked_keys(nodes: DataFrame) -> DataFrame:
    """(node, size, print, key): nodes with words whose fingerprints link within four bits, over others too, share a key."""
    named = nodes.where("size > 0")
    linked = link_fingerprints(named)
    return named.join(linked.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select("node", "size", F.lit(LINKED).alias("print"), F.xxhash64(F.lit("linked"), "root").alias("key"))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes by their low bits: two sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _shingle_rows(rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles, sketch) of (node, text) rows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in text_pairs(batches):
            sets = [shingle_set(t, width) for t in texts]
            columns = [pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "sketch"])

    return rows.select("node", "text").mapInArrow(hashed, "node long, shingles array<long>, sketch array<long>")


def _prefix_pairs(sets: DataFrame, near: DataFrame, similar: float) -> DataFrame:
    """Pairs (x, y, their roots and sizes) of nodes that can be similar, none left out, by their rarest shingles.

    Of two sets that share ``similar`` of their shingles, put in one order of rising frequency,
    each has a common one among its first size - similar x size + 1. Texts that merely hold a
    common passage differ just there. At the first common shingle enough must be left on both
    sides, and the sketches may differ in no more bits than similar sets of these sizes in
    shingles; only such rows leave the join.
    """
    held = cut_lineage(sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")))
    counted = held.join(held.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle"))  # a node is one text's set
    prefix = F.col("size") - F.ceil(F.lit(similar) * F.col("size") - 1e-9) + 1
    heads = counted.withColumn("place", place).where((F.col("place") <= prefix) & (F.col("n") > 1)).select("shingle", "node", "size", "place")
    heads = cut_lineage(heads.join(near, "node").join(sets.select("node", "sketch"), "node"))
    x, y = (heads.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "size", "place", "sketch")]).withColumnRenamed(f"node_{end}", end) for end in "xy")
    left = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) + 1
    enough = left >= F.lit(similar / (1 + similar)) * (F.col("size_x") + F.col("size_y")) - 1e-9
    bits = functools.reduce(Column.__add__, [F.bit_count(F.get("sketch_x", F.lit(i)).bitwiseXOR(F.get("sketch_y", F.lit(i)))) for i in range(SKETCH)])
    alike = bits <= F.lit((1 - similar) / (1 + similar)) * (F.col("size_x") + F.col("size_y")) + 1e-9
    return x.join(y, "shingle").where((F.col("x") < F.col("y")) & (F.col("root_x") != F.col("root_y")) & enough & alike)


def similar_documents(docs: DataFrame, width: int = STAGE_WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: documents that share ``similar`` of all their different word shingles are linked.

    1. Equal sets of shingles, those of texts without words among them, are one node.
    2. Nodes whose fingerprints link within four bits (``link_fingerprints``) share a key, those
       with equal smallest hashes further ones, which find what four bits miss. Nodes that share a
       key are candidates, unless their sizes rule the similarity out. Members of a key are compared with one of them for a few fingerprints,
       which joins most of a cloud of near copies without pairs. Nodes that then share a key
       with another root are compared by their rarest shingles, where no pair is left out.
    3. A candidate counts by its shingles, which are made again only for nodes that share a key.

    ``component_id`` is the smallest document id that can be reached, with nulls and repeated
    rows as in ``near_duplicates``. Pairs at 0.8 are missed with probability 0.004 each, closer
    ones less often; a lower ``similar`` is missed more often.
    """
    texts = text_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = cut_lineage(_shingled(texts, width))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"), F.max("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("print", "key")).unionByName(linked_keys(nodes))
    shared = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keyed = cut_lineage(keyed.join(broadcast_rows(shared), "key"))
    wanted = cut_lineage(nodes.join(broadcast_rows(cut_lineage(keyed.select("node").distinct())), "node", "left_semi").select("node", F.col("text_hash").alias("_hash")))
    found = texts.join(broadcast_rows(wanted), F.col("text_hash") == F.col("_hash")).select("node", "text").dropDuplicates(["node"])
    sets = cut_lineage(_shingle_rows(found, width))

    def links(pairs: DataFrame) -> DataFrame:
        """(a, b): roots of the pairs (x, y, root_x, root_y) that are similar enough."""
        both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("set_x")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("set_y")), "y")
        common = F.size(F.array_intersect("set_x", "set_y"))
        alike = common >= F.lit(similar) * (F.size("set_x") + F.size("set_y") - common) - 1e-9
        return cut_lineage(both.where(alike).select(F.least("root_x", "root_y").alias("a"), F.greatest("root_x", "root_y").alias("b")).distinct())

    def joined(near: DataFrame, found: DataFrame) -> DataFrame:
        last = components(found).select(F.col("node").alias("root"), F.col("root").alias("last"))
        return cut_lineage(near.join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root")))

    def open_pairs(pairs: DataFrame) -> DataFrame:
        sized = F.least("size_x", "size_y") >= F.lit(similar) * F.greatest("size_x", "size_y") - 1e-9
        return cut_lineage(pairs.where((F.col("root_x") != F.col("root_y")) & sized).select("x", "y", "root_x", "root_y").distinct())

    near = cut_lineage(keyed.select("node", F.col("node").alias("root")).distinct())
    for low, high in ((LINKED, LINKED + 1), *STAR_ROUNDS):
        own = keyed.where(F.col("print").between(low, high - 1)).join(near, "node")
        pivot = F.min_by(F.struct("node", "root", "size"), F.xxhash64("node", F.lit(low)))
        members = own.withColumn("mid", pivot.over(Window.partitionBy("key")))
        stars = members.select(F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("size").alias("size_x"), F.col("mid.node").alias("y"), F.col("mid.root").alias("root_y"), F.col("mid.size").alias("size_y"))
        near = joined(near, links(open_pairs(stars)))
    mixed = keyed.join(near, "node").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    still_open = cut_lineage(keyed.join(mixed, "key", "left_semi").select("node").distinct())
    near = joined(near, links(open_pairs(_prefix_pairs(sets.join(still_open, "node", "left_semi"), near, similar))))

    linked = cut_lineage(nodes.select("node", "first").join(near, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"))
    firsts = cut_lineage(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    named = linked.select("node", "root").join(broadcast_rows(firsts), "root").select("node", "component_id")
    return counted_join(rows.select("node", "doc_id", "text_hash"), cut_lineage(named), ["node"], ["doc_id", "text_hash"]).select("doc_id", "component_id")


def keep_first_copies(docs: DataFrame, width: int = STAGE_WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose id names their component of ``similar_documents``; rows that repeat such a row stay with it.

    Only the ids that go are joined to the table, by a broadcast while their size allows it.
    """
    linked = similar_documents(docs, width, similar, id_col, text_col)
    gone = cut_lineage(linked.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(broadcast_rows(gone), docs[id_col].cast("long").eqNullSafe(F.col("_gone")), "left_anti")
