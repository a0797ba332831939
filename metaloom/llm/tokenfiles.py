"""Token-id files (operator 6): blocks of ids behind an adaptive context-mixing range coder.

A file is a Parquet table of chunks; a chunk is a binary frame of whole documents:

    magic "TIDS", version, number of documents, symbols and blocks, block size, number of phrases (header)
    document ids (signed 64-bit deltas, null flags), ids per document          (deflated)
    ids per phrase                                                            (deflated)
    per block: checksum, distinct ids, code words                             (deflated)
    per block: its distinct ids in rising order, as gaps                      (deflated)
    per block: 32-bit code words of the range coder

Symbols are the ids of all documents or, if there are phrases, the ids of each phrase followed
by the phrase numbers of all documents: a word of many ids is spelt once in a chunk, then it is
one symbol. Every block starts with fresh models and holds up to BLOCK symbols, called ids below.
All blocks of a chunk are coded side by side, one id of each at a time, so that the work per id is array work.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"TIDS"
VERSION = 2
BLOCK = 2048
TOTAL_BITS = 20  # probabilities of an id add up to 1 << TOTAL_BITS
PLAIN_BITS = 15  # those of order 0 to 1 << PLAIN_BITS
SLOTS = 2048  # order-2 contexts of a block, hashed
UPDATES = frozenset((32, 64, 128, 256, 512, 1024))
GAIN = 32  # weight of an id seen against one only listed
TRUST = 8  # levels of trust in a context's prediction
RATE = 4  # a level's hit rate moves by 1/16 of its error
STEP_BITS = 5
COARSE = 1 << (PLAIN_BITS - STEP_BITS)  # steps of a block's table from probabilities of order 0 to ids
SLAB = 64  # blocks whose ids are ranked at once
ROOM = (1 << TOTAL_BITS) - (1 << PLAIN_BITS)
HEADER = struct.Struct("<4sBIQIII")
LOW32 = np.uint64(0xFFFFFFFF)
ONE32 = np.uint64(1 << 32)


class Mixer:
    """Predictions of order 0 to 2 for the next id of every block, and their mixture.

    Ids are ranks in their block's list. Order 1 and 2 each remember the id that last followed
    the context and how far to trust it; a level's hit rate, learnt in the block, is the
    prediction's share of the whole. The rest goes to order 0: counts of the ids seen.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        n, widest = len(sizes), int(sizes.max())
        self.n, self.width, self.sizes = n, widest, sizes
        self.lane = np.arange(n)
        self.base = self.lane * widest
        self.counts = (np.arange(widest)[None, :] < sizes[:, None]).astype(np.int32)
        # contexts of order 1 (one per id) and, behind them, of order 2
        self.second = n * self.width + self.lane * SLOTS
        self.cells = np.zeros(n * (self.width + SLOTS), np.int16)  # predicted id * TRUST + trust in it
        self.levels = np.arange(2 * n).reshape(2, n) * TRUST
        self.rates = np.tile(np.array([0, 2, 4, 6, 8, 10, 12, 13], np.int64) << (16 - 4), 2 * n)
        self.at = np.zeros((2, n), np.int64)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.renew()

    def renew(self) -> None:
        """Order 0 from the counts: every listed id keeps a share of at least one."""
        sums = np.zeros((self.n, self.width + 1), np.int32)  # below GAIN * BLOCK << PLAIN_BITS, so they fit
        np.cumsum(self.counts, axis=1, out=sums[:, 1:])
        sums *= ((1 << PLAIN_BITS) - self.sizes).astype(np.int32)[:, None]
        sums //= np.maximum(self.counts.sum(axis=1, dtype=np.int32), 1)[:, None]
        sums[:, 1:] += np.minimum(np.arange(1, self.width + 1)[None, :], self.sizes[:, None]).astype(np.int32)
        # where an id begins and how much it has, in one number
        self.plain = (sums[:, :-1] << 16 | sums[:, 1:] - sums[:, :-1]).ravel()
        self.coarse = None

    def look(self, k: int) -> None:
        """Predictions and shares for the first ``k`` blocks."""
        at, last = self.at[:, :k], self.last[:k]
        np.add(self.base[:k], last, out=at[0])
        np.add(self.second[:k], (last * 40503 + self.before[:k] * 2531) >> 3 & (SLOTS - 1), out=at[1])
        cells = self.cells.take(at)
        self.guess, self.trusted = cells >> 3, cells & (TRUST - 1)
        self.level = self.levels[:, :k] + self.trusted
        self.rate = self.rates.take(self.level)
        self.w2 = self.rate[1] * ROOM >> 16
        self.w1 = self.rate[0] * (ROOM - self.w2) >> 16
        self.w0 = (1 << TOTAL_BITS) - self.w1 - self.w2

    def share(self, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Mixed probability of all ids before ``rank`` and of ``rank`` itself."""
        plain = self.plain.take(self.base[:k] + rank).astype(np.int64)
        start = plain >> 16
        below = start * self.w0 >> PLAIN_BITS
        size = (((plain & 0xFFFF) + start) * self.w0 >> PLAIN_BITS) - below
        small = rank.astype(np.int16)
        self.hit = self.guess == small
        past = self.guess < small
        below += self.w1 * past[0]
        below += self.w2 * past[1]
        size += self.w1 * self.hit[0]
        size += self.w2 * self.hit[1]
        return below, size

    def _coarse(self) -> np.ndarray:
        """For each block and step of order 0 the last id that begins at the step or before it."""
        starts = self.plain.reshape(self.n, self.width) >> 16
        listed = np.arange(self.width)[None, :] < self.sizes[:, None]
        keys = (self.lane[:, None] * (COARSE + 1) + (starts + (1 << STEP_BITS) - 1 >> STEP_BITS))[listed]
        begun = np.bincount(keys, minlength=self.n * (COARSE + 1)).reshape(self.n, COARSE + 1)
        return (np.cumsum(begun, axis=1) - 1).astype(np.int16).ravel()

    def find(self, value: np.ndarray, k: int) -> np.ndarray:
        """The ranks whose share of the mixture holds ``value``."""
        swap = self.guess[0] > self.guess[1]
        first, second = np.where(swap, self.w2, self.w1), np.where(swap, self.w1, self.w2)
        low, high = (f(self.guess[0], self.guess[1]).astype(np.int64) for f in (np.minimum, np.maximum))
        if self.coarse is None:
            self.coarse = self._coarse()
        plain = self.plain.take(self.base[:k] + np.stack((low, high))).astype(np.int64)
        start = plain >> 16
        end = ((plain & 0xFFFF) + start) * self.w0 >> PLAIN_BITS
        start = start * self.w0 >> PLAIN_BITS
        same = low == high
        start_low, end_low = start[0], end[0] + first + second * same
        start_high, end_high = start[1] + first * ~same, end[1] + first + second
        rest = value - first * (value >= end_low) - second * (value >= end_high)
        target = (((rest + 1) << PLAIN_BITS) - 1) // self.w0
        slot = self.lane[:k] * (COARSE + 1) + (np.minimum(target, (1 << PLAIN_BITS) - 1) >> STEP_BITS)
        found, most = self.coarse.take(slot).astype(np.int64), self.coarse.take(slot + 1).astype(np.int64)
        unsure = np.flatnonzero(found < most)
        if len(unsure):  # halve what is left between two steps of the table
            base, aim, least, most = self.base[unsure], target[unsure], found[unsure], most[unsure]
            while (least < most).any():
                middle = (least + most + 1) >> 1
                right = self.plain.take(base + middle) >> 16 <= aim
                least = np.where(right, middle, least)
                most = np.where(right, most, middle - 1)
            found[unsure] = least
        found = np.where((value >= start_low) & (value < end_low), low, found)
        return np.where((value >= start_high) & (value < end_high), high, found)

    def learn(self, rank: np.ndarray, k: int) -> None:
        """After ``share`` of the true ranks: hit rates, trust, successors and contexts."""
        self.rates[self.level] = self.rate + (self.hit * 65000 - self.rate >> RATE)
        trusted = self.trusted
        guess = np.where(trusted > 1, self.guess, rank.astype(np.int16))
        self.cells[self.at[:, :k]] = guess << 3 | np.where(self.hit, np.minimum(trusted + 1, TRUST - 1), trusted >> 1)
        self.before[:k] = self.last[:k]
        self.last[:k] = rank


def _rows(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as one row per block, and each block's length; only the last block may be shorter, it is filled up with its first id."""
    blocks = -(-len(flat) // BLOCK)
    rows = np.full((blocks, BLOCK), flat[BLOCK * (blocks - 1)], np.uint32)
    rows.ravel()[: len(flat)] = flat
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(flat) - BLOCK * (blocks - 1)
    return rows, lengths


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's rank among its block's distinct ids; number of distinct ids; all lists one after the other."""
    ranks, sizes, lists = np.empty(rows.shape, np.int16), np.empty(len(rows), np.int64), []
    short = rows.max() < 1 << 16
    for at in range(0, len(rows), SLAB):
        part = rows[at : at + SLAB].astype(np.uint16) if short else rows[at : at + SLAB]
        order = np.argsort(part, axis=1, kind="stable" if short else None)
        ids = np.take_along_axis(part, order, axis=1)
        new = np.ones(ids.shape, bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        np.put_along_axis(ranks[at : at + SLAB], order, np.cumsum(new, axis=1, dtype=np.int16) - np.int16(1), axis=1)
        sizes[at : at + SLAB] = new.sum(axis=1)
        lists.append(ids[new].astype(np.int64))
    return ranks, sizes, np.concatenate(lists)


def _counted(mixer: Mixer, done: np.ndarray) -> None:
    """Add the ids of all blocks since the last renewal; ``done`` has a column per id."""
    keys = (np.arange(len(done))[:, None] * mixer.width + done).ravel()
    mixer.counts += np.bincount(keys, minlength=mixer.counts.size).astype(np.int32).reshape(mixer.counts.shape) * np.int32(GAIN)
    mixer.renew()


def encode_blocks(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Checksums, sizes, lists, numbers of code words, and code words of all blocks of the ids."""
    rows, lengths = _rows(flat)
    ranks, sizes, lists = _ranked(rows)
    n = len(rows)
    mixer, since = Mixer(sizes), 0
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words, filled = np.zeros((n, BLOCK + 4), np.uint32), np.zeros(n, np.int64)
    steps = np.ascontiguousarray(ranks.T).astype(np.int64)
    for t in range(BLOCK):
        k = n if t < lengths[-1] else n - 1
        if k == 0:
            break
        if t in UPDATES:
            part = ranks[:, since:t].copy()
            if lengths[-1] < t:  # a shorter last block has ended: its counts no longer matter
                part[-1] = 0
            _counted(mixer, part)
            since = t
        mixer.look(k)
        rank = steps[t, :k]
        start, size = mixer.share(rank, k)
        unit = span[:k] >> np.uint64(TOTAL_BITS)
        low[:k] += unit * start.view(np.uint64)
        span[:k] = unit * size.view(np.uint64)
        small = np.flatnonzero(span[:k] < ONE32)
        if len(small):
            bottom, left = low[small], span[small]
            left = np.minimum(left, ONE32 - (bottom & LOW32))  # a span never reaches over the next code word
            words[small, filled[small]] = bottom >> np.uint64(32)
            filled[small] += 1
            low[small], span[small] = bottom << np.uint64(32), left << np.uint64(32)
        mixer.learn(rank, k)
    lane = np.arange(n)
    for _ in range(2):
        words[lane, filled] = low >> np.uint64(32)
        low <<= np.uint64(32)
        filled += 1
    checks = np.array([zlib.crc32(rows[i, : lengths[i]].tobytes()) for i in range(n)], np.uint32)
    return checks, sizes, lists, filled, words[np.arange(BLOCK + 4)[None, :] < filled[:, None]]


def decode_blocks(n_ids: int, checks: np.ndarray, sizes: np.ndarray, lists: np.ndarray, filled: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The ids again; raises if a block's checksum does not fit."""
    n = len(sizes)
    lengths = np.full(n, BLOCK)
    lengths[-1] = n_ids - BLOCK * (n - 1)
    words = np.zeros((n, int(filled.max()) + 2), np.uint32)
    words[np.arange(words.shape[1])[None, :] < filled[:, None]] = packed
    mixer, since = Mixer(sizes), 0
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = words[:, 0].astype(np.uint64) << np.uint64(32) | words[:, 1]
    read = np.full(n, 2)
    steps = np.zeros((BLOCK, n), np.int16)
    for t in range(BLOCK):
        k = n if t < lengths[-1] else n - 1
        if k == 0:
            break
        if t in UPDATES:
            part = steps[since:t].T.copy()
            if lengths[-1] < t:
                part[-1] = 0
            _counted(mixer, part)
            since = t
        mixer.look(k)
        unit = span[:k] >> np.uint64(TOTAL_BITS)
        value = np.minimum((code[:k] - low[:k]) // unit, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
        rank = mixer.find(value, k)
        start, size = mixer.share(rank, k)
        low[:k] += unit * start.view(np.uint64)
        span[:k] = unit * size.view(np.uint64)
        small = np.flatnonzero(span[:k] < ONE32)
        if len(small):
            bottom = low[small]
            left = np.minimum(span[small], ONE32 - (bottom & LOW32))
            low[small], span[small] = bottom << np.uint64(32), left << np.uint64(32)
            code[small] = code[small] << np.uint64(32) | words[small, np.minimum(read[small], words.shape[1] - 1)]
            read[small] += 1
        mixer.learn(rank, k)
        steps[t, :k] = rank
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rows = lists[np.minimum(starts[:, None] + steps.T, len(lists) - 1)].astype(np.uint32)
    for i in range(n):
        if zlib.crc32(rows[i, : lengths[i]].tobytes()) != checks[i]:
            raise ValueError(f"block {i} is damaged: its checksum does not fit")
    return rows.ravel()[:n_ids]


def _pack(numbers: np.ndarray, kind: str) -> bytes:
    data = zlib.compress(np.ascontiguousarray(numbers.astype(kind)).tobytes(), 1)
    return struct.pack("<I", len(data)) + data


def _unpack(data: bytes, at: int, kind: str) -> tuple[np.ndarray, int]:
    (size,) = struct.unpack_from("<I", data, at)
    return np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), kind), at + 4 + size


def write_chunk(doc_ids: list, lengths: list[int], flat: np.ndarray, phrases: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    """A frame of whole documents: their ids (null allowed), ids per document, and the coded blocks.

    ``flat`` holds the ids of all documents; with ``phrases`` (number of ids of each, all
    their ids) it holds numbers of phrases.
    """
    sizes_of, spelt = phrases if phrases else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    flat = np.concatenate((spelt, flat)) if phrases else flat
    nulls = np.array([d is None for d in doc_ids], bool)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    gaps = np.diff(numbers, prepend=np.int64(0))
    blocks = -(-len(flat) // BLOCK)
    out = [HEADER.pack(MAGIC, VERSION, len(doc_ids), len(flat), blocks, BLOCK, len(sizes_of)), _pack(nulls, "u1"), _pack(gaps, "<i8"), _pack(np.array(lengths), "<u4"), _pack(sizes_of, "<u4")]
    if blocks:
        checks, sizes, lists, filled, words = encode_blocks(flat)
        listed = np.diff(lists, prepend=0)
        listed[np.cumsum(sizes)[:-1]] = lists[np.cumsum(sizes)[:-1]]
        out += [_pack(checks, "<u4"), _pack(sizes, "<u4"), _pack(filled, "<u4"), _pack(listed, "<u4"), words.astype("<u4").tobytes()]
    return b"".join(out)


def _spelt(symbols: np.ndarray, sizes_of: np.ndarray) -> np.ndarray:
    """The ids of all documents from the phrases and their numbers."""
    starts = np.cumsum(sizes_of) - sizes_of
    numbers = symbols[int(sizes_of.sum()) :]
    sizes = sizes_of[numbers]
    first = starts[numbers] - (np.cumsum(sizes) - sizes)
    at = np.repeat(first, sizes)
    at += np.arange(len(at))
    return symbols[at]


def read_chunk(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc id, ids) of every document of a frame."""
    magic, version, n_docs, n_ids, blocks, block, n_phrases = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or block != BLOCK:
        raise ValueError("not a frame of token ids")
    nulls, at = _unpack(data, HEADER.size, "u1")
    gaps, at = _unpack(data, at, "<i8")
    lengths, at = _unpack(data, at, "<u4")
    sizes_of, at = _unpack(data, at, "<u4")
    flat = np.zeros(0, np.uint32)
    if blocks:
        checks, at = _unpack(data, at, "<u4")
        sizes, at = _unpack(data, at, "<u4")
        filled, at = _unpack(data, at, "<u4")
        listed, at = _unpack(data, at, "<u4")
        sizes = sizes.astype(np.int64)
        # each block's list starts anew: sum the gaps and take away what stood before the block
        sums = np.cumsum(listed.astype(np.int64))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums -= np.repeat(sums[starts] - listed[starts], sizes)
        flat = decode_blocks(n_ids, checks, sizes, sums, filled.astype(np.int64), np.frombuffer(data, "<u4", offset=at))
    if n_phrases:
        flat = _spelt(flat, sizes_of.astype(np.int64))
    ends = np.cumsum(lengths.astype(np.int64))
    for doc_id, null, end, length in zip(np.cumsum(gaps).tolist(), nulls.tolist(), ends.tolist(), lengths.tolist(), strict=True):
        yield (None if null else doc_id), flat[end - length : end]
