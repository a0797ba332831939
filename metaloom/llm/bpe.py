"""BPE encoding and decoding (operator 8) with cuts at byte pairs that no token holds."""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from metaloom.llm.bytepairs import ID_BITS, vocabulary
from metaloom.llm.common import Memo, text_pairs, text_rows
from metaloom.llm.token_counts import WHITE

#: Fixed value: the public pattern that picks the words of a normalised text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MERGED = (1 << ID_BITS) - 1
NEVER = 1 << 62
#: From so many symbols on a fragment's merges come from a heap.
LONG_FRAGMENT = 64
#: Fragments merged side by side are filled up to one of these widths.
WIDTHS = (4, 8, 12, 16, 24, 40, LONG_FRAGMENT)
UNRANKED = np.iinfo(np.int32).max
AT_ONCE = 250  # texts whose new words are merged together


class WordCoder:
    """Encoder and decoder for a word-end BPE vocabulary over lower-cased text.

    ``joined`` holds every pair of start symbols that stands side by side inside some token.
    A merge can only ever build tokens, so between two symbols whose pair is not in it no
    merge happens: the word is cut there and its fragments are encoded on their own.
    """

    def __init__(self, path: str) -> None:
        v = self.vocabulary = vocabulary(path)
        self.findall = regex.compile(WORDS.replace("\\s", WHITE)).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")").split
        names = {c: i for c, i in zip(v.byte_names, v.byte_ids, strict=True)}
        last = {c: i for c, i in zip(v.byte_names, v.last_byte_ids, strict=True)}
        self.joined: set[int] = set()
        for token in v.ids:
            body, ends = (token[: -len(v.suffix)], True) if v.suffix and token.endswith(v.suffix) and len(token) > len(v.suffix) else (token, False)
            symbols = [names[c] for c in body]
            if ends:
                symbols[-1] = last[body[-1]]
            self.joined.update(a << ID_BITS | b for a, b in zip(symbols, symbols[1:]))
        # the same for arrays: start symbols by byte, those that end a word from 256 on
        starts = v.byte_ids + v.last_byte_ids
        self.symbols = np.array(starts, np.int32)
        self.keys = np.array(sorted(v.merges), np.int64)
        values = np.array([v.merges[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.append(values >> ID_BITS, UNRANKED).astype(np.int32)
        self.merged = np.zeros(len(values), np.int32)
        self.merged[values >> ID_BITS] = values & MERGED
        self.start_joined = np.array([[a << ID_BITS | b in self.joined for b in starts] for a in starts])
        both = self.symbols.astype(np.int64)
        self.start_ranks = self._rank(np.repeat(both, len(both)), np.tile(both, len(both))).reshape(len(both), len(both))
        self.matches = Memo(self._match, 30_000)
        self.words = Memo(self._word, 70_000)

    def _fragment(self, symbols: list[int]) -> list[int]:
        """Merges of one fragment, the lowest rank first and the leftmost of equals."""
        if len(symbols) > LONG_FRAGMENT:
            return self._long_fragment(symbols)
        found = self.vocabulary.merges.get
        pairs = [found(a << ID_BITS | b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            symbols[i] = merged = best & MERGED
            del symbols[i + 1], pairs[i]
            if i:
                pairs[i - 1] = found(symbols[i - 1] << ID_BITS | merged, NEVER)
            if i < len(pairs):
                pairs[i] = found(merged << ID_BITS | symbols[i + 1], NEVER)
        return symbols

    def _long_fragment(self, symbols: list[int]) -> list[int]:
        """The same merges from a heap over linked symbols, in n log n steps."""
        found, n = self.vocabulary.merges.get, len(symbols)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        pairs = [found(a << ID_BITS | b, NEVER) for a, b in zip(symbols, symbols[1:])] + [NEVER]
        heap = [(value, i) for i, value in enumerate(pairs) if value != NEVER]
        heapq.heapify(heap)
        while heap:
            value, i = heapq.heappop(heap)
            if gone[i] or pairs[i] != value:
                continue
            symbols[i], j = value & MERGED, after[i]
            after[i], gone[j] = after[j], 1
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    pairs[left] = found(symbols[left] << ID_BITS | symbols[right], NEVER) if right < n else NEVER
                    if pairs[left] != NEVER:
                        heapq.heappush(heap, (pairs[left], left))
        return [s for s, dead in zip(symbols, gone) if not dead]

    def cuts(self, match: str) -> list[list[int]]:
        """The fragments of one word, as start symbols."""
        v = self.vocabulary
        raw = match.encode("utf-8", "surrogatepass")
        symbols = [v.byte_ids[b] for b in raw]
        symbols[-1] = v.last_byte_ids[raw[-1]]
        out, start = [], 0
        for i in range(1, len(symbols)):
            if symbols[i - 1] << ID_BITS | symbols[i] not in self.joined:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def _match(self, match: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of one match of the pattern."""
        return self._packed([i for fragment in self.cuts(match) for i in self._fragment(fragment)])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, UNRANKED if there is none."""
        pairs = left.astype(np.int64) << ID_BITS | right
        at = np.searchsorted(self.keys, pairs)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != pairs] = len(self.keys)
        return self.ranks[at]

    def _side_by_side(self, rows: np.ndarray, ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of many fragments, one of each at a time: symbols left, and how many.

        ``rows`` has a fragment per row, filled up behind its size; ``ranks`` those of its neighbours.
        """
        out, left, owner = rows.copy(), sizes.copy(), np.arange(len(rows))
        places = np.arange(rows.shape[1] - 1)[None, :]
        while True:
            best = ranks.argmin(axis=1)
            lane = np.arange(len(best))
            value = ranks[lane, best]
            go = value != UNRANKED
            if not go.all():
                out[owner[~go]] = rows[~go]
                owner, rows, ranks, best, value = owner[go], rows[go], ranks[go], best[go], value[go]
                lane = lane[: len(best)]
            if not len(best):
                return out, left
            left[owner] -= 1
            past = places >= best[:, None]
            rows[:, 1:-1] = np.where(past[:, :-1], rows[:, 2:], rows[:, 1:-1])
            rows[lane, best] = merged = self.merged[value]
            ranks[:, :-1] = np.where(past[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = UNRANKED
            after = np.flatnonzero(best + 1 < left[owner])
            ranks[lane, best] = UNRANKED
            ranks[after, best[after]] = self._rank(merged[after], rows[after, best[after] + 1])
            before = np.flatnonzero(best)
            ranks[before, best[before] - 1] = self._rank(rows[before, best[before] - 1], merged[before])

    def together(self, matches: list[str]) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of many matches of the pattern, none empty: all their fragments are merged side by side."""
        raw = [match.encode("utf-8", "surrogatepass") for match in matches]
        letters = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(list(map(len, raw)))
        letters[ends - 1] += 256
        opens = np.ones(len(letters), bool)
        opens[1:] = ~self.start_joined[letters[:-1], letters[1:]]
        opens[ends[:-1]] = True
        starts = np.flatnonzero(opens)
        sizes = np.diff(starts, append=len(letters))
        symbols, kept = self.symbols[letters], np.ones(len(letters), bool)
        for narrower, width in zip((1, *WIDTHS), WIDTHS):
            chosen = np.flatnonzero((sizes > narrower) & (sizes <= width))
            if not len(chosen):
                continue
            first, size = starts[chosen], sizes[chosen]
            places = np.arange(width)[None, :]
            at = np.minimum(first[:, None] + places, len(letters) - 1)
            ranks = np.where(places[:, 1:] < size[:, None], self.start_ranks[letters[at[:, :-1]], letters[at[:, 1:]]], UNRANKED)
            done, left = self._side_by_side(symbols[at], ranks, size)
            whole = places < size[:, None]
            symbols[at[whole]], kept[at[whole]] = done[whole], (places < left[:, None])[whole]
        for i in np.flatnonzero(sizes > LONG_FRAGMENT).tolist():
            done = self._fragment(symbols[starts[i] : starts[i] + sizes[i]].tolist())
            symbols[starts[i] : starts[i] + len(done)] = done
            kept[starts[i] + len(done) : starts[i] + sizes[i]] = False
        stops = np.cumsum(kept)[ends - 1].tolist()
        ids = symbols[kept].astype("<u4")
        data, names = ids.tobytes(), list(map(self.vocabulary.names.__getitem__, ids.tolist()))
        return [(data[4 * i : 4 * j], " ".join(names[i:j])) for i, j in zip([0, *stops], stops)]

    def prepare(self, texts: list[str]) -> None:
        """Put the words of the texts into the caches; matches that are new are merged together."""
        words: set[str] = set()
        for text in texts:
            sections = self.cut(text) if any(s in text for s in self.vocabulary.special) else [text]
            words.update(word for section in sections if section not in self.vocabulary.special for word in self.normalised(section).split())
        new = {word: self.findall(word) for word in self.words.fresh(words)}
        missing = list(self.matches.fresh({match for found in new.values() for match in found}))
        done = dict(zip(missing, self.together(missing))) if missing else {}
        for word, found in new.items():
            self.words.keep(word, self._joined([done.get(match) or self.matches[match] for match in found]))
        for match, coded in done.items():
            self.matches.keep(match, coded)

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join(map(self.vocabulary.names.__getitem__, ids))

    def _word(self, word: str) -> tuple[bytes, str]:
        """The same for what stands between two white spaces."""
        return self._joined([self.matches[match] for match in self.findall(word)])

    @staticmethod
    def _joined(found: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), " ".join([f[1] for f in found]))

    @staticmethod
    def normalised(text: str) -> str:
        """NFC and lower case, letter by letter (no final form of sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        text = self.normalised(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to the pattern
            return list(map(self.matches.__getitem__, self.findall(text)))
        return list(map(self.words.__getitem__, text.split()))

    def code(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text, packed, and their decoded text."""
        if any(s in text for s in self.vocabulary.special):
            parts = []
            for section in self.cut(text):
                parts += [self._packed([self.vocabulary.special[section]])] if section in self.vocabulary.special else self._plain(section)
        else:
            parts = self._plain(text)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.vocabulary.names.__getitem__, array("I", packed)))


@functools.cache
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids of every whole text as packed little-endian unsigned 32-bit integers, and the text they decode to.

    ``path`` names a tokenizers JSON file with a BPE model with word ends (NFC, lower case,
    byte level). Words are cut where two neighbouring byte symbols never stand side by side
    inside any token; the fragments of a few hundred texts are encoded independently, side by
    side in arrays, and concatenated. Decoding
    looks up each id and joins the tokens with blanks, special tokens kept. Fragments and
    words are kept in bounded caches per Python worker. Null texts count as empty (no ids,
    empty text); repeated rows and null ids are returned row by row; an empty table gives
    an empty result; other columns are ignored. Nothing is shuffled.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for ids, texts in text_pairs(batches):
            for start in range(0, len(ids), AT_ONCE):
                coder.prepare(texts[start : start + AT_ONCE])
                done = list(map(coder.code, texts[start : start + AT_ONCE]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[start : start + AT_ONCE], pa.int64()), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(coded, "doc_id long, ids binary, decoded string")
