"""Token counts (operator 9): heap-and-linked-list byte-pair merging without token ids."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.bytepairs import ID_BITS, over_pieces, vocabulary
from metaloom.llm.common import Memo, text_pairs, text_rows

#: Fixed value: the public pattern that cuts text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1
MERGED = (1 << ID_BITS) - 1


def merged_length(symbols: list[int], merges: dict[int, int]) -> int:
    """Number of symbols left after all merges: pairs leave a heap by rank, then place; neighbours are linked lists.

    An entry is stale if its pair no longer stands at its place; it is skipped when popped.
    """
    n = len(symbols)
    if n < 2:
        return n
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for place in range(n - 1):
        found = merges.get(symbols[place] << ID_BITS | symbols[place + 1])
        if found is not None:
            heap.append((found >> ID_BITS) << PLACE_BITS | place)
    heapq.heapify(heap)
    left = n
    while heap:
        entry = heapq.heappop(heap)
        place = entry & PLACE
        other = following[place]
        if symbols[place] < 0 or other >= n:
            continue
        found = merges.get(symbols[place] << ID_BITS | symbols[other])
        if found is None or found >> ID_BITS != entry >> PLACE_BITS:
            continue
        left -= 1
        symbols[place], symbols[other] = found & MERGED, -1
        after, previous = following[other], before[place]
        following[place] = after
        if after < n:
            before[after] = place
            found = merges.get(symbols[place] << ID_BITS | symbols[after])
            if found is not None:
                heapq.heappush(heap, (found >> ID_BITS) << PLACE_BITS | place)
        if previous >= 0:
            found = merges.get(symbols[previous] << ID_BITS | symbols[place])
            if found is not None:
                heapq.heappush(heap, (found >> ID_BITS) << PLACE_BITS | previous)
    return left


class Counter:
    """Counts the tokens of whole texts for one byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.findall = regex.compile(PATTERN.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")").split
        self.matches = Memo(self._match)
        self.first = Memo(lambda word: sum(map(self.matches.__getitem__, self.findall(word))))
        self.rest = Memo(lambda word: sum(map(self.matches.__getitem__, self.findall(" " + word))))

    def _match(self, match: str) -> int:
        ids = self.vocabulary.byte_ids
        return merged_length([ids[b] for b in match.encode("utf-8", "surrogatepass")], self.vocabulary.merges)

    def _plain(self, text: str) -> int:
        return sum(over_pieces(text, self.first.__getitem__, self.rest.__getitem__, self.findall, self.matches.__getitem__, 1))

    def count(self, text: str) -> int:
        if not any(s in text for s in self.vocabulary.special):
            return self._plain(text)
        return sum(1 if s in self.vocabulary.special else self._plain(s) for s in self.cut(text))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` names a tokenizers JSON file with a byte-level BPE model. A text is cut by the
    public pattern; each distinct cut is merged with a heap of ranked pairs over a linked
    list, and its count is the number of bytes minus the number of merges: no ids are made.
    Special strings inside a text count one token, as the library's default has it. Counts
    of cuts are kept in a bounded cache per Python worker. Null texts count as empty (0
    tokens); repeated rows and null ids are returned row by row; an empty table gives an
    empty result; other columns are ignored. Nothing is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for ids, texts in text_pairs(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(list(map(count, texts)), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = text_rows(docs, id_col, text_col).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
