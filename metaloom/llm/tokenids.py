"""Writing and reading token-id files (operator 6) with Spark."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.llm.bytepairs import byte_alphabet, only_single_blanks
from metaloom.llm.common import Memo, text_pairs, text_rows
from metaloom.llm.tokenfiles import read_chunk, write_chunk
from metaloom.scale import cut_lineage, maybe_broadcast

CHUNK = 1 << 23  # ids that close a chunk
AT_ONCE = 4000  # texts cut together
#: Kinds of bytes between which the public pattern always cuts; 0 for all others.
KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (2, b"0123456789"), (3, b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")):
    KINDS[list(_bytes)] = _kind
#: Letters of two bytes whose first byte tells so (but for the signs of times and division).
LETTER_LEADS = np.zeros(256, bool)
LETTER_LEADS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ſЀ-ѿ]+").fullmatch


class LibraryEncoder:
    """Ids of the pieces of texts from the tokenizers library, which sees each distinct piece once while it is cached.

    In a text whose only white space is single blanks and line feeds, the byte-level pattern
    cuts before every blank and line feed and between letters, digits and signs, so these
    pieces can be encoded on their own; any other text is one piece and goes to the library
    whole. A piece of letters is one match of the pattern and goes to the library's model.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.printable = dict(enumerate(byte_alphabet()))
        self.known = Memo(self._piece, 600_000)

    def _piece(self, piece: str) -> bytes:
        if LETTERS(piece):
            symbols = piece.replace(" ", self.printable[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.printable)
            return array("I", [token.id for token in self.merge(symbols)]).tobytes()
        return np.array(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts, and how many of them each text has."""
        column = pa.array(texts, pa.large_string())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64, len(texts) + 1)
        letters = np.frombuffer(data, np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8)
        kinds = KINDS[letters]
        pairs = np.flatnonzero(LETTER_LEADS[letters[:-1]])
        pairs = pairs[(letters[pairs] != 0xC3) | (letters[pairs + 1] & 0xDF != 0x97)]
        kinds[pairs] = kinds[pairs + 1] = 1
        opens = letters == ord(" ")
        opens[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
        feeds = np.flatnonzero(letters == ord("\n"))
        opens[feeds] = True
        opens[feeds[feeds + 1 < len(letters)] + 1] = True
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or not only_single_blanks(text):
                opens[ends[i] : ends[i + 1]] = False
        opens[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.append(np.flatnonzero(opens), len(letters))
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), data if data is not None else pa.py_buffer(b""))
        return pieces.dictionary_encode(), np.diff(np.searchsorted(starts, ends))


class Frame:
    """Documents of a chunk as numbers of phrases, in order of their first appearance, and each phrase's ids; phrase 0 is the end of a document."""

    def __init__(self, encoder: LibraryEncoder, end_id: int) -> None:
        self.encoder, self.numbers, self.parts = encoder, {}, [np.array([end_id], "<u4").tobytes()]
        self.sizes, self.doc_ids, self.lengths, self.sequence, self.held = np.ones(1, np.int64), [], [], [], 0

    def add(self, doc_ids: list, texts: list[str]) -> None:
        pieces, per_text = self.encoder.cut(texts)
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.numbers]
        self.numbers.update(zip(new, range(len(self.parts), len(self.parts) + len(new))))
        ids = list(map(self.encoder.known.__getitem__, new))
        self.parts += ids
        self.sizes = np.append(self.sizes, np.array(list(map(len, ids)), np.int64) // 4)
        numbers = np.array(list(map(self.numbers.__getitem__, words)), np.uint32)
        run = numbers[pieces.indices.to_numpy(zero_copy_only=False)] if words else numbers
        ends = np.cumsum(per_text)
        reached = np.append(0, np.cumsum(self.sizes[run]))[ends]
        lengths = np.diff(reached, prepend=0) + 1
        self.sequence.append(np.insert(run, ends, 0))
        self.doc_ids += doc_ids
        self.lengths += lengths.tolist()
        self.held += int(lengths.sum())

    def payload(self) -> bytes:
        return write_chunk(self.doc_ids, self.lengths, np.concatenate(self.sequence), (self.sizes, np.frombuffer(b"".join(self.parts), "<u4")))


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, target: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending doc_id order to the new folder ``target``.

    ``path`` names a file of the tokenizers library. Documents are range-partitioned by id
    (ties by text, null ids first) and packed into frames of about eight million ids in whole
    documents; each frame is a row (part, seq, n_docs, n_ids, payload) of a Parquet file.
    Spark's writer commits a task's file once, so a lost executor leaves no torn file. Null
    texts count as empty and keep their end id; an empty table gives a folder without rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, encoder = TaskContext.get().partitionId(), 0, library_encoder(path)
        frame = Frame(encoder, end_id)

        def row() -> pa.RecordBatch:
            values = (part, seq, len(frame.doc_ids), frame.held, frame.payload())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_docs", "n_ids", "payload"])

        for doc_ids, texts in text_pairs(batches):
            for at in range(0, len(texts), AT_ONCE):
                frame.add(doc_ids[at : at + AT_ONCE], texts[at : at + AT_ONCE])
                if frame.held >= CHUNK:
                    yield row()
                    frame, seq = Frame(encoder, end_id), seq + 1
        if frame.doc_ids:
            yield row()

    placed = text_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(packed, "part int, seq int, n_docs int, n_ids long, payload binary").write.mode("errorifexists").parquet(target)


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: ids as packed little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Frames are decoded where they are
    read; a damaged block raises. Only the number of ids per frame is summed across tasks.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, before = [], 0
                for doc_id, ids in read_chunk(payload):
                    rows.append((part, seq, doc_id, before, ids.astype("<u4").tobytes()))
                    before += len(ids)
                for at in range(0, len(rows), 1000):
                    columns = zip(*rows[at : at + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "doc_id", "before", "ids"])

    files = spark.read.schema("part int, seq int, n_docs int, n_ids long, payload binary").parquet(target)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    frames = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("seq_start")).join(maybe_broadcast(parts), "part")
    frames = cut_lineage(frames)  # a row per frame
    docs = files.select("part", "seq", "payload").mapInArrow(unpacked, "part int, seq int, doc_id long, before long, ids binary")
    return docs.join(maybe_broadcast(frames), ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("before")).alias("start"), "ids")
