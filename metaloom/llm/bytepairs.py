"""Vocabularies of byte-pair encoders: merge tables, byte symbols and independent pieces of a text."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

#: White space other than blank and line feed, as str.isspace() knows it.
OTHER_SPACES = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　") + tuple(map(chr, range(0x2000, 0x200B)))
RUNS = ("  ", " \n", "\n ", "\n\n")
ID_BITS = 20


class Vocabulary:
    """Merge table and byte symbols of a tokenizers JSON file with a byte-level BPE model.

    ``merges`` maps ``left id << ID_BITS | right id`` to ``rank << ID_BITS | merged id``.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merged = left + right
            self.merges[self.ids[left] << ID_BITS | self.ids[right]] = rank << ID_BITS | self.ids[merged]
        self.byte_names = byte_alphabet()
        self.byte_ids = [self.ids[c] for c in self.byte_names]
        self.last_byte_ids = [self.ids[c + self.suffix] for c in self.byte_names]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free code point from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker."""
    return Vocabulary(path)


def blank_separated(text: str) -> list[list[str]] | None:
    """Lines of words if the text's only white space is single blanks and line feeds between words, else None.

    The byte-level pattern then never joins a word with what stands before its blank or line
    feed, so `` word`` and the first word of a line can be split and merged on their own.
    """
    return [line.split(" ") for line in text.split("\n")] if only_single_blanks(text) else None


def only_single_blanks(text: str) -> bool:
    """Single blanks and line feeds between words are the text's only white space."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(s in text for s in RUNS) and not any(c in text for c in OTHER_SPACES)


def over_pieces(text: str, first: Callable, rest: Callable, split: Callable, one: Callable, newline) -> list:
    """A value for each independent piece of a text, in order.

    ``first``/``rest`` take a line's first and later words, ``one`` a pattern match of an irregular text.
    """
    if not text:
        return []
    lines = blank_separated(text)
    if lines is None:
        return list(map(one, split(text)))
    out = []
    for words in lines:
        out.append(newline)
        out.append(first(words[0]))
        out.extend(map(rest, words[1:]))
    return out[1:]
