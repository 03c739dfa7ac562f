"""Cutting a text where no token of a byte-level BPE tokenizer can span.

Both tokenizers here split a text by one pattern first: a run of letters,
digits or other marks, each with at most one space before it, or white space.
A space between two characters that are not white space therefore always begins
a new match, and a line feed between two such characters is a match of its own.
A text can be cut at these places and each piece encoded on its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: White space but single spaces and line feeds; a NUL, as it serves as a mark.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\0"]
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_SINGLE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def plain(text: str) -> bool:
    """Whether all white space is single spaces or line feeds inside the text."""
    return not (
        text[:1].isspace()
        or text[-1:].isspace()
        or any(x in text for x in _PAIRS)
        or any(x in text for x in _ODD)
    )


def pieces(text: str) -> list[str]:
    """The text in pieces, cut only where every tokenizer of the kind cuts it."""
    if not text:
        return []
    if plain(text):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return _SINGLE.split(text)


class Memo(dict):
    """Encoded pieces by text, in two generations of bounded size.

    A full generation becomes the old one; what is asked for again moves back.
    """

    def __init__(self, encode: Callable[[str], bytes], entries: int = 250_000, longest: int = 64):
        super().__init__()
        self.encode, self.entries, self.longest = encode, entries, longest
        self.old: dict[str, bytes] = {}

    def room(self, count: int = 1) -> None:
        """Make room for new entries."""
        if len(self) + count > self.entries:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= self.longest:
            self.room()
            self[piece] = ids
        return ids


def portions(texts: Iterable[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
