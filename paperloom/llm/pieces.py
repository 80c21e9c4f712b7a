"""Cutting texts into the pieces a tokenizer encodes one by one.

The cut is done with ``re`` where a text holds only characters on which ``re``'s
classes are those of the tokenizer's own pattern; any other text is left to the
tokenizers library as a whole.
"""

from __future__ import annotations

import re

#: Characters on which letters, digits and white space mean the same to ``re`` and to the tokenizers library:
#: ASCII without rare controls, Latin-1 and Latin Extended-A without superscripts, fractions, odd spaces and dotted I,
#: and common punctuation.
UNSAFE = re.compile("[^\t\n\r -~¡-±´-¸º»¿-įı-ňŊ-ſ‐-―‘-„†-•…€]")
#: Texts that may hold the string of a special token.
SPECIAL = "<|"

BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def plain(text: str) -> bool:
    """Whether ``re`` cuts ``text`` as the library does."""
    return SPECIAL not in text and (text.isascii() and text.isprintable() or UNSAFE.search(text) is None)


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memo(dict):
    """Piece -> value, bounded: when full, what it holds is kept aside once more and dropped unless asked for.

    Long pieces aren't kept, so a worker's memory does not grow with its input.
    """

    def __init__(self, make, limit: int = 150_000, longest: int = 200):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, piece: str):
        if len(piece) > self.longest:
            return self.make(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value
