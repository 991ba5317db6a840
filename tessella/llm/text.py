"""Exact cutting of texts at spaces where byte-level BPE never looks across, and word splitting on bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

# A single space is a safe cut unless white space stands on both of its sides: a run of white space before a word
# gives its last space to the word, and nothing else looks across a space.
_BOTH_SIDES = re.compile(r"\s \s")
_SAFE_SPACE = re.compile(r"(?<!\s) | (?!\s)")
SEGMENT = 1 << 19


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of about `size` characters, each but the first beginning with the space it was cut at."""
    start = 0
    while len(text) - start > size:
        m = _SAFE_SPACE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def chunks(piece: str) -> list[str]:
    """Split at safe spaces. Every chunk but the first stands for the text with a space before it."""
    return _SAFE_SPACE.split(piece) if _BOTH_SIDES.search(piece) else piece.split(" ")


def byte_table(separators: bytes) -> bytes:
    """A bytes.translate table: A-Z to lower case, the given bytes to a space."""
    out = bytearray(range(256))
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    for b in separators:
        out[b] = 0x20
    return bytes(out)


ASCII_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SPACE_WORDS = byte_table(b"")


def words(text: str | None, table: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between the table's separators; null has none. bytes.split() cuts at 09-0D and 20."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []
