"""Words of ASCII letters, digits and everything beyond ASCII, as UTF-8 bytes.

A word is a maximal run of bytes that are ASCII letters, digits or part of a
character beyond ASCII; only A-Z are lower-cased.  Every separator is an ASCII
byte, so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations


def _fold(c: int) -> int:
    if 0x41 <= c <= 0x5A:
        return c + 0x20
    return c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20


FOLD = bytes(_fold(c) for c in range(256))


def folded(text: bytes | None) -> bytes:
    """The text with A-Z lowered and every separator as one space; null is empty."""
    return (text or b"").translate(FOLD)


def words(text: bytes | None) -> list[bytes]:
    return folded(text).split()
