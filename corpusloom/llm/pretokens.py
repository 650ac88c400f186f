"""Cutting texts into pre-tokens the way the two public BPE vocabularies expect.

Texts made only of the usual Latin-1 characters take the standard `re` module
with plain classes, which agree there with the Unicode properties; any other
text takes the property classes of the `regex` module.
"""

from __future__ import annotations

import re

import regex

# Fixed value: Latin-1 bytes on which \w, \d and \s agree with \p{L}, \p{N} and White_Space.
_PLAIN = bytes(b for b in range(256) if not (0x1C <= b <= 0x1F or 0x80 <= b <= 0xA0 or b in b"\xb2\xb3\xb9\xbc\xbd\xbe"))


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


# The byte-level pattern (spaces belong to words) and the word pattern (spaces dropped, digits single).
_BYTE_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BYTE_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_level(text: str) -> list[str]:
    return (_BYTE_PLAIN if is_plain(text) else _BYTE_ANY).findall(text)


def plain_words(text: str) -> list[str]:
    """The words of a plain text that is in lower case."""
    return _WORD_PLAIN.findall(text)
