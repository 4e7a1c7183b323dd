"""Cutting text where a byte-level pre-tokenizer always cuts, so that the parts can be encoded singly and remembered.

A piece of the public pattern contains a space only as its first character, or is white space alone. So it cuts before
a space that no other white space touches, and around a line feed that none touches. It also cuts between a letter or
digit and a full stop or comma. A text in which white space touches white space, or in which another character
than a letter or digit stands before a full stop or comma, is cut at spaces alone, or not at all if two spaces touch.
"""

from __future__ import annotations

import re

_odd = re.compile(r"\s\s|[\W_][.,]|\x01")


def chunks(text: str) -> list[str]:
    """The text's chunks in order; joined, they give the text again (some may be empty)."""
    if not text:
        return []
    if not _odd.search(text):
        return text.replace(" ", "\x01 ").replace(".", "\x01.").replace(",", "\x01,").replace("\n", "\x01\n\x01").split("\x01")
    if "  " in text or "\x01" in text:
        return [text]
    return text.replace(" ", "\x01 ").split("\x01")


class Remembered(dict):
    """Chunk -> encoded bytes, for one Python worker; keeps at most about `limit` entries of at most 64 characters."""

    def __init__(self, encode_many, limit: int = 250_000, whole=None):
        """whole: a pattern; texts in which it is found are not cut."""
        self.encode_many, self.limit, self.whole = encode_many, limit, whole

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[x] if self.whole and self.whole.search(x) else chunks(x) for x in texts]
        new = [c for c in set().union(*cut) if c not in self]
        self.update(zip(new, self.encode_many(new), strict=True))
        out = [b"".join(map(self.__getitem__, x)) for x in cut]
        full = len(self) > self.limit
        for c in new:
            if full or len(c) > 64:
                del self[c]
        return out
