"""Words as the corpus operators count them: A-Z lower-cased, runs of ASCII letters and digits and of all non-ASCII characters."""

from __future__ import annotations

import zlib

import numpy as np

#: Every other ASCII byte to a space, A-Z to a-z; bytes of non-ASCII characters stay.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(TO_WORDS).split()


class WordHashes(dict):
    """32-bit hashes by word; only a bounded number is kept."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word)
        if len(word) <= 32:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def array(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint32, count=len(found))
