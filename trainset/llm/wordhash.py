"""64-bit hashes of words and of runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

KNOWN = 1 << 20  # words remembered at a time
SEGMENT = 1 << 20  # bytes of a text that are split at a time
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = value = xxh64_intdigest(word) or 1
        return value


class Hashes:
    """Hashes of words, remembered; ``fixed`` words have given hashes, no other hash is 0."""

    def __init__(self, fixed: dict[bytes, int] | None = None) -> None:
        self.fixed = fixed or {}
        self.known = _Known(self.fixed)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known = _Known(self.fixed)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of runs made of the runs ``left`` and one more word."""
    h = (left ^ (left >> np.uint64(29))) * _P + right * _Q
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(31))


def segments(text: bytes, gap: re.Pattern[bytes]) -> Iterator[bytes]:
    """The text in pieces that end where ``gap`` matches, so that no word is cut."""
    at = 0
    while at < len(text):
        found = gap.search(text, min(at + SEGMENT, len(text)))
        end = max(found.start() if found else len(text), at + 1)
        yield text[at:end]
        at = end
