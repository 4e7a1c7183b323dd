"""Hashes of words and of runs of words, for many texts at once, by numpy.

A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of prefix sums, then mixed; a run's
hash combines its words' hashes by position. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other bytes than space and 9 to 13) of all texts, and each text's first word's index, with the end."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:])
    up, down = _power(len(raw))
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
    hashes = mixed((sums[ends] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, at)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each position on; one for each position at which so many stand."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(width):
        factor = factor * int(_BASE) % 2**64
        out += hashes[j : j + n] * np.uint64(factor)
    return mixed(out)
