"""Hashed word shingles of whole texts, and signatures over them, with NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Bytes hashed at once; a longer text is cut between words.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    size = max(1 << 16, 1 << n.bit_length())
    if size not in _POWERS:
        if size > 2 * CHUNK:
            _POWERS.clear()
        made = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(made)
    return _POWERS[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased), in order."""
    parts, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        b = _LOW[np.frombuffer(raw, np.uint8, end - at, at)]
        blank = np.concatenate([[True], _BLANK[b], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edge[::2], edge[1::2]
        up, down = _powers(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=total[1:])
        parts.append(mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles; of the whole sequence, if it is shorter; none without words."""
    words = word_hashes((text or "").encode("utf-8", "replace"))
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out + words[i:len(words) - width + 1 + i] + np.uint64(width))
    return np.unique(out)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Signer:
    """The least value of a set under each of `slots` hash functions, scrambled; callers keep as many bits as they need."""

    def __init__(self, slots: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 31, slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, slots, dtype=np.uint32)
        self.rows = max(1, (1 << 16) // slots)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint32).max, np.uint32)
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), self.rows):
            some = high[at:at + self.rows, None] * self.factors
            some += self.shifts
            np.minimum(least, some.min(axis=0), out=least)
        return mixed(least.astype(np.uint64) + np.uint64(1))
