"""Word shingles as 64-bit hashes, MinHash signatures and one-bit sketches, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers before it starts anew.
_REMEMBERED = 500_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose products are in memory at once.
_ROWS = 2_048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `width` words; of the whole text if it has fewer words; none without words.

    A-Z are lower-cased and words are runs of `[^\\x20\\x09-\\x0D]`, which is how bytes.lower() and bytes.split() work.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    x = np.full(n, np.uint64(min(width, len(h))))
    for i in range(min(width, len(h))):
        x = _mix(x * _STEP + h[i : i + n])
    return np.unique(x)


def multipliers(n: int, seed: int = 2_027) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def signature(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """MinHash: the least of each hash function over the set, as 32 bits."""
    out = np.full(len(by), np.uint64(2**64 - 1))
    for i in range(0, len(x), _ROWS):
        np.minimum(out, (x[i : i + _ROWS, None] * by).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bits(signatures: np.ndarray) -> np.ndarray:
    """(n, hashes / 64) words of one mixed bit a hash: two sets agree in a bit with probability (1 + similarity) / 2."""
    mixed = _mix(signatures.astype(np.uint64) * _STEP) & np.uint64(1)
    return np.packbits(mixed.astype(np.uint8), axis=1).view(np.uint64)


def set_key(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    a = xxhash.xxh3_128_digest(x.tobytes())
    return int.from_bytes(a[:8], "little", signed=True), int.from_bytes(a[8:], "little", signed=True)
