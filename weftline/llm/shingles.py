"""Word shingles as arrays of 64-bit hashes, and b-bit MinHash signatures of them, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of a shingle, and the hash functions, bands and bits kept of a signature.
WORDS, HASHES, BANDS, BITS = 5, 128, 32, 4

_rng = np.random.default_rng(20240229)
_PLACES = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_FOLD = _rng.integers(1, 1 << 63, HASHES // BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit hashes of words (bytes); remembers at most LIMIT words at a time."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        seen = self.seen
        try:
            got = [seen[w] for w in words]
        except KeyError:
            if len(seen) > self.LIMIT:
                seen.clear()
            for w in set(words):
                if w not in seen:
                    seen[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            got = [seen[w] for w in words]
        return np.array(got, np.uint64)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes; with fewer than WORDS words one for the whole."""
    if not len(h):
        return h
    if len(h) < WORDS:
        return mix(np.array([np.sum(h * _PLACES[: len(h)], dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    n = len(h) - WORDS + 1
    s = h[:n] * _PLACES[0]
    for i in range(1, WORDS):
        s += h[i : n + i] * _PLACES[i]
    return np.unique(mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    """The HASHES minima over a set's hashes, 32 bits each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    step = 2048
    for i in range(0, len(x), step):
        v = x[None, i : i + step] * _MUL[:, None]
        v += _ADD[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(low, v.min(axis=1), out=low)
    return low


def bands(m: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of minima; the band's number is part of it."""
    rows = m.reshape(BANDS, -1).astype(np.uint64)
    return mix((rows * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, packed in 64-bit words."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for the set; none for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
