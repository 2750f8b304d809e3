"""Words of many texts at once, as hashes, with numpy: no object for a word is ever made.

Words are what ASCII white space parts, A-Z lower-cased. A word's hash is 128 bits in two numbers of 64, from its
bytes eight at a time and its length; words of up to eight bytes and one length never share either number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_FRONT, _BACK = 8, 8  # spaces around the texts, so that eight bytes may be read at any place of a word
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _mixed(h: np.ndarray, x: np.ndarray, k: np.uint64, shift: int) -> np.ndarray:
    """h, changed in place, with x mixed in."""
    h ^= x
    h *= k
    h ^= h >> np.uint64(shift)
    return h


class TextWords:
    """The words of texts laid end to end.

    data: the bytes (A-Z lower-cased if asked for) with white space between texts; begin, end: each word's place in
    it; text: each word's text; h1: the first number of its hash; starts: the first word of each text; offsets: where
    each text begins in data.
    """

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        raw = b" " * _FRONT + b"\n".join(texts) + b" " * _BACK
        self.data = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        space = (self.data == 32) | ((self.data - np.uint8(9)) < 5)
        edge = np.flatnonzero(space[:-1] != space[1:]) + 1
        self.begin, self.end = edge[0::2], edge[1::2]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = _FRONT + np.cumsum(sizes + 1) - sizes - 1
        self.starts = np.searchsorted(self.begin, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.append(self.starts, len(self.begin))))
        self.sizes = self.end - self.begin
        self.h1 = self._hash(slice(None), np.uint64(0), _K1, _K2, 32)

    def second(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The second number of the hashes of some words."""
        return self._hash(at, _K1, _K2, _K1, 29)

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, as one number."""
        every = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        return every[at]

    def _hash(self, which: np.ndarray | slice, seed: np.uint64, k: np.uint64, other: np.uint64, shift: int) -> np.ndarray:
        begin, n = self.begin[which], self.sizes[which]
        size = n.astype(np.uint64)
        x = self.eight(begin)
        x &= _MASK.take(np.minimum(n, 8))
        h = size * other
        h += seed
        _mixed(h, x, k, shift)
        at, left = np.flatnonzero(n > 8), 8
        while len(at):
            x = self.eight(begin[at] + left) & _MASK.take(np.minimum(n[at] - left, 8))
            h[at] = _mixed(h[at], x, k, shift)
            left += 8
            at = at[n[at] > left]
        return _mixed(h, size, other, shift + 2)

    def last(self, *lengths: int) -> Iterator[np.ndarray]:
        """For each n of lengths (up to eight) the last n bytes of each word as a number; shorter words get zeros."""
        tail = self.eight(self.end - 8)
        for n in lengths:
            yield tail >> (8 * (8 - np.minimum(self.sizes, n))).astype(np.uint64)


def _of_no_bytes(seed: np.uint64, k: np.uint64, other: np.uint64, shift: int) -> int:
    none = np.zeros(1, np.uint64)
    return int(_mixed(_mixed(none + seed, none, k, shift), none, other, shift + 2)[0])


#: The hash of an end mark: that of a word of no bytes.
END1, END2 = _of_no_bytes(np.uint64(0), _K1, _K2, 32), _of_no_bytes(_K1, _K2, _K1, 29)
