"""Anchors of long windows: the place of the least hash of a short run in each window of a text's bytes or words.

Equal windows have their anchor at the same offset, so windows can be grouped by the hash at their anchor. The
windows of one anchor start next to each other; the bytes that they cover are the anchor's segment.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .induced import window_hashes

_PLACE = 30


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    y = y.reshape(-1, width)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram_size: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of length bytes, or words' hashes, in texts laid end to end (ends: where they end).

    Returns each anchor's text, first and last window start (within the text), offset of the anchor in the first
    window, and the 64-bit hash at the anchor.
    """
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none, none, none.astype(np.uint64)
    gram = window_hashes(data, gram_size)
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0x9E3779B97F4A7C15)
    key = (gram >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(gram), dtype=np.uint64)
    least = window_minima(key, length - gram_size + 1)
    del key
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    del least
    text = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length + 1))[:-1]]), np.maximum(0, sizes - length + 1))
    at = base + np.arange(len(text))
    place = place[at]
    first = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    f = np.flatnonzero(first)
    last = np.append(f[1:], len(text)) - 1
    return text[f], at[f] - starts[text[f]], at[last] - starts[text[f]], place[f] - at[f], gram[place[f]]


def digest64(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
