"""Suffix sorting by induced sorting with disk-backed queues, vectorised by runs of one symbol.

The suffix order of a text follows from the order of its S*-suffixes: scanned in order, every suffix induces the one
that starts a place earlier. What is induced waits in a queue of its first symbol; since symbols are served in order,
the queues together are a monotone priority queue keyed by (symbol, order of arrival). An entry carries its place, the
symbols before it (eight bytes of them, so the text is read once in eight steps) and the length of its common prefix
with the entry before it in its queue: one more than the least common prefix scanned since that entry was induced.
Runs beyond the memory allowed go to a temporary file and are read back when their symbol is served, and the suffixes
come out as a stream, so a sort holds its queues' budget, the text, which may be a file mapped into memory, and what
is proportional to the S*-suffixes.

S*-substrings are sorted by the same induction and named; if names repeat, the text of names is sorted recursively.
A text of names that is short or has few repeated ones is sorted by doubling ranks instead. Common prefixes counted
in names become common prefixes of the text at each return.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np

#: Entries of a run; names up to which ranks are doubled in memory; a common prefix longer than any.
CHUNK, DOUBLED, FAR = 1 << 17, 1 << 22, 1 << 30
Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # places, symbols before, common prefixes
KINDS = (np.dtype(np.int64), np.dtype(np.uint64), np.dtype(np.int32))
#: Bytes that queues of this process have written to files.
spilled = 0


class Queues:
    """A queue of runs for each symbol; at most budget bytes of them in memory, the rest in a file."""

    def __init__(self, budget: int) -> None:
        self.runs: defaultdict[int, deque] = defaultdict(deque)
        self.budget, self.held, self.file = budget, 0, None

    def put(self, symbol: int, run: Run) -> None:
        global spilled
        size = sum(x.nbytes for x in run)
        if self.held + size <= self.budget:
            self.held += size
            self.runs[symbol].append(run)
            return
        if self.file is None:
            os.makedirs(tempfile.gettempdir(), exist_ok=True)
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, os.SEEK_END)
        self.runs[symbol].append((self.file.tell(), len(run[0])))
        for x in run:
            self.file.write(np.ascontiguousarray(x).data)
        spilled += size

    def put_all(self, run: Run, symbols: np.ndarray) -> None:
        """Entries dealt to their symbols' queues, in order."""
        for a in range(0, len(symbols), CHUNK):
            s = symbols[a : a + CHUNK]
            order = np.argsort(s, kind="stable")
            s = s[order]
            part = tuple(x[a : a + CHUNK].take(order) for x in run)
            self.put_sorted(part, s)

    def put_sorted(self, run: Run, s: np.ndarray) -> None:
        cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
        edges = [0, *cuts.tolist(), len(s)]
        for k, a, b in zip(s[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            self.put(k, tuple(x[a:b] for x in run))

    def _load(self, run: tuple) -> Run:
        if isinstance(run[0], np.ndarray):
            self.held -= sum(x.nbytes for x in run)
            return run
        at, n = run
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * kind.itemsize), kind) for kind in KINDS)

    def _next(self, pop: Callable[[], tuple], runs: deque) -> list[Run]:
        """Runs that hold about CHUNK entries together, so that small ones are served at once."""
        out = [self._load(pop())]
        while runs and sum(len(x[0]) for x in out) < CHUNK:
            out.append(self._load(pop()))
        return out

    def take(self, symbol: int) -> Iterator[Run]:
        """The symbol's runs in order, also those put while others are served."""
        runs = self.runs.get(symbol)
        while runs:
            out = self._next(runs.popleft, runs)
            yield out[0] if len(out) == 1 else tuple(map(np.concatenate, zip(*out, strict=True)))
        self.runs.pop(symbol, None)

    def back(self, symbol: int, first: Callable[[int], int]) -> Iterator[Run]:
        """The symbol's entries from the last to the first, with their common prefixes with the one after them.

        first: that of the last entry, by its place.
        """
        runs, after = self.runs.pop(symbol, None), None
        while runs:
            out = self._next(runs.pop, runs)[::-1]
            at, word, lcp = (np.concatenate(x)[::-1] for x in zip(*out, strict=True))
            ahead = np.empty(len(at), np.int32)
            ahead[0] = first(int(at[0])) if after is None else after
            ahead[1:] = lcp[:-1]
            after = lcp[-1]
            yield at, word, ahead

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """The first n symbols of t, with views that read eight bytes of them at once; 16 bytes more at its end save a copy."""

    def __init__(self, t: np.ndarray, n: int | None = None) -> None:
        self.n = len(t) if n is None else n
        self.per, self.bits = 8 // t.itemsize, np.uint64(8 * t.itemsize)
        self.mask = np.uint64((1 << int(self.bits)) - 1)
        padded = t if len(t) >= self.n + 2 * self.per else np.concatenate([t[: self.n], np.zeros(2 * self.per, t.dtype)])
        self.t, self.aligned = padded[: self.n], padded[: len(padded) // self.per * self.per].view(np.uint64)
        self.every = np.ndarray((self.n,), "<u8", padded, strides=(t.itemsize,))

    def before(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes that hold the symbol before each place; for place 0 any."""
        return self.aligned.take(np.maximum(at - 1, 0) // self.per)

    def symbol(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The symbol before each place, from what an entry carries."""
        return (word >> (((at - 1) % self.per).astype(np.uint64) * self.bits)) & self.mask

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b, at most limit (which ends in the text)."""
        out = np.zeros(len(a), np.int64)
        left = np.flatnonzero(limit > 0)
        while len(left):
            x = self.every[a[left] + out[left]] ^ self.every[b[left] + out[left]]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, self.per, np.log2(np.where(x == 0, 1, low).astype(np.float64)).astype(np.int64) // int(self.bits))
            out[left] += same
            left = left[(x == 0) & (out[left] < limit[left])]
        return np.minimum(out, limit)

    def common_of(self, a: int, b: int) -> int:
        one = np.array([self.n - max(a, b)])
        return int(self.common(np.array([a]), np.array([b]), one)[0])


def star_places(text: Text) -> np.ndarray:
    """Places of the S*-suffixes: smaller than the next suffix, after one that is larger than its next."""
    out: list[np.ndarray] = []
    follows, below = False, None  # the type and symbol of the place after the part
    for a in range((text.n - 1) // CHUNK * CHUNK, -1, -CHUNK):
        t = text.t[a : a + CHUNK]
        nxt = np.append(t[1:], t[-1:] if below is None else below)
        less, equal = t < nxt, t == nxt
        if below is None:
            less[-1], equal[-1] = False, False  # the last suffix is larger than the empty one
        settled = np.flatnonzero(~equal)
        at = np.searchsorted(settled, np.arange(len(t)))
        kind = np.append(less[settled], follows)[at]
        star = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
        if out and out[-1][:1].tolist() == [a + len(t)] and kind[-1]:
            out[-1] = out[-1][1:]  # the part's first place looked like a star, but the place before is smaller, too
        if kind[0] and a > 0:
            star = np.append([0], star)
        out.append(star + a)
        follows, below = bool(kind[0]), t[:1]
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int64)


class _Scan:
    """Common prefixes of what one scan induces."""

    def __init__(self, text: Text, queues: Queues, k: int, counted: bool) -> None:
        self.text, self.queues, self.counted = text, queues, counted
        self.least = np.full(k, -1, np.int32)  # since the last entry of each symbol; -1: there is none yet

    def induce(self, run: Run, chosen: Callable[[np.ndarray], np.ndarray]) -> None:
        """Puts the suffixes before those of run into their queues, if their symbols are chosen."""
        at, word, lcp = run
        symbol = self.text.symbol(at, word)
        pick = np.flatnonzero((at > 0) & chosen(symbol))
        if self.counted and not len(pick):
            np.minimum(self.least, lcp.min(), out=self.least)
        if not len(pick):
            return
        s = symbol.take(pick).astype(self.text.t.dtype)
        order = np.argsort(s, kind="stable")
        s, idx = s.take(order).astype(np.int64), pick.take(order)
        new = np.zeros(len(idx), np.int32)
        if self.counted:
            first = np.concatenate([[True], s[1:] != s[:-1]])
            f = np.flatnonzero(first)
            new[f] = np.minimum(self.least[s[f]], np.minimum.accumulate(lcp)[idx[f]])
            later = np.flatnonzero(~first)
            if len(later):
                edges = np.empty(2 * len(later), np.int64)
                edges[0::2], edges[1::2] = idx[later - 1] + 1, idx[later] + 1
                new[later] = np.minimum.reduceat(np.append(lcp, FAR).astype(np.int32), edges)[0::2]
            new += 1
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR)
            last = np.append(f[1:], len(idx)) - 1
            np.minimum(self.least, after[0], out=self.least)
            self.least[s[last]] = after[idx[last] + 1]
        place = at.take(idx) - 1
        carried = word.take(idx)
        turn = np.flatnonzero(place % self.text.per == 0)
        carried[turn] = self.text.before(place[turn])
        self.queues.put_sorted((place, carried, new), s)


def induced(text: Text, k: int, stars: Queues, budget: int, counted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest down, with their common prefixes with the one before, from the S*-suffixes.

    stars: these by symbol from the largest down with common prefixes, or, to sort substrings, in any order.
    """
    if not text.n:
        return
    queues, low = Queues(budget), Queues(budget)
    scan = _Scan(text, queues, k, counted)
    # The end of the text, as the smallest suffix, induces the last place.
    end = np.array([text.n - 1])
    queues.put(int(text.t[-1]), (end, text.before(end), np.zeros(1, np.int32)))
    scan.least[int(text.t[-1])] = FAR
    for c in sorted_symbols(text, k):
        last = -1
        for run in queues.take(c):
            last = int(run[0][-1])
            low.put(c, run)
            scan.induce(run, lambda s, c=c: s >= c)
        touch = lambda at, last=last: text.common_of(last, at) if counted and last >= 0 else 0
        for run in stars.back(c, touch):
            scan.induce(run, lambda s: np.ones(len(s), bool))
    scan = _Scan(text, queues, k, counted)
    for c in sorted_symbols(text, k)[::-1]:
        last = -1
        for run in queues.take(c):
            last = int(run[0][-1])
            scan.induce(run, lambda s, c=c: s <= c)
            yield run[0], run[2]
        touch = lambda at, last=last: text.common_of(last, at) if counted and last >= 0 else 0
        for run in low.back(c, touch):
            scan.induce(run, lambda s, c=c: s < c)
            yield run[0], run[2]
    queues.close()
    low.close()


def sorted_symbols(text: Text, k: int) -> list[int]:
    seen = np.zeros(k, bool)
    for a in range(0, text.n, CHUNK):
        seen[text.t[a : a + CHUNK]] = True
    return np.flatnonzero(seen).tolist()


def by_doubling(t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes as induced() gives them, by doubling the length that ranks stand for; all in memory."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    levels, span = [(1, rank.astype(np.int32))], 1
    while rank.max(initial=0) < n:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - span)] = rank[span:]
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        span *= 2
        levels.append((span, rank.astype(np.int32)))
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    order = order[::-1]
    a, b, lcp = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for span, r in reversed(levels):
        inside = np.flatnonzero(np.maximum(a, b) + lcp < n)
        x = inside[r[a[inside] + lcp[inside]] == r[b[inside] + lcp[inside]]]
        lcp[x] += span
    yield order, np.concatenate([[0], lcp])[:n].astype(np.int32)


def suffixes(t: np.ndarray, k: int, budget: int = 32 << 20, doubled: int = DOUBLED, n: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of t (its first n numbers, below k) from the largest down, with their common prefixes with the one before."""
    text = Text(t, n)
    places = star_places(text)
    m = len(places)
    stars = Queues(budget)
    zero = np.zeros(m, np.int32)
    if m < 2:
        if m:
            stars.put_all((places, text.before(places), zero), text.t[places].astype(np.int64))
        yield from induced(text, k, stars, budget, True)
        return
    stars.put_all((places, text.before(places), zero), text.t[places].astype(np.int64))
    length = np.append(places[1:], text.n - 1) - places + 1
    # Names of the S*-substrings, from the largest down: equal substrings, equal names.
    names = np.zeros(m, np.uint32)
    count, prior = 0, -1
    for at, _ in induced(text, k, stars, budget, False):
        i = np.searchsorted(places, at)
        i = i[(i < m) & (places[np.minimum(i, m - 1)] == at)]
        if not len(i):
            continue
        a = np.concatenate([[prior if prior >= 0 else i[0]], i[:-1]])
        size = length[i]
        same = (length[a] == size) & (text.common(places[a], places[i], np.where(length[a] == size, size, 0)) == size)
        same[0] &= prior >= 0
        name = count + np.cumsum(~same)
        names[i] = name
        count, prior = int(name[-1]), int(i[-1])
    stars.close()
    names = np.uint32(count) - names
    if count == m:  # all differ, so the names are the order
        order = np.empty(m, np.int64)
        order[names] = np.arange(m)
        found: Iterator = iter([(order[::-1], np.zeros(m, np.int32))])
    elif m <= doubled:
        found = by_doubling(names)
    else:
        found = suffixes(names.astype(np.uint16) if count < 1 << 16 else names, count, budget, doubled)
    stars, prior = Queues(budget), -1
    ends = np.append(places, text.n)
    for i, same in found:
        a = np.concatenate([[prior if prior >= 0 else i[0]], i[:-1]])
        # Names that agree stand for so much text; in the next two, which differ, symbols are compared.
        x, y = a + same, i + same
        inside = np.flatnonzero((x < m) & (y < m))
        lcp = np.where(x < m, ends[np.minimum(y, m)] - places[i], ends[np.minimum(x, m)] - places[a])
        u, v = x[inside], y[inside]
        limit = np.minimum(np.maximum(length[u], length[v]), text.n - np.maximum(places[u], places[v]))  # a shorter one may begin a longer
        lcp[inside] += text.common(places[u], places[v], limit)
        if prior < 0:
            lcp[0] = 0
        at = places[i]
        first = text.t[at].astype(np.int64)
        stars.put_all((at, text.before(at), lcp.astype(np.int32)), first)
        prior = int(i[-1])
    yield from induced(text, k, stars, budget, True)
    stars.close()


_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all windows of length values (bytes or 64-bit numbers), by doubling."""
    piece, span = (_BYTE.take(values) if values.dtype == np.uint8 else values), 1
    total, done = None, 0
    while True:
        if length & span:
            if total is None:
                total = piece
            else:  # done symbols, then span more
                m = len(values) - done - span + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                total = total[:m] * np.uint64(pow(_BASE, span, 1 << 64)) + piece[done : done + m]
            done += span
            if done == length:
                return total[: max(0, len(values) - length + 1)]
        m = len(piece) - span
        if m <= 0:
            return np.zeros(0, np.uint64)
        piece = piece[:m] * np.uint64(pow(_BASE, span, 1 << 64)) + piece[span : span + m]
        span *= 2


def repeated_starts(t: np.ndarray, need: np.ndarray, budget: int = 32 << 20, doubled: int = DOUBLED) -> np.ndarray:
    """Of the starts in t (bytes) with need > 0, those whose next need bytes also stand at another such start.

    t may be longer than need, its text. Starts with equal bytes must have equal needs. Neighbours in suffix order among them share the least common prefix
    of the suffixes from one to the other.
    """
    out = np.zeros(len(need), bool)
    prior, least = -1, FAR
    for at, lcp in suffixes(t, 256, budget, doubled, len(need)):
        pick = np.flatnonzero(need.take(at) > 0)
        if not len(pick):
            least = min(least, int(lcp.min(initial=FAR)))
            continue
        i = at.take(pick)
        common = np.minimum.reduceat(lcp[: pick[-1] + 1], np.concatenate([[0], pick[:-1] + 1]))
        common[0] = min(int(common[0]), least)
        a = np.concatenate([[prior if prior >= 0 else i[0]], i[:-1]])
        same = (common >= need.take(i)) & (need.take(a) == need.take(i))
        same[0] &= prior >= 0
        out[i[same]] = True
        out[a[same]] = True
        prior = int(i[-1])
        least = int(lcp[pick[-1] + 1 :].min(initial=FAR))
    return out
