"""Connectivity of small state graphs, and shortest paths."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame


def strong_components(m: np.ndarray, directed: bool = True) -> list[list[int]]:
    """Strongly connected components, largest first, then by first state; states ascending."""
    adj = m != 0
    if not directed:
        adj = adj | adj.T
    return sorted(parts_of({i: np.flatnonzero(adj[i]).tolist() for i in range(len(m))}), key=lambda p: (-len(p), p[0]))


def parts_of(ends: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components of a graph in memory: ends of the edges that leave each state; states ascending."""
    number, low, on, stack, parts = {}, {}, set(), [], []
    for s in ends:
        if s in number:
            continue
        work = [(s, iter(ends[s]))]
        number[s] = low[s] = len(number)
        stack.append(s)
        on.add(s)
        while work:
            v, it = work[-1]
            for u in it:
                if u not in number:
                    number[u] = low[u] = len(number)
                    stack.append(u)
                    on.add(u)
                    work.append((u, iter(ends.get(u, ()))))
                    break
                if u in on:
                    low[v] = min(low[v], number[u])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while True:
                        u = stack.pop()
                        on.discard(u)
                        part.append(u)
                        if u == v:
                            break
                    parts.append(sorted(part))
    return parts


def reaches(m: np.ndarray, sources: list[int], ends: list[int], directed: bool = True) -> bool:
    """Whether every end is reached from every source."""
    adj = m != 0
    if not directed:
        adj = adj | adj.T
    for s in sources:
        seen = np.zeros(len(m), bool)
        seen[s] = True
        edge = seen.copy()
        while edge.any():
            edge = adj[edge].any(axis=0) & ~seen
            seen |= edge
        if not seen[ends].all():
            return False
    return True


def shortest_path(cost: dict[int, dict[int, float]], start: int, end: int) -> list[int]:
    """Least-cost path, by Dijkstra; ties go to the smaller state."""
    best, done, heap = {start: (0.0, None)}, set(), [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if v == end:
            break
        for u, c in sorted(cost.get(v, {}).items()):
            if u not in best or d + c < best[u][0]:
                best[u] = (d + c, v)
                heapq.heappush(heap, (d + c, u))
    if end not in best:
        return []
    path = [end]
    while best[path[-1]][1] is not None:
        path.append(best[path[-1]][1])
    return path[::-1]


def fundamental_sequence(states: list[int], t: np.ndarray, symmetric: bool = False) -> list[int]:
    """A path's fundamental sequence: the likeliest way from its first to its last state along steps that it took."""
    m = t * t.T if symmetric else t
    cost: dict[int, dict[int, float]] = {}
    for a, b in zip(states, states[1:], strict=False):
        for x, y in ((a, b), (b, a)) if symmetric else ((a, b),):
            if x != y and m[x, y] > 0:
                cost.setdefault(x, {})[y] = -math.log(m[x, y])
    return shortest_path(cost, states[0], states[-1])


def fundamental_sequences(paths: DataFrame, t: np.ndarray, symmetric: bool = False) -> DataFrame:
    """(sequence, n): paths (path array<int>) reduced to fundamental sequences and counted."""
    from pyspark.sql import functions as F

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(sequence=[",".join(map(str, fundamental_sequence(list(p), t, symmetric))) for p in pdf["path"]])[["sequence"]]

    return paths.select("path").mapInPandas(run, "sequence string").groupBy("sequence").agg(F.count("*").alias("n"))
