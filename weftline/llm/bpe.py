"""Byte-pair encoding and decoding with a pair occurrence index.

All new words of a block of texts are laid out as one chain of symbols. An index maps each merge rank to all
positions where its pair stands; the active ranks are applied in ascending order, each to all its positions at
once, and the positions next to a merge are entered under the ranks of the pairs that they now form. Encoded words
are remembered up to a fixed number.

Nulls and empty texts have no tokens. White space between tokens is not encoded, so decoding gives the tokens'
strings joined by spaces, as the tokenizer file (which names no decoder) asks for. Texts are split into blocks
between rows only; each text is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import trimmed

#: Words remembered between blocks, and characters of a block.
REMEMBERED, BLOCK = 150_000, 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, otherwise the next code point from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encodes texts as the text of a tokenizer file says; made for BPE files with word-end suffixes and a removing split."""

    def __init__(self, file: str) -> None:
        import regex

        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        # In lower-case ASCII text the classes have few members, for which the plain module is faster.
        plain = split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", " \\t-\\r")
        self.ascii = None if "\\p" in plain or "A-Z" in plain else re.compile(plain)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        v = self.size = len(self.vocab) + len(self.special) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([self.vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        code = left * v + right
        order = np.argsort(code, kind="stable")
        keep = np.concatenate([code[order][1:] != code[order][:-1], [True]]) if len(order) else np.array([], bool)  # the last of equal pairs counts
        self.codes, self.ranks = code[order][keep], order[keep].astype(np.int32)
        # A rank whose product takes part in an earlier merge must go one position of a word at a time.
        first = np.full(v, len(pairs), np.int64)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.single = first[self.made] < np.arange(len(pairs))
        chars = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in chars], np.int32)
        self.final = np.array([self.vocab[c + suffix] for c in chars], np.int32)
        self.ids: dict[str | int, bytes] = {}
        self.text: dict[str | int, str] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for those that don't merge."""
        code = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends - 1] = n  # n: no neighbour
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[ends - sizes] = n
        sym = np.append(sym, -1).astype(np.int32)
        nxt, prv = np.append(nxt, n), np.append(prv, n)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[nxt[at] < n]
            if not len(at):
                return
            r = self.rank(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for a, b, k in zip(bounds, bounds[1:], r[np.concatenate([[0], cuts])].tolist(), strict=False):
                part = at[a:b]
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(active, k)

        enter(np.arange(n, dtype=np.int64))
        word = np.repeat(np.arange(len(words)), sizes) if self.single.any() else None
        while active:
            k = heapq.heappop(active)
            held = index.pop(k)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            a, b, c = self.left[k], self.right[k], self.made[k]
            at = at[alive[at] & (sym[at] == a)]
            at = at[sym[nxt[at]] == b]
            if not len(at):
                continue
            rest = None
            if self.single[k]:
                w = word[at]
                lead = np.concatenate([[True], w[1:] != w[:-1]])
                at, rest = at[lead], at[~lead]
            elif a == b:  # in a run, every other position, from the left
                if len(at) > 1:
                    follows = nxt[at[:-1]] == at[1:]
                    if follows.any():
                        start = np.concatenate([[True], ~follows])
                        group = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                        at = at[(np.arange(len(at)) - group) % 2 == 0]
            gone = nxt[at]
            sym[at] = c
            alive[gone] = False
            after = nxt[gone]
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            before = before[before < n]
            # Neighbours that were merged in this same step are among at already.
            enter(np.unique(np.concatenate([before[alive[before]], at])))
            if rest is not None and len(rest):
                if k in index:
                    index[k].append(rest)
                else:
                    index[k] = [rest]
                    heapq.heappush(active, k)
        live = np.flatnonzero(alive[:n])
        ids = sym[live].astype("<u4")
        cut = [0, *np.searchsorted(live, ends).tolist()]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def words(self, text: str) -> list[str | int]:
        """Pre-tokenized words of a text; special tokens as their ids."""
        parts: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            parts += self._plain(text[at : m.start()])
            parts.append(self.special[m.group()])
            at = m.end()
        return parts + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # letters are lower-cased one by one
        elif self.ascii is not None:
            return self.ascii.findall(text.lower())
        return self.split.findall(text.lower())

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, str]]:
        """Number of tokens, ids as little-endian 32-bit integers and decoded text, for each text."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.text.clear()
        known, text = self.ids, self.text
        fresh = set().union(*split) - known.keys()
        new = [w for w in fresh if not isinstance(w, int)]
        if new:
            strings = self.strings
            for w, ids in zip(new, self.merge(new), strict=True):
                known[w] = ids.tobytes()
                text[w] = " ".join([strings[i] for i in ids.tolist()])
        for w in fresh.difference(new):
            known[w] = int(w).to_bytes(4, "little")
            text[w] = self.strings[w]
        for ws in split:
            ids = b"".join(map(known.__getitem__, ws))
            yield len(ids) // 4, ids, " ".join(map(text.__getitem__, ws))


_loaded: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The encoder of a tokenizer file's text; a worker remembers the last one."""
    if file not in _loaded:
        _loaded.clear()
        _loaded[file] = Encoder(file)
    return _loaded[file]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Each document's id with n_tokens, ids (array<int>) and decoded (string); digests: SHA-256 of these instead."""
    with open(path, encoding="utf-8") as f:  # of a fixed size; executors need not see the path
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    key = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {key}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .common import blocks, release

        enc = encoder(file.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, BLOCK):
                n, x, y = [], [], []
                for count, ids, text in enc.encode(texts[a:b]):
                    n.append(count)
                    x.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<i4"))
                    y.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(x, pa.string() if digests else pa.list_(pa.int32())), pa.array(y, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])
                release()
        enc.ids.clear()
        enc.text.clear()

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), out)
