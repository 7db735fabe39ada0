"""Token ids of many texts by a byte-pair tokenizer whose tokens never cross white space.

Each distinct word between ASCII white space is encoded once. Words that are plain Latin
letters, perhaps with punctuation behind them, are merged here, many at a time in numpy, by
the vocabulary's own merge list; all other words go to the tokenizer library as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from .common import Grown, WordTable

_NONE = np.int32(2**31 - 1)
#: Marks that end a word without being part of it: a run of them is a word of its own for the tokenizer.
_MARKS = ".,;:!?%&$#*|()[]{}-+=/_~^@\"'`<>"


def _each(counts: np.ndarray) -> np.ndarray:
    """0 to n-1 for each n of the counts, one after another."""
    end = np.cumsum(counts)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - counts, counts)


class Merger:
    """Byte-pair merges of many words in lockstep: all words of a length lose one symbol a round."""

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + "</w>"] for b in range(256)], np.int32)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = int(np.ceil(np.log2(len(pairs) * 4)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.made = np.full(1 << self.bits, _NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        key = (left << 32) | right
        waiting, slot = np.arange(len(key)), self._slot(key)
        while len(waiting):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.rank[slot[put]], self.made[slot[put]] = key[waiting[put]], waiting[put], made[waiting[put]]
            rest = np.ones(len(waiting), bool)
            rest[put] = False
            waiting, slot = waiting[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; the rank is _NONE where no merge exists."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return np.where(self.keys[slot] == key, self.rank[slot], _NONE), self.made[slot]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has. No word may be empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        counts = np.zeros(len(words), np.int64)
        pieces: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for part in np.array_split(rows, max(1, len(rows) * size // 400_000)):
                self._merge(flat[begin[part][:, None] + np.arange(size)], part, pieces, owners)
        owner = np.concatenate(owners)
        length = np.repeat([p.shape[1] for p in pieces], [len(p) for p in pieces])
        counts[owner] = length
        end = np.cumsum(counts)
        out, at = np.zeros(int(end[-1]), np.int32), end - counts
        for p, o in zip(pieces, owners, strict=True):
            out[at[o][:, None] + np.arange(p.shape[1])] = p
        return out, counts

    def _merge(self, raw: np.ndarray, rows: np.ndarray, pieces: list, owners: list) -> None:
        symbols = self.inner[raw]
        symbols[:, -1] = self.final[raw[:, -1]]
        n, size = symbols.shape
        if size > 1:
            rank, made = (x.reshape(n, size - 1) for x in self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        while len(rows) and symbols.shape[1] > 1:
            best = rank.argmin(1)
            every = np.arange(len(rows))
            going = rank[every, best] != _NONE
            if not going.all():
                pieces.append(symbols[~going])
                owners.append(rows[~going])
                symbols, rank, made, rows, best = symbols[going], rank[going], made[going], rows[going], best[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[every, best] = made[every, best]
            size = symbols.shape[1]
            keep = np.arange(size - 1) + (np.arange(size - 1) > best[:, None])
            symbols = np.take_along_axis(symbols, keep, 1)
            if size == 2:
                break
            keep = np.arange(size - 2) + (np.arange(size - 2) >= best[:, None])
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            for where in (best - 1, best):
                ok = np.flatnonzero((where >= 0) & (where < size - 2))
                r, m = self.look_up(symbols[ok, where[ok]], symbols[ok, where[ok] + 1])
                rank[ok, where[ok]], made[ok, where[ok]] = r, m
        if len(rows):
            pieces.append(symbols)
            owners.append(rows)


class Encoder:
    """Texts to token ids; equal to the tokenizer's own encode without special tokens."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merger = Merger(json.load(f)["model"])
        self.table, self.resets = WordTable(limit), 0
        self.ids, self.start, self.count = Grown(np.int32), Grown(np.int64), Grown(np.int64)
        self.tails: dict[str, list[int]] = {}

    def _learn(self, fresh: list[bytes]) -> None:
        texts = [word.decode() for word in fresh]
        cores = [text.rstrip(_MARKS) for text in texts]
        plain = np.fromiter((c.isalpha() and (c.isascii() or max(c) < "İ") for c in cores), bool, len(cores))
        where, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        counts, starts, parts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), []
        if len(where):
            kept = where.tolist()
            ids, n = self.merger("\n".join([cores[i] for i in kept]).lower().encode().split(b"\n"))
            tails = [self._tail(texts[i][len(cores[i]) :]) for i in kept]
            m = np.fromiter(map(len, tails), np.int64, len(tails))
            end = np.cumsum(n + m)
            begin = end - n - m
            out = np.zeros(int(end[-1]), np.int32)
            out[np.repeat(begin, n) + _each(n)] = ids
            out[np.repeat(begin + n, m) + _each(m)] = [x for t in tails for x in t]
            starts[where], counts[where] = begin, n + m
            parts.append(out)
        if len(odd):
            made = [self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in odd.tolist()]
            n = np.fromiter(map(len, made), np.int64, len(made))
            starts[odd], counts[odd] = np.cumsum(n) - n + sum(map(len, parts)), n
            parts.append(np.array([x for ids in made for x in ids], np.int32))
        self.start.extend(starts + self.ids.size)
        self.count.extend(counts)
        self.ids.extend(np.concatenate(parts))

    def _tail(self, marks: str) -> list[int]:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids if marks else []
        return self.tails[marks]

    def _words(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = self.table.ids(texts)
        if self.table.resets != self.resets:
            self.resets = self.table.resets
            for grown in (self.ids, self.start, self.count):
                grown.clear()
        if fresh := self.table.take_fresh():
            self._learn(fresh)
        return words, counts

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        """How many tokens each text has."""
        words, counts = self._words(texts)
        return np.bincount(np.repeat(np.arange(len(texts)), counts), weights=self.count.data[words], minlength=len(texts)).astype(np.int64)

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, 32-bit."""
        words, counts = self._words(texts)
        n, start = self.count.data[words], self.start.data[words]
        end = np.cumsum(n)
        ids = self.ids.data[np.repeat(start - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b]
