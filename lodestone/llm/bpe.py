"""Byte-pair encoding of many words at once, from a tokenizer file with word-end merges.

Words of one length are the rows of a matrix of symbol ids. Each step merges, in every row, the leftmost pair of the
lowest rank; rows without a pair that merges are done. Tests hold the ids against the tokenizer's own.
"""

from __future__ import annotations

import json

import numpy as np

NEVER = np.int32(1 << 30)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str, bits: int = 19):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.ranks, self.merged = np.full(size + 64, -1, np.int64), np.full(size + 64, NEVER, np.int32), np.zeros(size + 64, np.int32)
        self.probes = 1
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[a] << 32 | vocab[b]
            at = first = key * int(_ODD) % (1 << 64) >> (64 - bits)
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, vocab[a + b]
            self.probes = max(self.probes, at - first + 1)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table, or a place whose rank is NEVER."""
        key = a.astype(np.int64) << 32 | b
        at = (key.view(np.uint64) * _ODD >> self.shift).astype(np.int64)
        out = np.full(at.shape, len(self.keys) - 1)
        for _ in range(self.probes):
            seen = self.keys[at]
            np.copyto(out, at, where=seen == key)
            at += 1
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit numbers; a word is a piece that the tokenizer doesn't part."""
        out, lengths = [b""] * len(words), np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            if n:
                rows = np.nonzero(lengths == n)[0]
                for at in range(0, len(rows), max(1, 2_000_000 // n)):
                    some = rows[at : at + max(1, 2_000_000 // n)]
                    raw = np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(-1, n)
                    for i, x in zip(some.tolist(), self._rows(raw), strict=True):
                        out[i] = x
        return out

    def _rows(self, raw: np.ndarray) -> list[bytes]:
        w, n = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        done, size = np.zeros((w, n), "<u4"), np.zeros(w, np.int64)
        live, length = np.arange(w), n
        where = self._find(ids[:, :-1], ids[:, 1:])
        rank = self.ranks[where]
        while True:
            best = rank.argmin(axis=1) if length > 1 else np.zeros(len(live), np.int64)
            go = rank[np.arange(len(live)), best] < NEVER if length > 1 else np.zeros(len(live), bool)
            if not go.all():
                stop = ~go
                done[live[stop], :length], size[live[stop]] = ids[stop], length
                live, ids, rank, where, best = live[go], ids[go], rank[go], where[go], best[go]
            if not len(live):
                break
            r = np.arange(len(live))
            new = self.merged[where[r, best]]
            cols = np.arange(length - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            ids[r, best] = new
            length -= 1
            if length > 1:
                cols = cols[:-1]
                take = cols + (cols >= best[:, None])
                where, rank = np.take_along_axis(where, take, 1), np.take_along_axis(rank, take, 1)
                for j, ok in ((best - 1, best > 0), (best, best < length - 1)):
                    k = r[ok]
                    at = self._find(ids[k, j[ok]], ids[k, j[ok] + 1])
                    where[k, j[ok]], rank[k, j[ok]] = at, self.ranks[at]
        flat, ends = done.tobytes(), (np.arange(w) * n + size) * 4
        return [flat[s:e] for s, e in zip((np.arange(w) * n * 4).tolist(), ends.tolist(), strict=True)]
