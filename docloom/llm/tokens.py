"""Token ids from a public tokenizer file, with a compact cache of the ids of units.

A byte-level BPE with the usual split pattern never joins what stands before a blank or line end with
what follows it when a visible character follows, so such a text is the concatenation of its units,
each with the blank or line end before it, and the ids of a unit can be kept. One mark after a letter
or digit at the end of a unit is a split of its own, so it counts as a unit of its own. Texts with other
white space after a blank or line end, and other kinds of tokenizers, are encoded whole.

The cache is numpy alone: a hash table from 64-bit hashes of units to stretches of one array of ids, about
40 bytes a unit. Units are found for all texts of a batch at once, and what is missing is given to
the tokenizer at once. Whatever the cache holds, ids are those of the whole text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from docloom.llm.common import KEPT, mix64, text_bytes
from docloom.llm.shingles import _BYTE, _WEIGHTS, _powers

#: Units kept by a worker; a full cache starts anew.
CACHE_UNITS = 2_000_000
#: Bytes of text that are hashed at a time, and units that are encoded at a time.
SEGMENT, JOINED = 1 << 20, 8192
_LOADED: dict[str, Encoder] = {}
_TABLE = _BYTE.copy()
_TABLE[65:91] = mix64(_TABLE[97:123] ^ _WEIGHTS[20]) | np.uint64(1)  # case counts here
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Cache:
    """Open addressing with linear probing; keys are never 0."""

    def __init__(self, units: int, dtype):
        self.bits = max(4, (2 * units - 1).bit_length())
        self.units = units
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)
        self.first = np.zeros(units + 1, np.int64)
        self.ids = np.zeros(1 << 16, dtype)
        self.n = 0

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each unit, or -1."""
        at, out = self._home(h), np.full(len(h), -1, np.int32)
        there = self.keys[at]
        hit = there == h
        out[hit] = self.number[at[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == h[left]
            out[left[hit]] = self.number[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, h: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New distinct units with the lengths of their ids, and the ids of all."""
        begin, end = int(self.first[self.n]), int(self.first[self.n]) + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end - len(self.ids), len(self.ids)), self.ids.dtype)])
        self.ids[begin:end] = ids
        own = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.first[self.n + 1 : self.n + len(h) + 1] = begin + np.cumsum(lengths)
        self.n += len(h)
        at, left = self._home(h), np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]  # of units that want one place the last gets it
            won = free[self.keys[at[free]] == h[free]]
            self.number[at[won]] = own[won]
            done = np.zeros(len(h), bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units one after the other, and how many each has."""
        lengths = self.first[number + 1] - self.first[number]
        ends = np.cumsum(lengths)
        at = np.repeat(self.first[number] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.ids[at], lengths


class Encoder:
    def __init__(self, path: str, units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has one character for each byte
        for token, k in vocab.items():
            self.bytes_of[k] = len(token)
        self.units, self.dtype = units, np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        self.cache: Cache | None = None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode units as one text, and cut its ids where the units end."""
        data = raw.tobytes()
        own = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for k in range(0, len(own), JOINED):
            # a unit without a blank is put behind a line end, which is one id of one byte
            bare = np.array([u[0] not in b" \n" for u in own[k : k + JOINED]])
            parts = [b"\n" + u if x else u for u, x in zip(own[k : k + JOINED], bare.tolist(), strict=True)]
            ids = self._whole(b"".join(parts).decode())
            done = np.cumsum(self.bytes_of[ids])
            edges = np.concatenate([[0], np.searchsorted(done, np.cumsum([len(p) for p in parts]), "left") + 1])
            keep = np.ones(len(ids), bool)
            keep[edges[:-1][bare]] = False
            self.cache.add(h[k : k + JOINED], np.diff(edges) - bare, ids[keep])

    def _odd(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose ids are not those of their units."""
        odd = np.zeros(len(offsets) - 1, bool)
        if not self.by_unit:
            return ~odd
        for s in self.special:
            data = raw.tobytes()
            at = data.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                odd[row] |= at + len(s) <= offsets[row + 1]
                at = data.find(s, at + 1)
        n = len(raw)
        gap = np.flatnonzero((raw == 32) | (raw == 10))
        row = np.searchsorted(offsets, gap, "right") - 1
        last = gap + 1 == offsets[row + 1]
        a, b, c = (raw[np.minimum(gap + k, n - 1)] for k in (1, 2, 3))
        wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        wide |= ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        odd[row[last | _SPACE[a] | wide]] = True
        # a text may begin with white space only if that is one blank or line end
        begin = np.flatnonzero(np.diff(offsets))
        first = raw[offsets[begin]]
        odd[begin[(_SPACE[first] & (first != 32) & (first != 10)) | np.isin(first, (0xC2, 0xE1, 0xE2, 0xE3))]] = True
        return odd

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 byte of all units, in order."""
        n = len(raw)
        edge = (raw == 32) | (raw == 10)
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        # one mark after a letter or digit: Latin letters of two bytes count, others stay with their unit
        own = np.flatnonzero(_MARK[raw[ends - 1]] & (ends - starts >= 2))
        at = ends[own] - 2
        latin = (ends[own] - starts[own] >= 3) & (raw[np.maximum(at - 1, 0)] == 0xC3) & (raw[at] >= 0x80) & (raw[at] != 0x97) & (raw[at] != 0xB7)
        starts = np.sort(np.concatenate([starts, ends[own[_ALNUM[raw[at]] | latin]] - 1]))
        return starts, np.append(starts[1:], n)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
            low, high = int(starts[i]), int(ends[j - 1])
            up, down = _powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_TABLE[raw[low:high]] * up[:-1], out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _WEIGHTS[63]
            i = j
        return mix64(out) | np.uint64(1)

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """For each text of a string column its ids; a null text has none."""
        raw, offsets = text_bytes(column)
        out = [np.zeros(0, np.uint32)] * len(column)
        if not len(raw):
            return out
        odd = self._odd(raw, offsets)
        for r in np.flatnonzero(odd & (np.diff(offsets) > 0)).tolist():
            out[r] = self._whole(raw[offsets[r] : offsets[r + 1]].tobytes().decode())
        if odd.all():
            return out
        starts, ends = self._units(raw, offsets)
        if odd.any():
            keep = ~odd[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return out
        h = self._hashes(raw, starts, ends)
        if self.cache is None:
            self.cache = Cache(self.units, self.dtype)
        number = self.cache.find(h)
        lacking = np.flatnonzero(number < 0)
        if len(lacking):
            new, where = np.unique(h[lacking], return_index=True)
            if self.cache.n + len(new) > self.cache.units:
                self.cache = None  # before the next is made
                self.cache = Cache(max(self.units, len(h)), self.dtype)
                new, where = np.unique(h, return_index=True)
                lacking = np.arange(len(h))
            self._learn(new, raw, starts[lacking[where]], ends[lacking[where]])
            number[lacking] = self.cache.find(h[lacking])
        ids, lengths = self.cache.gather(number)
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        ids = ids.astype(np.uint32)
        for r in np.flatnonzero(~odd & (np.diff(offsets) > 0)).tolist():
            out[r] = ids[cuts[r] : cuts[r + 1]]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text the little-endian unsigned 32-bit ids; a null text has none."""
        return [x.astype("<u4").tobytes() for x in self.encode_column(pa.array(texts, pa.string()))]


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    KEPT["tokens"] = _LOADED.clear
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
