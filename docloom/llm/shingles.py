"""Word hashes, word shingles and MinHash signatures of whole texts, vectorised over a batch.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, taken from the UTF-8 bytes. A word's hash is a
polynomial over its bytes modulo 2^64, read off prefix sums and shifted back by the inverse power
of the odd base, then mixed.
"""

from __future__ import annotations

import numpy as np

from docloom.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_WEIGHTS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each row the number of its first word (with an end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = _GAP[raw]
    first = np.empty(n, bool)
    first[0], first[1:] = True, gap[:-1]
    edge = offsets[1:-1]
    first[edge[edge < n]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, gap[1:]
    last[edge[edge > 0] - 1] = True
    starts = np.flatnonzero(first & ~gap)
    ends = np.flatnonzero(last & ~gap) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _WEIGHTS[63]), np.searchsorted(starts, offsets)


def shingles(w: np.ndarray, bounds: np.ndarray, k: int, short: bool = True) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; with fewer words the whole sequence as one."""
    out = []
    n = len(w)
    full = w[: max(0, n - k + 1)] * _WEIGHTS[0]
    for j in range(1, k):
        full = full + w[j : n - k + 1 + j] * _WEIGHTS[j] if n >= k else full
    full = mix64(full)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a and short:
            out.append(mix64(np.array([(int((w[a:b] * _WEIGHTS[: b - a]).sum()) + (b - a) * int(_WEIGHTS[62])) & _MASK], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order of its members."""
    a = mix64(s ^ _WEIGHTS[60]).sum(dtype=np.uint64), mix64(s ^ _WEIGHTS[61]).sum(dtype=np.uint64)
    return tuple(int(x.astype(np.int64)) for x in a)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m unsigned 32-bit numbers for each set.

    Each element deals out the ranks 0 to m-1 over the m components by its own random permutation,
    so ranks of one element are correlated; a component's value is the least rank + fraction (8 and
    24 bits) that any element gave it. Elements advance through their permutations together, and
    those of a set stop as soon as no later rank can lower any of its components.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.full((len(sets), m), 0xFFFFFFFF, np.uint32)
    e = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    perm = None
    flat = sig.reshape(-1)
    for k in range(m):
        if not len(e):
            break
        r = mix64(e + np.uint64((k + 1) * int(_WEIGHTS[50]) & _MASK))
        j = k + ((r >> np.uint64(32)) % np.uint64(m - k)).astype(np.int64)
        if perm is None:
            slot = j
        else:
            at = np.arange(len(e))
            slot = perm[at, j].astype(np.int64)
            perm[at, j] = perm[:, k]
            perm[:, k] = slot
        np.minimum.at(flat, row * m + slot, ((r & np.uint64(0xFFFFFF)) | np.uint64(k << 24)).astype(np.uint32))
        rows = np.unique(row)
        done = np.zeros(len(sets), bool)
        done[rows] = sig[rows].max(axis=1) < ((k + 1) << 24)
        keep = ~done[row]
        if perm is None:
            e, row, slot = e[keep], row[keep], slot[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
            perm[np.arange(len(e)), slot] = 0
            perm[:, 0] = slot
        elif not keep.all():
            e, row, perm = e[keep], row[keep], perm[keep]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` components; equal keys of a band meet in one bucket."""
    x = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    h = (x * _WEIGHTS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _WEIGHTS[40]
    return mix64(h).astype(np.int64)
