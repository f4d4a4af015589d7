"""Byte-string kernels for ``repeats``: rolling hashes and window anchors in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
MIX = U(0xD6E8FEB86659FD93)

_POWERS: dict[str, np.ndarray] = {}


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and its inverse (mod 2^64) for i < n; kept for the next block."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        inverse = U(pow(int(MULT), -1, 1 << 64))
        for name, base in (("up", MULT), ("down", inverse)):
            step = np.full(size, base, U)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Hashes of any stretch of a byte array: a polynomial over random byte values, mod 2^64."""

    def __init__(self, raw: np.ndarray, seed: int = 1):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_splitmix(256, seed)[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * MIX
    return h ^ (h >> U(29))


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by running minima over blocks of w."""
    n = len(v) - w + 1
    if n <= 0:
        return np.empty(0, v.dtype)
    pad = np.full(-len(v) % w, np.iinfo(v.dtype).max, v.dtype)
    blocks = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def runs(raw: np.ndarray, ends: np.ndarray, hashes: Hashes, length: int, gram: int):
    """All windows of ``length`` bytes that lie within one document (``ends``:
    where each ends), as runs of neighbours with one anchor: (start, count,
    anchor). A window's anchor is its gram of least hash (the first of equals),
    so equal windows have it at the same place."""
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none
    bits = U(max(20, len(raw).bit_length()))
    grams = hashes.grams(gram)
    value = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U)
    anchor = (window_minima(value, length - gram + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    fits = np.zeros(len(raw) + 1, np.int8)
    ok = ends - begins >= length
    np.add.at(fits, begins[ok], 1)
    np.add.at(fits, ends[ok] - length + 1, -1)
    inside = np.cumsum(fits[:len(anchor)]).astype(bool)
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    change[begins[begins < len(anchor)]] = True
    # a run ends where the next begins or where windows stop fitting
    edge = np.flatnonzero((change & inside) | (np.concatenate([[False], inside[:-1] & ~inside[1:]])))
    start = edge[inside[edge]]
    stop = np.append(edge, len(anchor))[np.searchsorted(edge, start) + 1]
    return start, stop - start, anchor[start]
