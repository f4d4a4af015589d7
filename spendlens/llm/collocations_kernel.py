"""Numpy work of the phrase miner inside a task: blocks of words as numbers,
windows of up to ``DEPTH`` words, and the multikey three-way quicksort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

#: Bytes that end a piece: [.,;:!?\\x0A-\\x0D].
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A byte that no UTF-8 text holds stands between pieces.
BREAK = b"\xff"


def _folding() -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in ENDS:
        table[c] = BREAK[0]
    return bytes(table)


FOLD = _folding()


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts' distinct words, their counts, and the texts as word numbers
    from 1 with 0 between pieces. Ends of pieces are gone after folding, so the
    only white space left to split at is [\\x20\\x09]."""
    folded = BREAK.join(texts).translate(FOLD).replace(BREAK, b" \xff ").split()
    number = Numbered({BREAK: 0})
    seq = np.fromiter(map(number.__getitem__, folded), np.int32, len(folded))
    counts = np.bincount(seq, minlength=len(number))[1:]
    return list(number)[1:], counts, seq


def packed(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: the high planes cost nothing."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpacked(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def windows_at(seq: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The ``depth`` numbers from each position on; 0 from the first 0 on."""
    padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
    cols = [padded[at]]
    for d in range(1, depth):
        cols.append(np.where(cols[-1] != 0, padded[at + d], 0))
    return cols


def merged_windows(seq: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows of two words or more, in order, and how often each
    stands in ``seq`` (numbers keep the order that the caller sorts by)."""
    follows = np.append(seq[1:] != 0, False)
    cols = windows_at(seq, np.flatnonzero((seq != 0) & follows), depth)
    if cols[0].size == 0:
        return cols, np.zeros(0, np.int64)
    bits = max(1, int(seq.max()).bit_length())
    each = 63 // bits
    keys = []
    for lo in range(0, depth, each):
        key = np.zeros(cols[0].size, np.int64)
        for c in cols[lo:lo + each]:
            key = (key << bits) | c
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(order.size, bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in cols], np.diff(np.append(first, order.size))


def as_bytes(cols: list[np.ndarray]) -> np.ndarray:
    """Windows as byte strings that compare as the windows do."""
    rows = np.stack(cols, axis=1).astype(">i8")
    return np.ascontiguousarray(rows).view(f"S{8 * len(cols)}").reshape(-1)


def frequent_prefixes(cols: list[np.ndarray], weight: np.ndarray, least: int,
                      shortest: int = 2) -> Iterator[tuple[int, int, int]]:
    """(index of a window, length, count) of every prefix of ``shortest`` words
    or more that the windows hold ``least`` times, by multikey three-way quicksort.

    Pointers are dealt into smaller, equal and larger than a pivot at the
    current word. The equal part's weight is the count of the prefix that it
    shares; it goes on with the next word, down to the last column. A part whose weight is below
    ``least`` cannot hold a frequent prefix and is abandoned."""
    stack = [(np.arange(weight.size), 0)]
    while stack:
        at, d = stack.pop()
        key = cols[d][at]
        pivot = key[key.size // 2]
        below, equal = key < pivot, key == pivot
        for side in (at[below], at[~(below | equal)]):
            if side.size and weight[side].sum() >= least:
                stack.append((side, d))
        if pivot:
            same = at[equal]
            count = int(weight[same].sum())
            if count >= least:
                if d + 1 >= shortest:
                    yield int(same[0]), d + 1, count
                if d + 1 < len(cols):
                    stack.append((same, d + 1))
