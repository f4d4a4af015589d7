"""K-squared tree (k = 2) over a sparse matrix of integers, and the sums of
absolute row differences by joint traversal of row pairs."""

from __future__ import annotations

import numpy as np

#: Joint nodes that one step expands at most; more are taken in parts.
FRONTIER = 200_000


def _interleaved(row: np.ndarray, col: np.ndarray, height: int) -> np.ndarray:
    code = np.zeros(row.size, np.int64)
    for b in range(height):
        code |= ((col >> b) & 1) << (2 * b) | ((row >> b) & 1) << (2 * b + 1)
    return code


class K2Tree:
    """Quadrants of a 2**height square, level by level: one bit for each quadrant
    of each nonzero node; a set bit's rank is its node on the next level, and on the last level its value."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, side: int):
        self.height = max(1, int(side - 1).bit_length())
        code = _interleaved(row.astype(np.int64), col.astype(np.int64), self.height)
        order = np.argsort(code, kind="stable")
        code, self.values = code[order], value[order]
        self.bits: list[np.ndarray] = []
        above = np.zeros(min(1, code.size), np.int64)
        for level in range(1, self.height + 1):
            nodes = np.unique(code >> 2 * (self.height - level))
            bits = np.zeros(4 * above.size, bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            above = nodes
        self.rank = [np.cumsum(b) - 1 for b in self.bits]

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The nodes' children in a quadrant, -1 where all is zero."""
        if not self.values.size:
            return np.full(node.size, -1, np.int64)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def row_distances(row: np.ndarray, col: np.ndarray, value: np.ndarray, zero: np.ndarray, width: int) -> np.ndarray:
    """The matrix of sum(abs(v[g] - v[h])) over ``width`` columns for rows g < h, where cells not given hold
    the row's own ``zero`` value. Exact for int64 results.

    Two rows go down the tree together, quadrant row against quadrant row. Where both
    quadrants are all zero the columns count as so many times the difference of the rows'
    zero values, without being visited; leaves are visited where one or both hold a value."""
    rows = zero.size
    total = np.zeros((rows, rows), np.int64)
    if rows < 2 or width < 1:
        return total
    tree = K2Tree(row, col, value, max(rows, width))
    h = tree.height
    unseen = [np.zeros((-(-rows >> h - l), -(-rows >> h - l)), np.int64) for l in range(h + 1)]
    root = np.zeros(1, np.int64)
    node = root if tree.values.size else root - 1
    if node[0] < 0:
        unseen[0][0, 0] = width
    stack = [] if node[0] < 0 else [(0, root, root, root, node, node)]
    while stack:
        level, a, b, c, na, nb = stack.pop()
        if a.size > FRONTIER:
            half = a.size // 2
            stack += [(level, *(x[s] for x in (a, b, c, na, nb))) for s in (slice(None, half), slice(half, None))]
            continue
        if level == h:
            va = np.where(na >= 0, tree.values[na], zero[a])
            vb = np.where(nb >= 0, tree.values[nb], zero[b])
            np.add.at(total, (a, b), np.abs(va - vb))
            continue
        span = h - level - 1          # log2 of a child's side
        parts = []
        for dc in (0, 1):
            cc = 2 * c + dc
            cols = np.minimum(width, (cc + 1) << span) - (cc << span)
            for da in (0, 1):
                ca = tree.child(level, na, 2 * da + dc)
                for db in (0, 1):
                    ra, rb = 2 * a + da, 2 * b + db
                    there = (cols > 0) & (rb << span < rows) & ((ra < rb) if span == 0 else (ra <= rb))
                    cb = tree.child(level, nb, 2 * db + dc)
                    both_zero = there & (ca < 0) & (cb < 0)
                    np.add.at(unseen[level + 1], (ra[both_zero], rb[both_zero]), cols[both_zero])
                    at = there & ~both_zero
                    if at.any():
                        parts.append((ra[at], rb[at], cc[at], ca[at], cb[at]))
        if parts:
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))
    g = np.arange(rows)
    columns = sum(u[np.ix_(g >> h - l, g >> h - l)] for l, u in enumerate(unseen))
    total += columns * np.abs(zero[:, None] - zero[None, :])
    return np.triu(total, 1)
