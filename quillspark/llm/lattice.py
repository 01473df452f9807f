"""The E8 lattice: nearest points, next nearest points, and hashes of vectors to lattice cells."""

from __future__ import annotations

import numpy as np


def _checkerboard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest point of D8 (whole coordinates of even sum), the next one, and the nearest's squared distance."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(x))
    odd = (near.sum(1) % 2 != 0).astype(np.int64)
    away = np.where(off >= 0, 1.0, -1.0)

    def turned(points: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = points.copy()
        out[rows, which] += away[rows, which]
        return out

    first, second = order[:, 0], order[:, 1]
    best = np.where(odd[:, None] == 1, turned(near, first), near)
    # with an odd sum the next one turns the second coordinate instead; else two turns keep the sum even
    spare = np.where(odd[:, None] == 1, turned(near, second), turned(turned(near, first), second))
    return best, spare, ((x - best) ** 2).sum(1)


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of 8 numbers the nearest E8 point, a next near one, both doubled to whole numbers, and how much farther the latter is."""
    whole, whole_next, d_whole = _checkerboard(x)
    half, half_next, d_half = _checkerboard(x - 0.5)
    half, half_next = half + 0.5, half_next + 0.5
    first_half = d_half < d_whole
    best = np.where(first_half[:, None], half, whole)
    options = np.stack([np.where(first_half[:, None], whole, half), np.where(first_half[:, None], half_next, whole_next)])
    far = ((x - options) ** 2).sum(2)
    pick = far.argmin(0)
    rows = np.arange(len(x))
    gap = far[pick, rows] - ((x - best) ** 2).sum(1)
    return (2 * best).astype(np.int64), (2 * options[pick, rows]).astype(np.int64), gap


class LatticeHash:
    """Keys of vectors: for each table, ``blocks`` projections to 8 dimensions, each decoded to its cell."""

    def __init__(self, size: int, tables: int, blocks: int, width: float, probes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.planes = rng.normal(size=(size, tables * blocks * 8)) / width
        self.shift = rng.random(tables * blocks * 8) * 2
        self.odd = rng.integers(0, 1 << 64, (tables, blocks, 8), dtype=np.uint64) | np.uint64(1)

    def _fold(self, table: int, block: int, points: np.ndarray) -> np.ndarray:
        h = (points.astype(np.uint64) * self.odd[table, block]).sum(1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors to (rows, tables, 1 + probes) keys: the own cell, then the nearest neighbouring ones."""
        y = (x @ self.planes + self.shift).reshape(len(x), self.tables, self.blocks, 8)
        out = np.empty((len(x), self.tables, 1 + self.probes), np.uint64)
        for t in range(self.tables):
            own, other, gaps = [], [], []
            for b in range(self.blocks):
                best, spare, gap = decode(y[:, t, b])
                own.append(self._fold(t, b, best))
                other.append(self._fold(t, b, spare))
                gaps.append(gap)
            base = np.sum(own, axis=0, dtype=np.uint64)
            out[:, t, 0] = base
            order = np.argsort(np.stack(gaps, 1), axis=1)
            swap = np.stack([o - w for o, w in zip(other, own, strict=True)], 1)
            for p in range(self.probes):
                out[:, t, 1 + p] = base + swap[np.arange(len(x)), order[:, p]]
        return out.view(np.int64)
