"""The tree's plan: which delay rows of two neighbouring bands make each row of the band above.

Levels are numpy arrays over all rows of a level at once. `flatten` follows the
rows down to channels, which gives the transform in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .geometry import Geometry, half_away


@dataclass
class Level:
    """Rows of one level in order of (band, delay). tail and head are row numbers of the level below; head -1: copied."""

    df_bottom: float
    df_top: float
    grids: list[np.ndarray]
    band: np.ndarray
    index: np.ndarray
    delay: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    offset: np.ndarray
    first: np.ndarray = field(default=None)

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(g) for g in self.grids])

    def shape(self) -> tuple[int, int, int, int]:
        """Bands, least and most rows of a band, rows of all."""
        n = self.sizes
        return len(n), int(n.min()), int(n.max()), int(n.sum())


class TreePlan:
    """All levels of a geometry, from channels (0) to the whole band (niters)."""

    def __init__(self, g: Geometry):
        self.geometry, self.real = g, np.float32 if g.precision == "float32" else np.float64
        self.levels = [self._channels()]
        for _ in range(g.niters):
            self.levels.append(self._merge(self.levels[-1]))

    def share(self, a, b, c, d):
        """The part of the delay over (c, d) that falls in (a, b)."""
        two = self.real(-2)
        return (self.real(a) ** two - self.real(b) ** two) / (self.real(c) ** two - self.real(d) ** two)

    def grid(self, start: float, end: float) -> np.ndarray:
        """Trial delays of a band: its share of dt_min ... dt_max, by dt_step."""
        g = self.geometry
        part = self.share(start, end, g.f_min, g.f_max)
        low, high = (int(half_away(self.real(x) * part)) for x in (g.dt_min, g.dt_max))
        return np.arange(low, high + 1, g.dt_step)

    def _level(self, bottom, top, grids, tail, head, offset) -> Level:
        sizes = np.array([len(x) for x in grids])
        band = np.repeat(np.arange(len(grids)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])
        return Level(bottom, top, grids, band, np.arange(len(band)) - first[band], np.concatenate(grids), tail, head, offset, first)

    def _channels(self) -> Level:
        g, df = self.geometry, self.real(self.geometry.df)
        grids = []
        for i in range(g.nchans):
            start = df * self.real(i) + self.real(g.f_min)
            grids.append(self.grid(start, start + df))
        none = np.full(sum(map(len, grids)), -1)
        return self._level(float(df), float(df), grids, none, none, none)

    def nearest(self, grid: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Positions of the nearest entries of a sorted grid; of two as near, the upper."""
        at = np.minimum(np.searchsorted(grid, want, side="left"), len(grid) - 1)
        below = np.maximum(at - 1, 0)
        lower = (grid[at] >= want) & (at > 0) & (want - grid[below] < grid[at] - want)
        return np.where(lower, below, at)

    def _merge(self, below: Level) -> Level:
        g, real = self.geometry, self.real
        n = len(below.grids)
        bands, odd = n // 2 + n % 2, n % 2 == 1
        bottom, prev = real(below.df_bottom) * real(2), real(below.df_bottom)
        top = real(below.df_top) if odd else real(below.df_top) + prev
        grids, tails, heads, offsets = [], [], [], []
        for b in range(bands):
            start = bottom * real(b) + real(g.f_min)
            lower = below.grids[2 * b]
            if odd and b == bands - 1:
                grids.append(lower)
                tails.append(below.first[2 * b] + self.nearest(lower, lower))
                heads.append(np.full(len(lower), -1))
                offsets.append(np.zeros(len(lower), dtype=np.int64))
                continue
            end = start + (top if b == bands - 1 else bottom)
            middle, guard = start + prev, real(g.correction)
            grid = self.grid(start, end)
            in_tail = half_away(grid.astype(real) * self.share(start, middle - guard, start, end)).astype(np.int64)
            shift = half_away(grid.astype(real) * self.share(start, middle + guard, start, end)).astype(np.int64)
            if (in_tail > grid).any() or (shift > grid).any():
                raise ValueError("a part of the band has more delay than the band")
            if (shift >= g.nsamps).any():
                raise ValueError("an offset is as long as the block: nsamps is too small for dt_max")
            grids.append(grid)
            tails.append(below.first[2 * b] + self.nearest(lower, in_tail))
            heads.append(below.first[2 * b + 1] + self.nearest(below.grids[2 * b + 1], grid - shift))
            offsets.append(shift)
        return self._level(float(bottom), float(top), grids, *map(np.concatenate, (tails, heads, offsets)))

    @property
    def final(self) -> Level:
        return self.levels[-1]

    @property
    def dt_grid(self) -> np.ndarray:
        return self.final.grids[0]

    @property
    def dm_grid(self) -> np.ndarray:
        return self.dt_grid * self.geometry.dm_step

    def flatten(self) -> dict[str, np.ndarray]:
        """i_dt, dt, chan, w, shift: out[dt, t] is the sum over rows of mean(x[chan, t - shift - w .. t - shift])."""
        out = np.arange(len(self.final.delay))
        row, shift = out, np.zeros(len(out), dtype=np.int64)
        for level in reversed(self.levels[1:]):
            head, off = level.head[row], level.offset[row]
            up = head >= 0
            row, shift, out = np.concatenate([level.tail[row], head[up]]), np.concatenate([shift, shift[up] + off[up]]), np.concatenate([out, out[up]])
        base = self.levels[0]
        order = np.lexsort((base.band[row], out))
        out, row, shift = out[order], row[order], shift[order]
        return {"i_dt": out, "dt": self.final.delay[out], "chan": base.band[row], "w": base.delay[row], "shift": shift}

    def halo(self) -> int:
        """Samples before a time that its output depends on."""
        reach = self.levels[0].delay
        for level in self.levels[1:]:
            up = np.where(level.head >= 0, reach[level.head] + level.offset, 0)
            reach = np.maximum(reach[level.tail], up)
        return int(reach.max())

    def lowest(self) -> np.ndarray:
        """For each trial, the first sample that any channel reaches."""
        low = self.levels[0].delay
        for level in self.levels[1:]:
            low = np.minimum(low[level.tail], np.where(level.head >= 0, low[level.head] + level.offset, low[level.tail]))
        return low

    def cost(self) -> tuple[int, int]:
        """Row operations of the tree and of the flat form, for each sample."""
        merges = sum(len(x.delay) for x in self.levels[1:])
        return merges, len(self.final.delay) * self.geometry.nchans

    def memory_usage(self) -> int:
        """Bytes held by the arrays of all levels, copied rows included."""
        return sum(getattr(x, k).nbytes for x in self.levels for k in ("band", "index", "delay", "tail", "head", "offset", "first")) + sum(q.nbytes for x in self.levels for q in x.grids)
