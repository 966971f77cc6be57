"""Exact k nearest places of the plane by tiles of about as many places each, with ties to the smaller id.

The plane is cut in two at the median of the longer side of a hashed sample's box, and each part again, until a part stands for
about ``TILE_ROWS`` places: small tiles in a crowd, large ones around far-off points. The tree of cuts is broadcast; the sample, and so
the tree, has a bound. What is kept of each tile is the box of its places and the number of ids.

A query looks into its own tile first (or, if that has too few ids, into those whose farthest corners are nearest), then into the tiles whose boxes
are within its bound (``cover``). The tree is gone down with many queries at once; a part whose box is too far is left out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators import cover

#: Places of a tile on average, sampled places for each tile, tiles at most.
TILE_ROWS, SAMPLED, MOST_TILES = 500, 16, 1 << 16


class Tiles:
    """The tree of cuts. Node 0 is the plane; a node with ``left`` -1 is a tile."""

    at_once = 10_000  #: rows that go down the tree together

    def __init__(self, sample: np.ndarray, tiles: int):
        self.axis, self.cut, self.left, self.right = [], [], [], []
        most = max(1, -(-len(sample) // max(1, tiles)))
        todo = [(np.arange(len(sample)), self._node())]
        while todo:
            own, node = todo.pop()
            x = sample[own]
            axis = int(np.argmax(np.ptp(x, axis=0))) if len(own) else 0
            values = np.unique(x[:, axis])
            if len(own) <= most or len(values) < 2:
                continue
            cut = np.partition(x[:, axis], len(own) // 2)[len(own) // 2]
            cut = cut if cut > values[0] else values[1]  # both parts have places
            self.axis[node], self.cut[node] = axis, float(cut)
            self.left[node], self.right[node] = self._node(), self._node()
            below = x[:, axis] < cut
            todo += [(own[below], self.left[node]), (own[~below], self.right[node])]
        self.axis, self.cut, self.left, self.right = np.array(self.axis), np.array(self.cut), np.array(self.left), np.array(self.right)
        self.groups: dict[int, np.ndarray] = {}
        self.areas: dict = {}  # a place of the plane looks into few tiles

    def _node(self) -> int:
        for column, empty in ((self.axis, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1)):
            column.append(empty)
        return len(self.axis) - 1

    def notes(self) -> list[Column]:
        v = F.col("v")
        return [F.min(v[0]).alias("x0"), F.max(v[0]).alias("x1"), F.min(v[1]).alias("y0"), F.max(v[1]).alias("y1")]

    def learn(self, known: pd.DataFrame) -> None:
        """``n`` and the box of the places of each tile (``cell``); a part's box holds those of its parts."""
        size = len(self.axis)
        self.n, self.low, self.high = np.zeros(size, np.int64), np.full((size, 2), np.inf), np.full((size, 2), -np.inf)
        at = known["cell"].to_numpy()
        self.n[at], self.low[at], self.high[at] = known["n"], known[["x0", "y0"]], known[["x1", "y1"]]
        for node in range(size - 1, -1, -1):  # parts come after what they are part of
            if self.left[node] >= 0:
                parts = [self.left[node], self.right[node]]
                self.n[node], self.low[node], self.high[node] = self.n[parts].sum(), self.low[parts].min(axis=0), self.high[parts].max(axis=0)
        self.groups = {0: self.n}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its tile."""
        node = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.left[node] >= 0)):
            at = node[inner]
            above = x[inner, self.axis[at]] >= self.cut[at]
            node[inner] = np.where(above, self.right[at], self.left[at])
        return node, node, np.zeros(len(x))

    def first(self, x: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tiles of the first pass."""
        own, _, _ = self.place(x)
        full = self.n[own] >= enough
        rows, found = [np.flatnonzero(full)], [own[full]]
        tiles = np.flatnonzero((self.left < 0) & (self.n > 0))
        for k in np.flatnonzero(~full):
            corner = np.maximum(np.abs(x[k] - self.low[tiles]), np.abs(x[k] - self.high[tiles]))
            order = tiles[np.argsort(np.sum(corner * corner, axis=1), kind="stable")]
            some = order[: int(np.searchsorted(np.cumsum(self.n[order]), enough)) + 1]
            rows.append(np.full(len(some), k))
            found.append(some)
        return np.concatenate(rows), np.concatenate(found)

    def looks(self, x: np.ndarray, g: int, enough: int, bound: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and tiles that they look into, in the first pass or with ``bound`` in the second."""
        rows, seen = self.first(x, enough)
        if bound is None:
            yield rows, seen
            return
        done = set(zip(rows.tolist(), seen.tolist(), strict=True))
        limit = bound * bound * (1 + 1e-9)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not self.n[node]:
                continue
            off = np.maximum(np.maximum(self.low[node] - x[own], x[own] - self.high[node]), 0.0)
            own = own[np.sum(off * off, axis=1) <= limit[own]]
            if not len(own):
                continue
            if self.left[node] >= 0:
                todo += [(self.left[node], own), (self.right[node], own)]
                continue
            new = np.array([k for k in own.tolist() if (k, node) not in done], np.int64)
            if len(new):
                yield new, np.full(len(new), node)


def tile_neighbours(points: DataFrame, k: int, include_self: bool = False, key: str = "spot_id", x: str = "x", y: str = "y", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(i, j, rank, d2): for each point its ``k`` nearest. Points without an id or a place have no neighbours."""
    plus = lambda c: F.col(c).cast("double") + F.lit(0.0)
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("i"), F.array(plus(x), plus(y)).alias("v"), F.lit(0).cast("long").alias("g"))

    def start(held: DataFrame, n: int) -> Tiles:
        tiles = min(MOST_TILES, max(1, -(-n // tile_rows)))
        some = held.orderBy(F.xxhash64("v"), "v").limit(tiles * SAMPLED).select("v")  # MOST_TILES * SAMPLED places at most
        return Tiles(np.array([r["v"] for r in some.collect()], float).reshape(-1, 2), tiles)

    return cover.neighbours(own, own, k, include_self, False, start).select("i", "j", "rank", "d2")
