"""Exact k nearest neighbours of vectors by cells around pivots, with ties to the smaller id.

Pivots are a hashed sample of the places, one for about ``CELL_ROWS`` and ``MOST_PIVOTS`` at most; they are broadcast. Each place belongs
to the cell of its nearest pivot. For each cell and group, the number of ids and the least and largest distance from the pivot
are kept. Cells near each other are packed until a pack has about ``PACK_ROWS`` places.

By the triangle inequality, nothing in a cell is nearer to a query than the distance from its pivot less the cell's largest
distance, nor than the cell's least distance less that. A query goes to those packs only that have a cell for which this isn't above its bound
(``cover``). On vectors in clusters that is few packs; on vectors without any structure it is nearly all. What is sent doesn't follow the packs: each
group's packs make ``areas`` of neighbouring ones with about as many places each, and a query is sent to an area once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators import cover

#: Places of a cell and of a pack on average, pivots at most.
CELL_ROWS, PACK_ROWS, MOST_PIVOTS = 100, 2000, 4096
#: Share of a vector's length that a distance by products may be off.
OFF = 1e-7


class Cells:
    """The pivots, the pack of each, and for each group and cell what is known of its places; ``areas`` has the first pack of each of a group's areas and the end."""

    at_once = cover.AT_ONCE  #: rows that are held against all pivots at once

    def __init__(self, pivots: np.ndarray, packs: int = 1):
        self.pivots, self.middle = pivots, pivots.mean(axis=0)
        self.packs = packs
        self.pack = packed(pivots, packs)
        self.by_pack = np.argsort(self.pack, kind="stable")
        self.starts = np.searchsorted(self.pack[self.by_pack], np.arange(packs))
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.areas: dict[int, list[tuple[int, int]]] = {}

    def notes(self) -> list[Column]:
        return [F.min("r").alias("low"), F.max("r").alias("high")]

    def learn(self, known: pd.DataFrame) -> None:
        """``n``, ``low`` and ``high`` of each group ``g`` and ``cell``."""
        for g, rows in known.groupby("g"):
            n, low, high = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
            at = rows["cell"].to_numpy()
            n[at], low[at], high[at] = rows["n"], rows["low"], rows["high"]
            self.groups[int(g)] = (n, low, high)
        every = sum(int(n.sum()) for n, _, _ in self.groups.values())
        for g, (n, _, _) in self.groups.items():  # packs of neighbouring boxes have neighbouring numbers
            held = np.bincount(self.pack, weights=n, minlength=self.packs)
            areas = -(-int(n.sum()) * cover.blocks_of(every) // every)
            area = ((np.cumsum(held) - held) * areas // max(1.0, held.sum())).astype(int)
            starts = np.flatnonzero(np.diff(area, prepend=-1))
            self.areas[g] = list(zip(starts.tolist(), [*starts[1:].tolist(), self.packs], strict=True))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its pack, its cell, and the distance from the pivot."""
        d, _ = self.distances(x)
        cell = np.argmin(d, axis=1)
        return self.pack[cell], cell, d[np.arange(len(d)), cell]

    def looks(self, x: np.ndarray, g: int, enough: int, bound: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and packs of group ``g`` that they look into, in the first pass or with ``bound`` in the second."""
        yield np.nonzero(self.goes(x, g, enough, bound))

    def goes(self, x: np.ndarray, g: int, enough: int, bound: np.ndarray | None) -> np.ndarray:
        """For each row whether it looks into each pack of group ``g``."""
        d, off = self.distances(x)
        go = self.to_packs(self.first(d, g, enough))
        return go if bound is None else self.to_packs(self.reachable(d, off, g, bound)) & ~go

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distances of rows from all pivots, and how far they may be off."""
        a, b = x - self.middle, self.pivots - self.middle
        size, of_pivots = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        d2 = size[:, None] + of_pivots - 2 * a @ b.T
        return np.sqrt(np.maximum(d2, 0.0)), OFF * (np.sqrt(size) + np.sqrt(of_pivots.max()))

    def to_packs(self, go: np.ndarray) -> np.ndarray:
        """For each row whether it goes to each pack, from whether it goes to each cell."""
        return np.logical_or.reduceat(go[:, self.by_pack], self.starts, axis=1)

    def first(self, d: np.ndarray, g: int, enough: int) -> np.ndarray:
        """For each row whether it looks into each cell in the first pass: the nearest cells with ``enough`` ids of group ``g``."""
        n = self.groups[g][0]
        order = np.argsort(np.where(n > 0, d, np.inf), axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (before < enough) & (n[order] > 0), axis=1)
        return out

    def reachable(self, d: np.ndarray, off: np.ndarray, g: int, bound: np.ndarray) -> np.ndarray:
        """For each row whether a cell may hold ids of group ``g`` as near as its ``bound``."""
        n, low, high = self.groups[g]
        least = np.maximum(d - high, low - d)
        return (n > 0) & (least <= (bound + 2 * off)[:, None])


def packed(pivots: np.ndarray, packs: int) -> np.ndarray:
    """A pack for each pivot: boxes of as many pivots, halved along their longest side again and again. No pack is empty."""
    out = np.zeros(len(pivots), np.int64)
    todo, at = [(np.arange(len(pivots)), min(packs, len(pivots)))], 0
    while todo:
        own, n = todo.pop()
        if n == 1:
            out[own], at = at, at + 1
            continue
        x = pivots[own]
        order = own[np.argsort(x[:, np.argmax(x.max(axis=0) - x.min(axis=0))], kind="stable")]
        cut = len(own) * (n // 2) // n
        todo += [(order[cut:], n - n // 2), (order[:cut], n // 2)]
    return out


def pivot_neighbours(queries: DataFrame, points: DataFrame, k: int, include_self: bool = False, key: str = "spot_id", vector: str = "feat", group: str | None = None, cell_rows: int = CELL_ROWS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """(i, g, j, rank, d2): for each query the ``k`` nearest points; with ``group``, the k nearest in each other group (g).

    Rows without an id, a vector or (where asked for) a group take no part. Vectors are of one length.
    """
    own = [F.col(key).cast("long").alias("i"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("g")]

    def start(held: DataFrame, n: int) -> Cells:
        m = min(MOST_PIVOTS, max(1, -(-n // cell_rows)))
        sample = np.array([r["v"] for r in held.orderBy(F.xxhash64("v"), "v").limit(m).select("v").collect()], float)  # MOST_PIVOTS at most
        return Cells(sample, min(m, max(1, -(-n // pack_rows))))

    asked = queries.select(*own)
    return cover.neighbours(asked, asked if points is queries else points.select(*own), k, include_self, bool(group), start, True)
