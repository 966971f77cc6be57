"""Exact k nearest neighbours, by Euclidean distance with ties to the smaller id.

``block_neighbours`` takes vectors of any length: both sides are dealt by hash to blocks of ``BLOCK_ROWS`` rows, and each
pair of blocks is one group, in which a matrix product finds who may be near and the distances of these are worked
out as they are defined. It is exact, and therefore compares all with all: the rows sent are the rows times the number of blocks.

``grid_neighbours`` takes points of a plane and goes by tiles (``tiles``); for vectors in clusters there are pivot cells (``pivots``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.operators import cover, tiles
from spotweave.operators.cover import AT_ONCE, BLOCK_ROWS


def block_neighbours(queries: DataFrame, points: DataFrame, k: int, include_self: bool = False, key: str = "spot_id", vector: str = "feat", group: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, rank, d2): for each query the ``k`` nearest points; with ``group``, the k nearest in each other group (g)."""
    columns = [F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("g")]
    asked, refs = queries.select(*columns), points.select(*columns)
    p, q = (max(1, -(-side.count() // block_rows)) for side in (asked, refs))
    own = lambda n, seed: F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("i", "v", "g", own(p, 1).alias("p"), every(q).alias("q"))
    right = refs.select("i", "v", "g", own(q, 2).alias("q"), every(p).alias("p"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"i": np.empty(0, np.int64), "g": np.empty(0, np.int64), "j": np.empty(0, np.int64), "d2": np.empty(0)})]
        if len(a) and len(b):
            for g, part in b.groupby("g", sort=True):
                asking = a[a["g"] != g] if group else a
                for at in range(0, len(asking), AT_ONCE):
                    found.append(cover.nearest_in(asking.iloc[at : at + AT_ONCE], part, int(g), k, include_self))
        return pd.concat(found)

    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(near, "i long, g long, j long, d2 double")
    best = W.partitionBy("i", "g").orderBy("d2", "j")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("i", "g", "j", "rank", "d2")


def grid_neighbours(points: DataFrame, k: int, include_self: bool = False, key: str = "spot_id", x: str = "x", y: str = "y", tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(i, j, rank, d2): for each point of the plane its ``k`` nearest. Points without an id or a place have no neighbours."""
    return tiles.tile_neighbours(points, k, include_self, key, x, y, tile_rows)
