"""A graph dealt to blocks with halos, so that a model's epoch is a pass over blocks and not a join for each product.

Nodes are dealt to blocks of about ``BLOCK_NODES`` by their places (``tiles``). A block also gets its halo: all nodes that a walk of as many
steps as the model has products can reach from it, with their features, and the edges between all of these. What is
computed for the block's own nodes from that is exact, and so are the gradients of their losses; what the halo's outer nodes
come to is of no account. In a plane the halo follows the block's border. Where halos would make more than ``MOST_TIMES`` the nodes, as
with many links across slices, ``dealt`` returns None, and products are joins as before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import tape, tiles
from spotweave.sources import shared

#: Nodes of a block on average, and times that all nodes may be held, with halos.
BLOCK_NODES, MOST_TIMES = 4000, 4.0


class Product:
    """A block's part of the adjacency, as entries (row, column, value) sorted by row and by column. Every row and column has a loop."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.sides = []
        for by, other in ((rows, columns), (columns, rows)):
            order = np.argsort(by, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(by[order]) > 0)))
            self.sides.append((other[order], values[order], starts))

    def _times(self, x: np.ndarray, side: int) -> np.ndarray:
        other, values, starts = self.sides[side]
        views = x.reshape(-1, len(starts), x.shape[1])  # each view's rows one after the other
        return np.add.reduceat(views[:, other] * values[:, None], starts, axis=1).reshape(x.shape)

    def __call__(self, x: tape.Var) -> tape.Var:
        return tape.Var(self._times(x.value, 0), ((x, lambda g: self._times(g, 1)),))


class Dealt:
    """(block, spot_id, own) of all nodes and halos, and the blocks' entries."""

    def __init__(self, held: DataFrame, parts: DataFrame):
        self.held, self.parts = held, parts

    def grouped(self, rows: DataFrame, columns: list[str], out: str, own_only: bool = False) -> DataFrame:
        """(block, out): the ``rows`` (``spot_id``, columns) of each block's nodes by id."""
        held = self.held.where("own") if own_only else self.held
        met = held.join(rows, "spot_id")
        return met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("spot_id", *columns))).alias(out))


def dealt(spots: DataFrame, edges: DataFrame, steps: int, block_nodes: int = BLOCK_NODES) -> DataFrame | None:
    """(block, spot_id, own): the blocks of ``spots`` (spot_id, x, y) with halos of ``steps`` along ``edges`` (i, j); None if they are too large."""
    n = spots.count()
    count = min(tiles.MOST_TILES, max(1, -(-n // block_nodes)))
    sample = spots.orderBy(F.xxhash64("spot_id"), "spot_id").limit(count * tiles.SAMPLED).select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    tree = spots.sparkSession.sparkContext.broadcast(tiles.Tiles(sample.toPandas().to_numpy(float), count))  # MOST_TILES * SAMPLED places at most

    def run(batches):
        for batch in batches:
            places = np.stack([np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False)) for k in (1, 2)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(tree.value.place(places)[0].astype(np.int32)), batch.column(0)], names=["block", "spot_id"])

    own = shared.written(spots.select(F.col("spot_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).mapInArrow(run, "block int, spot_id long"))
    if own.select("block").distinct().count() == 1:
        return shared.written(own.withColumn("own", F.lit(True)))
    held = own
    for _ in range(steps):
        beyond = held.join(edges.select(F.col("i").alias("spot_id"), "j"), "spot_id").select("block", F.col("j").alias("spot_id"))
        held = shared.written(held.union(beyond).distinct())
        if held.count() > MOST_TIMES * n:
            return None
    return shared.written(held.join(own.withColumn("own", F.lit(True)), ["block", "spot_id"], "left").select("block", "spot_id", F.coalesce("own", F.lit(False)).alias("own")))


def with_entries(held: DataFrame, adj: DataFrame) -> Dealt:
    """The blocks with the entries (i, j, v) of the adjacency between their nodes, by place in the block."""
    rows = held.select("block", F.col("spot_id").alias("i"))
    columns = held.select("block", F.col("spot_id").alias("j"))
    entries = adj.join(rows, "i").join(columns, ["block", "j"]).groupBy("block").agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("v").alias("v"))
    nodes = held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("spot_id", "own"))).alias("nodes"))
    return Dealt(held, shared.written(nodes.join(entries, "block")))


def read(row: dict) -> tuple[np.ndarray, np.ndarray, Product]:
    """A block's ids in order, which are its own, and its product."""
    ids = np.array([x["spot_id"] for x in row["nodes"]], np.int64)
    own = np.flatnonzero([x["own"] for x in row["nodes"]])
    return ids, own, Product(np.searchsorted(ids, row["i"]), np.searchsorted(ids, row["j"]), np.array(row["v"], float))
