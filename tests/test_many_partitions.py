"""Neighbours with many shuffle partitions that aren't put together, as larger tables have: no pair of blocks may be missed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import cover, neighbours, pivots


@pytest.fixture
def many(spark):
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block_rows", [cover.BLOCK_ROWS, 100])
def test_neighbours_of_all_partitions(many, monkeypatch, block_rows):
    monkeypatch.setattr(cover, "BLOCK_ROWS", block_rows)
    x = np.random.default_rng(6).normal(size=(700, 2))
    df = many.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(x)], "spot_id long, x double, y double, batch long")
    vectors = df.select("spot_id", F.array("x", "y").alias("feat"), "batch")
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1, kind="stable")[:, :4]
    for found in (neighbours.grid_neighbours(df, 4, tile_rows=50), pivots.pivot_neighbours(vectors, vectors, 4, cell_rows=20, pack_rows=300)):
        got = {(r.i, r["rank"]): r.j for r in found.collect()}
        assert got == {(i, k + 1): j for i, row in enumerate(want.tolist()) for k, j in enumerate(row)}
    among = neighbours.block_neighbours(vectors, vectors, 2, group="batch").select("i", "g", "j", "rank")
    other = pivots.pivot_neighbours(vectors, vectors, 2, group="batch", cell_rows=20, pack_rows=300).select("i", "g", "j", "rank")
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, among.collect()))
