"""Neighbours in the plane by tiles against those by blocks of all pairs, on shapes that uneven cells are for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import neighbours, tiles


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x, strict=True)], "spot_id long, x double, y double").repartition(6)


def shapes():
    rng = np.random.default_rng(3)
    crowd = rng.normal(size=(900, 2)) * 1e-3
    return {
        "crowd and far-off points": np.concatenate([crowd, [[1e6, 1e6], [-1e9, 3.0], [5.0, 1e7]]]),
        "line": np.stack([np.arange(800.0), np.zeros(800)], axis=1),
        "grid with ties": np.array([(i // 28, i % 28) for i in range(784)], float),
        "copies": np.concatenate([np.repeat([[0.5, 0.5]], 400, axis=0), rng.random((400, 2))]),
        "scales": (10.0 ** rng.uniform(-9, 9, (800, 1))) * rng.normal(size=(800, 2)),
    }


@pytest.mark.parametrize("shape", shapes())
def test_equal_to_blocks(spark, shape):
    x = shapes()[shape]
    df = table(spark, x, np.random.default_rng(1).permutation(len(x)) * 2 - 300)
    vectors = df.select("spot_id", F.array("x", "y").alias("feat"))
    for include_self in (False, True):
        want = neighbours.block_neighbours(vectors, vectors, 4, include_self).select("i", "j", "rank", "d2")
        got = neighbours.grid_neighbours(df, 4, include_self, tile_rows=30)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_jobs_do_not_follow_the_shape(spark):
    jobs = {}
    tracker = spark.sparkContext.statusTracker()
    for name in ("grid with ties", "crowd and far-off points"):
        df = table(spark, shapes()[name]).cache()
        df.count()
        spark.sparkContext.setJobGroup(name, name)
        neighbours.grid_neighbours(df, 6).collect()
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs["grid with ties"] - jobs["crowd and far-off points"]) <= 4, jobs


def test_tiles_hold_about_as_many():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(30_000, 2)) * 1e-4, rng.random((3000, 2)), [[1e8, -1e8]]])
    own = tiles.Tiles(x[rng.choice(len(x), 66 * tiles.SAMPLED, replace=False)], 66).place(x)[0]
    sizes = np.unique(own, return_counts=True)[1]
    assert sizes.max() <= 4 * tiles.TILE_ROWS  # of the hottest tile, pairs are its square at most
