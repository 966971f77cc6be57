"""Neighbours by pivot cells against those by blocks of all pairs, and what they compare."""

import numpy as np
import pandas as pd
import pytest

from spotweave.operators import cover, neighbours, pivots


def table(spark, x, ids=None, batch=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), v.tolist(), int(0 if batch is None else batch[n])) for n, (i, v) in enumerate(zip(ids, x, strict=True))]
    return spark.createDataFrame(rows, "spot_id long, feat array<double>, batch long").repartition(6)


def clustered(rng, n, dims=8, clusters=40, spread=0.05):
    return rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))


@pytest.mark.parametrize("include_self", [False, True])
def test_equal_to_blocks_on_ties_and_copies(spark, include_self):
    rng = np.random.default_rng(1)
    x = np.concatenate([clustered(rng, 500), rng.integers(0, 3, (300, 8)).astype(float), np.repeat(clustered(rng, 1), 250, axis=0), [[1e6] * 8]])
    df = table(spark, x, rng.permutation(len(x)) * 3 - 500)
    want = neighbours.block_neighbours(df, df, 5, include_self)
    got = pivots.pivot_neighbours(df, df, 5, include_self, cell_rows=20, pack_rows=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_each_other_group(spark):
    rng = np.random.default_rng(2)
    x, batch = clustered(rng, 600), rng.integers(0, 3, 600)
    batch[0] = 9  # a group of one row: fewer than k
    df = table(spark, x, batch=batch)
    want = neighbours.block_neighbours(df, df, 3, group="batch")
    got = pivots.pivot_neighbours(df, df, 3, group="batch", cell_rows=20, pack_rows=60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_and_no_rows(spark):
    df = table(spark, np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 5.0]]))
    assert [(r.i, r.j) for r in sorted(pivots.pivot_neighbours(df, df, 1).collect())] == [(0, 1), (1, 0), (2, 1)]
    assert len(pivots.pivot_neighbours(df, df, 7).collect()) == 6
    assert pivots.pivot_neighbours(df.limit(0), df, 2).collect() == [] and pivots.pivot_neighbours(df, df.limit(0), 2).collect() == []


def compared(n):
    """Pairs of places that both passes compare on ``n`` rows in clusters that follow n."""
    rng = np.random.default_rng(5)
    x = clustered(rng, n, clusters=n // 100, spread=0.02)
    pivot = x[rng.choice(n, n // pivots.CELL_ROWS, replace=False)]
    packs = n // pivots.PACK_ROWS
    cells = pivots.Cells(pivot, packs)
    d, off = cells.distances(x)
    own = np.argmin(d, axis=1)
    known = pd.DataFrame({"g": 0, "cell": own, "r": d[np.arange(n), own]}).groupby(["g", "cell"]).agg(n=("r", "size"), low=("r", "min"), high=("r", "max")).reset_index()
    cells.learn(known)
    size = np.bincount(cells.pack, weights=cells.groups[0][0])
    first = cells.to_packs(cells.first(d, 0, 6))
    bound = np.full(n, 0.02 * np.sqrt(8) * 2)  # a row's sixth neighbour is in its own cluster
    second = cells.to_packs(cells.reachable(d, off, 0, bound)) & ~first
    return float((first @ size).sum() + (second @ size).sum())


def test_pairs_grow_far_slower_than_squares():
    small, large = compared(20_000), compared(100_000)
    assert np.log(large / small) / np.log(5) < 1.5 and large < 0.1 * 100_000**2, (small, large)


@pytest.mark.parametrize("groups", [1, 3])
def test_a_query_goes_to_few_areas(spark, monkeypatch, groups):
    """Without structure a query looks into nearly all packs: it is sent to a few areas of them, as often for many rows as for few."""
    seen, search = [], cover._search_areas

    def spied(asked, places, known, k, other, blocks):
        seen.append((known.value, blocks))
        return search(asked, places, known, k, other, blocks)

    monkeypatch.setattr(cover, "BLOCK_ROWS", 50)
    monkeypatch.setattr(cover, "_search_areas", spied)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32).astype(float)  # sent in single precision
    x[700:720] = x[5]
    df = table(spark, x, rng.permutation(len(x)), rng.integers(0, groups, len(x)))
    group = "batch" if groups > 1 else None
    want = neighbours.block_neighbours(df, df, 4, group=group).select("i", "g", "j", "rank", "d2")
    got = pivots.pivot_neighbours(df, df, 4, group=group, cell_rows=5, pack_rows=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    (cells, blocks), = seen
    assert cells.packs > 80 and blocks <= cover.FEW_BLOCKS and sum(map(len, cells.areas.values())) < cover.FEW_BLOCKS + groups
    for areas in cells.areas.values():
        assert [p for first, end in areas for p in range(first, end)] == list(range(cells.packs))
    assert cover.blocks_of(40_000) == cover.blocks_of(800_000) == cover.FEW_BLOCKS
