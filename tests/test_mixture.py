"""k-means and mixtures: all starts together, seeds by oversampling."""

import numpy as np
import pytest

from spotweave.operators import mixture


def made(spark, x, first=0):
    rows = [(i + first, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "spot_id long, feat array<double>").repartition(5)


def by_force(x, k, tries=60):
    """The least cost of many runs of plain k-means from spread rows."""
    rng = np.random.default_rng(1)
    best = np.inf
    for _ in range(tries):
        c = x[rng.choice(len(x), 1)]
        while len(c) < k:
            d = np.min(((x[:, None] - c) ** 2).sum(2), axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
        for _ in range(30):
            own = np.argmin(((x[:, None] - c) ** 2).sum(2), axis=1)
            c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        best = min(best, np.min(((x[:, None] - c) ** 2).sum(2), axis=1).sum())
    return best


def jobs_of(spark, work):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        out = work()
        return out, len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc._jsc.sc().clearJobGroup()


def test_cost_is_that_of_the_best_runs_and_jobs_follow_rounds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in rng.normal(0, 5, (6, 3))]) + 1e4
    feats = made(spark, x).cache()
    feats.count()
    (centres, cost), jobs = jobs_of(spark, lambda: mixture.kmeans(feats, 6))
    assert cost == pytest.approx(np.min(((x[:, None] - centres) ** 2).sum(2), axis=1).sum())
    assert cost <= by_force(x, 6) * (1 + 1e-6)
    one, few = jobs_of(spark, lambda: mixture.kmeans(feats, 6, starts=1))
    assert jobs <= 2 * (1 + mixture.SEEDING + 1 + 21) and jobs <= 3 * few
    feats.unpersist()


def test_starts_are_those_of_runs_one_by_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    together, costs = mixture.kmeans_starts(made(spark, x), 3, [7, 8, 9], 4)
    for at, seed in enumerate((7, 8, 9)):
        alone, cost = mixture.kmeans_starts(made(spark, x).repartition(2), 3, [seed], 4)
        assert np.allclose(alone[0], together[at]) and cost[0] == pytest.approx(costs[at])


def test_far_rows_are_drawn_and_even_draws_are_even(spark):
    x = np.zeros((500, 2))
    x[3], x[400] = (50, 0), (0, 60)
    rows = mixture._drawn(made(spark, x), np.zeros((4, 1, 2)), 6, [1, 2, 3, 4], 1, "feat", "spot_id")
    assert all(sorted(map(tuple, r)) == [(0, 60), (50, 0)] for r in rows)
    marked = np.arange(400.0)[:, None]
    firsts = mixture._drawn(made(spark, marked), None, 1, list(range(200)), 0, "feat", "spot_id")
    values = np.array([f[0, 0] for f in firsts])
    assert 160 < values.mean() < 240 and len(set(values)) > 120


def test_odd_tables(spark):
    centres, cost = mixture.kmeans(made(spark, [(1, 2)] * 30), 3)
    assert cost == 0 and np.allclose(centres, (1, 2))
    centres, cost = mixture.kmeans(made(spark, [(0, 0), None, (4, 4), (4, 4), None]), 2)
    assert cost == 0 and sorted(map(tuple, centres)) == [(0, 0), (4, 4)]
    for x in ([], [None, None]):
        with pytest.raises(ValueError, match="no row"):
            mixture.kmeans(made(spark, x), 2)
    rng = np.random.default_rng(6)
    x = [*rng.normal(0, 1, (60, 2)), None, *rng.normal(9, 1, (60, 2))]
    model, history = mixture.fit_tied(made(spark, x), 2)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))
    pred = [r.pred for r in mixture.predict(made(spark, x), model).orderBy("spot_id").collect()]
    assert pred[60] is None and len(set(pred[:60])) == len(set(pred[61:])) == 1 and pred[0] != pred[-1]
