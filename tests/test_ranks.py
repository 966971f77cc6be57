"""Average ranks and signed-rank tests against enumeration and Python's sort."""

import itertools
import random

import pytest

from spotweave.operators import metrics


def ranks_by_force(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_ranks_of_groups_and_of_all(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([7, rng.randint(0, 400)])) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, id long, v long").repartition(6)
    for by in ([], ["g"]):
        got = {r.id: r["rank"] for r in metrics.ranks_with_ties(df, "v", *by).collect()}
        for g in {r[0] for r in rows} if by else [0]:
            own = [r for r in rows if not by or r[0] == g]
            assert [got[r[1]] for r in own] == ranks_by_force([r[2] for r in own])


def p_by_force(d):
    d = [x for x in d if x]
    ranks = ranks_by_force([abs(x) for x in d])
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return plus, min(1.0, 2 * min(sum(s <= plus for s in sums), sum(s >= plus for s in sums)) / len(sums))


def test_exact_shares(spark):
    rng = random.Random(2)
    groups = {k: [rng.choice([-3, -2, -1, 0, 0.5, 1, 2, 4, 4]) * rng.choice([1.0, 1.25]) for _ in range(n)] for k, n in enumerate([1, 2, 5, 9, 12])}
    rows = [(k, float(x)) for k, own in groups.items() for x in own] + [(0, None), (1, float("nan")), (77, 0.0)]
    got = {r.k: r for r in metrics.signed_ranks(spark.createDataFrame(rows, "k long, d double"), "d", "k").collect()}
    assert set(got) == {k for k, own in groups.items() if any(own)}
    for k, r in got.items():
        plus, p = p_by_force(groups[k])
        assert (r.w_plus, r.w_plus + r.w_minus) == (plus, r.n * (r.n + 1) / 2) and r.p == pytest.approx(p)


def test_many_pairs_follow_the_normal_law(spark):
    rng = random.Random(3)
    d = [rng.gauss(0.08, 1) for _ in range(metrics.EXACT_PAIRS)]
    exact = metrics.signed_ranks(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    more = metrics.signed_ranks(spark.createDataFrame([(x,) for x in d * 3], "d double"), "d").first()
    assert 0 < exact.p < 1 and more.n == 3 * metrics.EXACT_PAIRS and 0 < more.p < exact.p
    ranks = [2 * k for k in range(1, 101)]
    import math

    z = (2600 - 2525) / math.sqrt(100 * 101 * 201 / 24)
    assert metrics.null_share(ranks, 5200) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.005)
