"""Quantiles by radix selection against NumPy."""

import random

import numpy as np
import pytest

from spotweave.operators import selection

RNG = random.Random(1)
CASES = {
    "one": [3.5],
    "two": [1.0, 2.0],
    "equal": [0.25] * 20_001,
    "two values": [1.0] * 9000 + [1.0 + 2**-52] * 9000,
    "close": [1.0 + k * 2**-52 for k in range(12_001)],
    "signs": [RNG.gauss(0, 1) * 10.0 ** RNG.randint(-300, 300) for _ in range(9000)],
    "zeros": [0.0, -0.0] * 5000 + [1.0, -1.0],
    "ends": [float("-inf"), float("inf"), 1e307, -1e307, 5e-324],
}


@pytest.mark.parametrize("case", CASES)
def test_quantiles(spark, case):
    values = CASES[case]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    for share in (0.0, 0.5, 0.93, 1.0):
        at = share * (len(values) - 1)
        a, b = (sorted(values)[min(int(at) + k, len(values) - 1)] for k in (0, 1))
        assert selection.quantile(df, "v", share) == pytest.approx(a if a == b or at == int(at) else a + (at - int(at)) * (b - a), rel=1e-15, abs=0, nan_ok=True)


def test_no_values_and_nan(spark):
    assert selection.quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert selection.quantile(df, "v", 0.5) == 2.0 and np.isnan(selection.quantile(df, "v", 1.0))


def test_counts_meet_by_key_only(spark):
    df = selection.counted(spark.range(100_000).selectExpr("cast(id as double) v"), "v", [0], 0)
    assert sum(r.n for r in df.collect()) == 100_000
    plan = df._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(which" in plan


def test_images_go_back():
    values = np.array([0.0, 1.5, -1.5, 5e-324, -1e308, float("inf")])
    assert [selection.value_of(int(x)) for x in selection.image(values)] == values.tolist()
