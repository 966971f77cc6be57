"""Unit vectors are worked out once for a row, not again for each component."""

import time

import numpy as np
from pyspark.sql import functions as F

from spotweave.llm import nearest


def test_unit_of_long_vectors(spark):
    x = np.random.default_rng(2).normal(size=(20, 1500))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    began = time.time()
    got = np.array([r.u for r in rows.select("vec_id", nearest.unit(F.col("v")).alias("u")).orderBy("vec_id").collect()])
    assert time.time() - began < 15
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True), rtol=1e-12)
