"""The baseline: gradients by finite differences, both phases, and runs from loading to the record."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave import runner
from spotweave.operators import baseline, hierarchical, stages
from spotweave.sources import slices, tables

SMALL = {"n_clusters": 2, "hidden1": 5, "hidden2": 4, "graph1": 4, "graph2": 2, "k": 3}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    small = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}  # many short jobs
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def spots(spark):
    rng = np.random.default_rng(1)
    rows = [(3 * i + 1, rng.normal(size=5).tolist(), float(rng.normal()), float(rng.normal())) for i in range(14)]
    return spark.createDataFrame(rows, "spot_id long, feat array<double>, x double, y double").coalesce(2)


def test_gradients_of_the_baseline(spots):
    model = baseline.Model(spots, baseline.Config(**SMALL))
    rng = np.random.default_rng(2)
    model.params = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in model.params.items()}
    model.renew_target(0)
    assert all(sum(r.target) == pytest.approx(1) for r in model.target.collect())
    weights = {"mse": 10.0, "graph": 0.1, "self": 1.0, "dec": 1.0}
    own = stages.flatten(model.params)
    grads = model.value_and_gradients(2, weights)[1]
    direction = rng.normal(size=len(own))

    def total(p):
        model.params = stages.unflatten(p, model.params)
        values = model.value_and_gradients(2, weights, gradients=False)[0]
        return sum(weights[k] * values[k] for k in weights)

    slope = (total(own + 1e-5 * direction) - total(own - 1e-5 * direction)) / 2e-5
    assert slope == pytest.approx(float(stages.flatten(grads) @ direction), rel=1e-4, abs=1e-6)


def test_both_phases(spots):
    model = baseline.Model(spots, baseline.Config(**SMALL, first_epochs=2, second_epochs=2, interval=2)).fit()
    assert len(model.history) == 4 and all(np.isfinite(v) for h in model.history for v in h.values())
    assert model.history[0]["dec"] == 0 and model.target is not None
    assert (model.running["enc1"][0] != 0).any()
    rows = model.embed().collect()
    assert len(rows) == 14 and all(len(r.z) == 4 + 2 * 2 for r in rows)


def test_runs_from_the_files_to_the_record(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    names = ["151507", "151508"]
    m = rng.poisson(4, size=(2, 60, 12))
    rows = [(s, f"b{i}", f"g{j}", float(v)) for n, s in enumerate(names) for i in range(60) for j, v in enumerate(m[n, i]) if v and not (n and j == 11)]
    spark.createDataFrame(rows, tables.COUNTS).write.partitionBy("slice").parquet(str(tmp_path / "counts"))
    for s in names:
        (tmp_path / s).mkdir()
        lines = [f"b{i}\t{'NA' if i == 0 else f'L{i % 3}'}\t{i // 8}\t{i % 8}\t{i % 8}\t{i // 8}" for i in range(60)]
        (tmp_path / s / "metadata.tsv").write_text("\n".join(["barcode\tlayer_guess_reordered\trow\tcol\timagecol\timagerow", *lines]) + "\n")
    one = slices.load_slice(spark, str(tmp_path), "151507", n_pcs=4, n_top=8)
    assert one.n() == 60 and one.n_clusters == 7 and one.spots.where("label is null").count() == 1 and len(one.spots.first().feat) == 4
    joint = slices.load_joint(spark, str(tmp_path), names[::-1], n_pcs=4, n_top=12)
    assert joint.n() == 120 and joint.slices == ("151508", "151507")
    span = {r.batch: (r.low, r.high) for r in joint.spots.groupBy("batch").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    assert span == {0: (0.0, 7.0), 1: (10.5, 17.5)} and joint.spots.where("batch = 1 and name not like '%-151507'").isEmpty()
    monkeypatch.setattr(runner, "N_PCS", 4)
    monkeypatch.setattr(slices, "clusters_of", lambda s: 3)
    configs = runner.configs_of(['small={"hid": 4, "f0": 3, "z": 2, "out": 2, "hops": [1, 1], "epochs": 1}', 'baseline_small={"hidden1": 4, "hidden2": 3, "graph1": 3, "graph2": 2, "first_epochs": 1, "second_epochs": 0}'])
    args = (spark, str(tmp_path), str(tmp_path / "runs"), str(tmp_path / "cache"), ["small", "baseline_small"], names[:1], [0], configs)
    assert runner.run_all(*args, workers=2) == 2
    assert runner.run_all(*args) == 0
    runs = tables.read_runs(spark, str(tmp_path / "runs")).collect()
    assert {(r.method, r.slice, r.seed) for r in runs} == {("small", "151507", 0), ("baseline_small", "151507", 0)} and all(-1 <= r.ARI <= 1 and r.time > 0 for r in runs)
    with pytest.raises(KeyError, match="odd"):
        runner.run_all(spark, str(tmp_path), str(tmp_path / "runs"), str(tmp_path / "cache"), ["odd"], names[:1], [0], configs)
    with pytest.raises(TypeError):
        hierarchical.Config(**{"odd": 1})
