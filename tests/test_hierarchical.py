"""The two-level model: gradients by finite differences, and what its options do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import hierarchical, stages, tape

SMALL = {"hid": 6, "f0": 4, "z": 3, "out": 3, "hops": (1, 2), "k": 3, "narrow": 3, "epochs": 4}


@pytest.fixture(scope="module")
def spots(spark):
    rng = np.random.default_rng(1)
    rows = [(3 * i + 1, rng.normal(size=5).tolist(), float(rng.normal()), float(rng.normal()), i % 2) for i in range(14)]
    return spark.createDataFrame(rows, "spot_id long, feat array<double>, x double, y double, batch int").coalesce(2)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    small = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}  # many short jobs
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tape_against_finite_differences():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))

    def f(a, b):
        a, b = tape.Var(a), tape.Var(b)
        h = tape.elu(tape.layer_norm(a @ b, tape.Var(np.ones((1, 3)) * 1.5), tape.Var(np.zeros((1, 3)))))
        s = tape.softmax(tape.concat([tape.tanh(h), tape.sigmoid(a)]))
        out = tape.unit(s[:, :3] * a + tape.clamp(h, -0.5, 0.5)) + tape.softplus(a) / (tape.exp(h) + 1.0) - tape.where(np.array([1, 0, 1, 0]), h, a) * tape.relu(h)
        return tape.total(out * tape.log(out * out + 1.0)), a, b

    y, a, b = f(x, w)
    tape.backward([(y, np.array(1.0))])
    for m, v, which in ((x, a, 0), (w, b, 1)):
        for at in np.ndindex(m.shape):
            up, down = m.copy(), m.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            pair = [(up, w) if which == 0 else (x, up), (down, w) if which == 0 else (x, down)]
            slope = (f(*pair[0])[0].value - f(*pair[1])[0].value) / 2e-6
            assert v.grad[at] == pytest.approx(float(slope), abs=1e-6, rel=1e-5)


@pytest.mark.parametrize("options", [{}, {"fusion": False, "xlevel": "none", "balance": "init", "dropout": 0.0}, {"xlevel": "nbr", "n_contrast": 9, "local_global": False, "auto_balance": False, "batch_decoder": False}])
def test_gradients_of_the_whole_model(spots, options):
    model = hierarchical.Model(spots, hierarchical.Config(**SMALL | {"beta": 0.5} | options))
    rng = np.random.default_rng(2)
    model.params = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in model.params.items()}
    own = stages.flatten(model.params)
    values, grads = model.value_and_gradients(2)
    used = np.concatenate([np.ones(v.size) * (k != "logvars" or model.c.auto_balance and model.c.balance == "kendall") for k, v in sorted(model.params.items())])
    direction = rng.normal(size=len(own)) * used

    def total(p):
        model.params = stages.unflatten(p, model.params)
        return model.total(model._losses(model._forward(2), 2, None)[0], 2)

    assert total(own) == pytest.approx(model.total(values, 2))
    step = 1e-5
    slope = (total(own + step * direction) - total(own - step * direction)) / (2 * step)
    assert slope == pytest.approx(float(stages.flatten(grads) @ direction), rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("options", [{}, {"fusion": False, "xlevel": "none", "local_global": False, "batch_decoder": False}])
def test_blocks_give_the_gradients_of_joins(spark, options):
    rng = np.random.default_rng(4)
    rows = [(5 * i, rng.normal(size=5).tolist(), float(i // 10) + 0.1 * rng.random(), float(i % 10) + 0.1 * rng.random(), int(i % 10 > 4)) for i in range(100)]
    table = spark.createDataFrame(rows, "spot_id long, feat array<double>, x double, y double, batch int")
    model = hierarchical.Model(table.drop("batch") if options else table, hierarchical.Config(**SMALL | {"mnn_k": 1} | options), block_nodes=25 if options else 4000)
    if options:
        assert model.held.where("own").count() == 100 < model.held.count() and model.held.select("block").distinct().count() >= 3
    values, grads = model.value_and_gradients(1)
    want, other = model.value_and_gradients_by_joins(1)
    assert values == pytest.approx(want) and stages.flatten(grads) == pytest.approx(stages.flatten(other), rel=1e-8, abs=1e-11)


def test_halos_that_are_too_large_leave_products_to_joins(spots):
    model = hierarchical.Model(spots, hierarchical.Config(**SMALL), block_nodes=2)
    assert model.held is None and model._by_blocks() is None


def test_training_embedding_and_attention(spots):
    c = hierarchical.Config(**SMALL | {"epochs": 3, "rate": 0.02, "refine_graph": True, "refine_at": (0.4,)})
    seen = []
    model = hierarchical.Model(spots, c).fit(lambda epoch, values: seen.append((epoch, values["rec"])))
    assert [e for e, _ in seen] == [0, 1, 2] and np.isfinite([v for _, v in seen]).all()
    again = hierarchical.Model(spots.repartition(5), c).fit()
    assert [h["rec"] for h in again.history] == pytest.approx([v for _, v in seen])
    z = {r.spot_id: r.z for r in model.embed().collect()}
    assert len(z) == 14 and all(len(v) == 3 for v in z.values())
    rows = model.attention().collect()
    assert all(len(r.hop_level1) == 2 and len(r.hop_level2) == 3 and len(r.levels) == 3 for r in rows)
    assert all(sum(r[k]) == pytest.approx(1) for r in rows for k in ("hop_level1", "hop_level2", "levels"))
    plain = hierarchical.Model(spots.drop("batch"), hierarchical.Config(**SMALL | {"fusion": False, "adaptive_hops": False, "expr_graph": False}))
    assert plain.weights.agg(F.min("w")).first()[0] == 1.0 and plain.attention().columns == ["spot_id", "hop_level1", "hop_level2"]
    assert len(plain.embed().first().z) == 4 + 2 * 3
    with pytest.raises(ValueError, match="xlevel"):
        hierarchical.Config(xlevel="other")
    with pytest.raises(TypeError):
        hierarchical.Config(unknown=True)
