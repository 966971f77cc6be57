"""Z-scores of all spots and genes: in passes of few genes, against NumPy, and as vectors; terms of a text stay where it is."""

import numpy as np
import pytest

from spotweave.operators import preprocess
from spotweave.plans import catalog, fixtures


def test_scale_in_passes_against_numpy(spark):
    rng = np.random.default_rng(8)
    m = rng.poisson(0.6, size=(40, 33)).astype(float)
    m[3] = 0
    m[:, 5] = 1
    rows = [(f"s{i:02}", f"g{j:02}", v) for i, r in enumerate(m) for j, v in enumerate(r.tolist()) if v]
    values = spark.createDataFrame(rows, "spot_id string, gene string, x double")
    spots = spark.createDataFrame([(f"s{i:02}",) for i in range(40)], "spot_id string")
    moments = preprocess.gene_moments(values, spark.createDataFrame([(40,)], "n long"))
    sd = m.std(0, ddof=1)
    want = np.minimum(1.5, (m - m.mean(0)) / np.where(sd > 1e-9, sd, 1.0))
    got = preprocess.scale(values, moments, spots, high=1.5, most=10).collect()  # four passes: no number of genes is too many
    assert len(got) == m.size
    found = np.full(m.shape, np.nan)
    for r in got:
        found[int(r.spot_id[1:]), int(r.gene[1:])] = r.z
    assert np.allclose(found, want, atol=1e-9)
    vectors = {r.spot_id: r.feat for r in preprocess.scaled(values, moments, spots, high=1.5).collect()}
    assert np.allclose([vectors[f"s{i:02}"] for i in range(40)], want, atol=1e-9)


def test_a_spot_that_has_a_gene_twice_keeps_both(spark):
    values = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (2, "b", 1.0)], "spot_id long, gene string, x double")
    moments = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], "gene string, mean double, variance double")
    got = preprocess.scale(values, moments, spark.createDataFrame([(1,), (2,), (None,)], "spot_id long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 1.0), (None, "a", 0.0), (None, "b", 0.0)], key=str)


def test_scaled_query_has_every_kept_gene(spark):
    d = "/root/testdata/sf0.001"
    genes = catalog.queries()["fil1_min_cells"](spark, d).count()
    assert catalog.queries()["st4_scale_clip"](spark, d).count() == genes * spark.read.parquet(f"{d}/documents.parquet").count()


def test_rows_go_gene_by_gene(spark):
    """A gene's rows stand together in a task, so that a file holds its zeros' z-score once and not once for each spot."""
    values = spark.createDataFrame([(i, f"g{j}", float(1 + (i + j) % 5)) for i in range(60) for j in range(20) if (i * j) % 7 == 1], "spot_id long, gene string, x double")
    moments = preprocess.gene_moments(values, spark.createDataFrame([(60,)], "n long"))
    got = preprocess.scale(values, moments, spark.range(60).withColumnRenamed("id", "spot_id"), digits=5).collect()
    genes = [r.gene for r in got]
    assert len(got) == 60 * len(set(genes)) and 1 + sum(a != b for a, b in zip(genes, genes[1:])) == len(set(genes))
    exact = {(r.spot_id, r.gene): r.z for r in preprocess.scale(values, moments, spark.range(60).withColumnRenamed("id", "spot_id")).collect()}
    assert all(abs(r.z - exact[r.spot_id, r.gene]) <= 5.0001e-6 and r.z == round(r.z, 5) for r in got)


@pytest.mark.parametrize("name", ["ag1_normalize_total", "st3_log1p"])
def test_terms_are_not_sent(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert fixtures.counts(spark, "/root/testdata/sf0.001").count()
