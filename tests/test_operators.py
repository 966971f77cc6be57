"""The library's operators against NumPy and hand-made graphs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import vectors as V
from spotweave.operators import experiment, graph, losses, metrics, mixture, neighbours, preprocess, sampling, tiles
from spotweave.sources import tables


def spots(spark, points, key="spot_id"):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], f"{key} long, x double, y double")


def by_force(points, k, include_self):
    out = set()
    for i, p in enumerate(points):
        d = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, j) for j, q in enumerate(points) if include_self or i != j)
        out |= {(i, j, r) for r, (_, j) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["random", "grid", "one place", "clusters", "line", "few"])
@pytest.mark.parametrize("include_self", [False, True])
def test_grid_neighbours(spark, kind, include_self):
    rng = np.random.default_rng(1)
    points = {"random": rng.normal(size=(120, 2)), "grid": list(itertools.product(range(9), range(9))), "one place": [(1.0, 1.0)] * 30 + [(5.0, 5.0)], "clusters": np.concatenate([rng.normal(size=(60, 2)) * 0.01, rng.normal(size=(40, 2)) + 50, [[1000.0, -3.0]]]), "line": [(i * i, 0) for i in range(30)], "few": [(0, 0), (1, 0)]}[kind]
    points = [tuple(map(float, p)) for p in points]
    got = {(r.i, r.j, r["rank"]) for r in neighbours.grid_neighbours(spots(spark, points), 4, include_self).collect()}
    assert got == by_force(points, 4, include_self)


def test_a_far_point_makes_few_pairs_and_the_plan_is_a_scan(spark):
    rng = np.random.default_rng(3)
    points = [tuple(p) for p in rng.normal(size=(3000, 2))] + [(1e7, 1e7)]
    table = spots(spark, points)
    sample = np.array(points)[np.random.default_rng(1).choice(len(points), 6 * tiles.SAMPLED, replace=False)]
    sizes = np.unique(tiles.Tiles(sample, 6).place(np.array(points))[0], return_counts=True)[1]
    assert np.sum(sizes * sizes) <= 3 * tiles.TILE_ROWS * len(points)  # pairs within tiles
    near = neighbours.grid_neighbours(table, 5)
    assert len(near._jdf.queryExecution().toString()) < 5000
    got = {(r.i, r.j, r["rank"]) for r in near.where("i % 100 = 0 or i = 3000").collect()}
    for i in [*range(0, 3000, 100), 3000]:
        d = sorted(((points[i][0] - q[0]) ** 2 + (points[i][1] - q[1]) ** 2, j) for j, q in enumerate(points) if i != j)
        assert {(i, j, r) for r, (_, j) in enumerate(d[:5], 1)} <= got


def test_block_neighbours_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    feats = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "spot_id long, feat array<double>, batch int")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, int(j), r) for i in range(90) for r, j in enumerate([j for j in np.lexsort((np.arange(90), d[i])) if j != i][:5], 1)}
    for size in (4000, 25):
        assert {(r.i, r.j, r["rank"]) for r in neighbours.block_neighbours(feats, feats, 5, block_rows=size).collect()} == want
    empty = feats.limit(0)
    assert neighbours.block_neighbours(empty, empty, 5).count() == 0 and neighbours.grid_neighbours(spots(spark, []), 3).count() == 0


def test_path_graph_and_products(spark):
    s = spots(spark, [(0, 0), (1, 0), (2.5, 0), (3.5, 0), (10, 0)])
    edges = {(r.i, r.j) for r in graph.place_knn(s, 1).collect()}
    assert edges == {(0, 1), (1, 0), (2, 3), (3, 2), (4, 3), (3, 4)}
    adj = graph.normalize_adj(graph.place_knn(s, 1), s)
    a = np.eye(5)
    for i, j in edges:
        a[i, j] = 1
    n = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    got = np.zeros((5, 5))
    for r in adj.collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, n)
    h = np.arange(10.0).reshape(5, 2)
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(h)], "spot_id long, feat array<double>")
    two = {r.spot_id: r.feat for r in graph.multihop(adj, feats, 2, 2)[2].collect()}
    assert np.allclose([two[i] for i in range(5)], n @ n @ h)
    square = np.zeros((5, 5))
    for r in graph.spgemm(adj, adj).collect():
        square[r.i, r.j] = r.v
    assert np.allclose(square, n @ n)


def test_mutual_neighbours_between_batches(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.9, 0.1], 1), (3, [0.1, 0.9], 1), (4, [0.7, 0.7], 2)]
    feats = spark.createDataFrame(rows, "spot_id long, feat array<double>, batch int")
    got = {(r.i, r.j) for r in graph.mnn_edges(feats, 1).collect()}
    assert {(0, 2), (2, 0), (1, 3), (3, 1)} <= got and all((j, i) in got for i, j in got)


def test_agreement_of_labels(spark):
    rows = [("a", 0), ("a", 0), ("b", 1), ("b", 1), (None, 5), (None, 0)]
    same = metrics.agreement(spark.createDataFrame(rows, "truth string, pred int")).first()
    assert (same.ari, round(same.nmi, 12), same.fms) == (1.0, 1.0, 1.0)
    rng = np.random.default_rng(0)
    t, p = rng.integers(0, 4, 200), rng.integers(0, 3, 200)
    got = metrics.agreement(spark.createDataFrame([(f"L{a}", int(b)) for a, b in zip(t, p, strict=True)], "truth string, pred int")).first()
    pairs = list(itertools.combinations(range(200), 2))
    tp = sum(t[i] == t[j] and p[i] == p[j] for i, j in pairs)
    sa, sb = sum(t[i] == t[j] for i, j in pairs), sum(p[i] == p[j] for i, j in pairs)
    e = sa * sb / len(pairs)
    assert got.ari == pytest.approx((tp - e) / ((sa + sb) / 2 - e)) and got.fms == pytest.approx(tp / math.sqrt(sa * sb))


def test_vote_needs_a_strict_majority(spark):
    s = spots(spark, [(i % 3, i // 3) for i in range(9)]).withColumn("pred", F.when(F.col("spot_id") == 4, 1).otherwise(0))
    got = {r.spot_id: (r.pred_refined, r.votes) for r in metrics.refine(s, s, k=4).collect()}
    assert got[4] == (0, 4) and all(v[0] == 0 for v in got.values())


def test_silhouette_and_ranks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(60):
        a = d[i, y == y[i]].sum() / (np.sum(y == y[i]) - 1)
        b = min(d[i, y == k].mean() for k in range(3) if k != y[i])
        s.append((b - a) / max(a, b))
    feats = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "spot_id long, feat array<double>, pred int")
    assert metrics.silhouette(feats).first()[0] == pytest.approx(np.mean(s))
    found = metrics.signed_ranks(spark.createDataFrame([(x,) for x in (1.0, 2.0, -3.0, 4.0)], "d double"), "d").first()
    assert (found.n, found.w_plus, found.w_minus, found.p) == (4, 7.0, 3.0, pytest.approx(0.625))
    ranked = metrics.ranks_with_ties(spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int"), "v").collect()
    assert sorted(r["rank"] for r in ranked) == [1.0, 2.5, 2.5, 4.0]


def counts(spark, m):
    rows = [("s", f"c{i}", f"g{j:02}", float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, tables.COUNTS)


def test_preprocessing_against_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.poisson(rng.gamma(1.0, 2.0, size=30), size=(80, 30)).astype(float)
    m[:, 0] = 0
    m[:5, 0] = 1
    m[0, 1:] += 1
    c = counts(spark, m)
    assert preprocess.filter_genes(c, 6).where("gene = 'g00'").count() == 0 and preprocess.filter_genes(c, 5).where("gene = 'g00'").count() == 5
    assert preprocess.filter_genes(c, min_counts=6).where("gene = 'g00'").count() == 0
    x = np.log1p(m * 1e4 / m.sum(1, keepdims=True))
    logged = preprocess.log1p(preprocess.normalize_total(c))
    n = spark.createDataFrame([(80,)], "n long")
    moments = preprocess.gene_moments(logged, n)
    got = {r.gene: (r.mean, r.variance) for r in moments.collect()}
    assert all(np.allclose(got[f"g{j:02}"], (x[:, j].mean(), x[:, j].var(ddof=1))) for j in range(30))
    z = np.minimum(10, (x - x.mean(0)) / x.std(0, ddof=1))
    dense = preprocess.dense(preprocess.scale(logged, moments, spark.createDataFrame([(f"c{i}",) for i in range(80)], "spot_id string")))
    by = {r.spot_id: r.feat for r in dense.collect()}
    assert np.allclose([by[f"c{i}"] for i in range(80)], z)
    parts, variances = preprocess.pca(dense, 4)
    values = np.linalg.svd(z - z.mean(0), compute_uv=False)[:4] ** 2 / 79
    got = np.array([r.feat for r in parts.collect()])
    assert np.allclose(variances, values) and np.allclose(got.var(0, ddof=1), values) and np.allclose(got.mean(0), 0)


def test_variable_genes_find_the_odd_one(spark):
    rng = np.random.default_rng(6)
    m = rng.poisson(np.linspace(1, 20, 40), size=(200, 40)).astype(float)
    m[:, 7] = rng.poisson(rng.choice([0.2, 12.0], size=200))
    top = preprocess.variable_genes(counts(spark, m), spark.createDataFrame([(200,)], "n long"), 5).collect()
    assert min(top, key=lambda r: r["rank"]).gene == "g07" and len(top) == 5
    x = np.linspace(0, 1, 50)
    assert np.allclose(preprocess.local_quadratic(x, 1 + x - 2 * x**2)[:, 0], 1 + x - 2 * x**2)


def test_tied_mixture_and_kmeans(spark):
    rng = np.random.default_rng(7)
    spread = np.array([[2.0, 0.9], [0.9, 0.6]])
    x = np.concatenate([rng.multivariate_normal(c, spread * 0.3, 120) for c in ((0, 0), (4, -2), (-3, 4))])
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, feat array<double>")
    model, history = mixture.fit_tied(feats, 3, starts=2)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))
    assert np.allclose(model.covariance, spread * 0.3, atol=0.15)
    pred = np.array([r.pred for r in mixture.predict(feats, model).orderBy("spot_id").collect()])
    assert all(len(set(pred[i : i + 120])) == 1 or np.bincount(pred[i : i + 120]).max() > 115 for i in (0, 120, 240))
    centres, cost = mixture.kmeans(feats, 3)
    assert cost == pytest.approx(sum(np.min(((v - centres) ** 2).sum(1)) for v in x))


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(20, 4)), rng.normal(size=(20, 4))
    rows = spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(a, b, strict=True))], "spot_id long, a array<double>, b array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    logits = unit(a) @ unit(b).T / 0.5
    lse = lambda m, axis: np.log(np.exp(m).sum(axis))
    want = (np.mean(lse(logits, 1) - np.diag(logits)) + np.mean(lse(logits, 0) - np.diag(logits))) / 2
    assert losses.info_nce(rows, "a", "b").first()[0] == pytest.approx(want)
    assert losses.cross_level(rows, "a", "b", "spot").first()[0] == pytest.approx(want)
    assert losses.cross_level(rows, "a", "b").first()[0] == pytest.approx(-np.mean((unit(a) * unit(b)).sum(1)))
    assert losses.cross_level(rows, "a", "b", "none").first()[0] == 0.0
    with pytest.raises(ValueError, match="mode"):
        losses.cross_level(rows, "a", "b", "other")
    bce = lambda x, y: np.mean(np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))))
    w = rng.normal(size=(4, 4))
    form = lambda z, s: ((z @ w) * s).sum(1) + 0.3
    views = rows.withColumn("s", F.transform("b", F.tanh)).withColumn("t", F.transform("a", F.tanh))
    both = np.concatenate([form(a, np.tanh(b)), form(b, np.tanh(a))]), np.concatenate([form(b, np.tanh(b)), form(a, np.tanh(a))])
    assert losses.local_global(views, "a", "s", "b", "t", w.tolist(), 0.3).first()[0] == pytest.approx(bce(both[0], 1) + bce(both[1], 0))
    edges = [(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (0, 7, 0.0), (1, 9, 0.0)]
    cosine = np.array([unit(a)[i] @ unit(a)[j] / 0.5 for i, j, _ in edges])
    got = losses.edge_bce(spark.createDataFrame(edges, "i long, j long, label double"), rows, vector="a").first()[0]
    assert got == pytest.approx(bce(cosine[:3], 1) + bce(cosine[3:], 0))
    three = {k: F.lit(v) for k, v in {"rec": 2.0, "xlevel": -0.5, "edge": 1.0}.items()}
    total = lambda *x, **y: spark.range(1).select(losses.balanced(three, *x, **y)).first()[0]
    assert total("manual") == pytest.approx(20 - 0.15 + 0.1)
    assert total("kendall", log_vars={k: F.lit(0.5) for k in three}) == pytest.approx(2.5 * np.exp(-0.5) + 1.5)
    assert total("init", first={"rec": F.lit(4.0), "xlevel": F.lit(-1.0), "edge": F.lit(2.0)}) == pytest.approx(0.5 - 500 + 0.5)
    assert losses.kl_normal(rows, "a", "b").first()[0] == pytest.approx(np.mean((-0.5 * (1 + b - a * a - np.exp(b))).sum(1)))
    cos = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    assert losses.scaled_cosine_error(rows, "a", "b", 3).first()[0] == pytest.approx(np.mean((1 - cos) ** 3))
    assert losses.mean_squared_error(rows, "a", "b").first()[0] == pytest.approx(np.mean((a - b) ** 2))
    centres = spark.createDataFrame([(0, [0.0] * 4), (1, [1.0] * 4)], "k int, centre array<double>")
    target = losses.sharpened_target(losses.student_t(rows, centres, vector="a")).collect()
    for i in range(20):
        assert sum(r.p for r in target if r.spot_id == i) == pytest.approx(1) and sum(r.q for r in target if r.spot_id == i) == pytest.approx(1)


def test_functions(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], -800.0, 2)], "v array<double>, x double, k int").select(
        V.softmax("v").alias("softmax"), V.argmax("v").alias("argmax"), V.one_hot("k", 3).alias("hot"), V.elu("x").alias("elu"), V.relu("x").alias("relu"), V.sigmoid("x").alias("sigmoid"),
        V.clip("x", -8, 8).alias("clip"), V.bce_with_logits("x", F.lit(1.0)).alias("bce"), V.norm("v").alias("norm"), losses.kl_warm_up(F.lit(3), 100).alias("warm"), losses.hop_prior_kl(F.array(F.lit(0.7), F.lit(0.3)), [0.7, 0.3]).alias("prior"),
    ).first()
    e = np.exp([1, 2, 3])
    assert np.allclose(row.softmax, e / e.sum()) and row.argmax == 2 and row.hot == [0.0, 0.0, 1.0]
    assert (row.elu, row.relu, row.sigmoid, row.clip, row.bce) == (-1.0, 0.0, 0.0, -8.0, 800.0)
    assert row.norm == pytest.approx(math.sqrt(14)) and row.warm == pytest.approx(3 / 25) and row.prior == 0


def test_sources_and_experiment(spark, tmp_path):
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "a")], "pos int, gene string")
    assert [r.gene for r in tables.unique_names(genes).orderBy("pos").collect()] == ["a", "b", "a-1", "a-2"]
    (tmp_path / "metadata.tsv").write_text("barcode\tlayer_guess_reordered\trow\tcol\timagecol\timagerow\nb1\tL1\t1\t2\t3.5\t4.5\nb2\tNA\t1\t3\t5\t6\n")
    meta = tables.read_metadata(spark, str(tmp_path / "metadata.tsv"))
    assert [(r.spot_id, r.x, r.y, r.ground_truth) for r in meta.collect()] == [("b1", 3.5, 4.5, "L1"), ("b2", 5.0, 6.0, None)]
    known = spark.createDataFrame([("b1",), ("b9",)], "spot_id string")
    with pytest.raises(Exception, match="no metadata for b9"):
        tables.strict_lookup(known, meta, "spot_id").collect()
    runs = spark.createDataFrame([("m", "151507", 0, 1.0, 0.5, 0.6, 0.7, 0.5, 0.6, 0.7)], tables.RUNS)
    tables.append_runs(runs, str(tmp_path / "runs"))
    tables.append_runs(runs.withColumn("seed", F.lit(1)), str(tmp_path / "runs"))
    done = tables.read_runs(spark, str(tmp_path / "runs"))
    by_donor = metrics.summary(done.join(tables.slices(spark), "slice"), "donor").collect()
    assert [(r.method, r.donor, r.median_ari, r.n_runs) for r in by_donor] == [("m", 1, 0.5, 2)]
    jobs = experiment.job_grid(spark.createDataFrame([("m",), ("baseline_x",)], "method string"), tables.slices(spark).where("donor = 1").select("slice"), spark.createDataFrame([(0,), (1,)], "seed int"))
    assert jobs.count() == 16 and experiment.pending(jobs, done).count() == 14
    assert {r.model for r in jobs.where("method = 'baseline_x'").collect()} == {"baseline"}
    variants = experiment.parse_variants(spark.createDataFrame([('a={"fusion": false, "odd=": 1}',)], "line string"))
    assert variants.first().name == "a" and experiment.unknown_options(variants).first().unknown == ["odd="]
    tables.write_cache(spark.createDataFrame([("151507", 1)], "slice string, v int"), str(tmp_path / "cache"), 20, 0)
    assert tables.read_cache(spark, str(tmp_path / "cache"), 20, 0).count() == 1 and tables.read_cache(spark, str(tmp_path / "cache"), 20, 0).first().slice == "151507"
    rows = spark.range(1000).withColumnRenamed("id", "spot_id")
    for share in (0.0, 0.001, 0.5, 0.8, 1.0):
        assert sampling.exact_mask(rows, share, 1).where("masked").count() == int(share * 1000)
    assert sorted(r["at"] for r in sampling.numbered(rows, 2).select("at").collect()) == list(range(1000))
    far = rows.select((F.col("spot_id") * 17 + 5).alias("spot_id"))  # ids with gaps
    edges = far.select(F.col("spot_id").alias("i"), (F.col("spot_id") + 17).alias("j"))
    drawn = sampling.negative_edges(edges, far, 1).collect()
    known = {r.spot_id for r in far.collect()}
    assert sorted(r.i for r in drawn) == sorted(known) and {r.j for r in drawn} <= known and len({r.j for r in drawn}) > 500
    assert 240 < rows.where(sampling.bernoulli_mask(0.3, "spot_id", F.lit(2))).count() < 360
    assert sorted(r[0] for r in sampling.permuted(rows.withColumn("feat", F.col("spot_id")), 3).select("feat").collect()) == list(range(1000))


def test_silhouette_of_more_rows_than_the_sample(spark):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(5600, 3)), rng.integers(0, 3, 5600)
    x[label == 1] += 2.0
    feats = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, label, strict=True))], "spot_id long, feat array<double>, pred long")
    s = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        sums, sizes = np.bincount(label, weights=d), np.bincount(label)
        a = sums[label[i]] / (sizes[label[i]] - 1)
        b = min(sums[k] / sizes[k] for k in range(3) if k != label[i])
        s.append((b - a) / max(a, b))
    assert metrics.silhouette(feats, sample=None).first()[0] == pytest.approx(np.mean(s), abs=1e-9)
    few = feats.limit(300).cache()
    assert metrics.silhouette_of_all(few, block_rows=70).first()[0] == pytest.approx(metrics.silhouette(few).first()[0], abs=1e-9)


def test_silhouette_sends_each_row_to_few_blocks(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(2600, 2)), rng.integers(0, 3, 2600)
    feats = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, label, strict=True))], "spot_id long, feat array<double>, pred long")
    many = metrics.silhouette_of_all(feats, block_rows=50)  # 52 blocks, were there no bound
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert f", {metrics.FEW_BLOCKS}) as int) AS own" in plan, plan
    assert many.first()[0] == pytest.approx(metrics.silhouette_of_all(feats).first()[0], abs=1e-9)
