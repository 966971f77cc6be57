"""Gaussian mixture with one covariance for all clusters, and k-means, on distributed rows.

All starts go together: a pass over the rows serves each start that hasn't settled. It broadcasts their parameters (starts
times clusters times width numbers) and adds up, in Arrow, what each start needs; so the jobs follow the rounds, not the
starts. The scatter of all rows is the same in each round and is added up once. Rows without a vector take no part; no row
at all is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.operators import preprocess
from spotweave.sources import shared

#: Rounds of seeding, rows drawn in each for a cluster, buckets that tasks' draws meet in, rows compared at once.
SEEDING, DRAWN, BUCKETS, AT_ONCE = 5, 2, 64, 1000


def _rows(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def _summed(feats: DataFrame, vector: str, partial, width: int) -> np.ndarray:
    """The sum over tasks of the arrays that ``partial(rows)`` gives for blocks of rows."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                total += partial(_rows(batch.slice(at, AT_ONCE)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["p", "s"])

    sums = feats.select(vector).mapInArrow(run, "p long, s double").groupBy("p").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(width)
    out[sums["p"]] = sums["s"]
    return out


def _uniform(h: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes and salts."""
    z = h.copy()
    for salt in salts:
        z = (z ^ np.uint64(salt & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def nearest(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and start (``centres`` is starts by centres by width): the nearest centre and the squared distance."""
    starts, k, d = centres.shape
    flat = centres.reshape(-1, d)
    middle = flat.mean(axis=0)  # far-off rows lose no digits
    x, c = m - middle, flat - middle
    own = np.argmin((np.sum(c * c, axis=1) - 2 * x @ c.T).reshape(len(m), starts, k), axis=2)
    return own, np.sum((m[:, None] - centres[np.arange(starts), own]) ** 2, axis=2)


def _drawn(feats: DataFrame, known: np.ndarray | None, count: int, seeds: list[int], turn: int, vector: str, key: str) -> list[np.ndarray]:
    """For each start ``count`` rows, drawn by their squared distances from its ``known`` centres, or evenly if there are none.

    Rows race: one's time is -ln(u) / distance, u from a hash of its key, and the first are drawn. That is a draw without
    replacement that needs no total beforehand, and a task sends no more than its first ``count`` rows.
    """
    n = len(seeds)

    def run(batches):
        best = [(np.empty(0), None)] * n
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                h, m = batch.column(0).to_numpy().view(np.uint64), _rows(batch, 1)
                far = np.ones((len(m), n)) if known is None else nearest(m, known)[1]
                for s in range(n):
                    able = np.flatnonzero(far[:, s] > 0)
                    times = -np.log(_uniform(h[able], seeds[s], turn)) / far[able, s]
                    times, rows = np.concatenate([best[s][0], times]), m[able] if best[s][1] is None else np.concatenate([best[s][1], m[able]])
                    first = np.argsort(times, kind="stable")[:count]
                    best[s] = times[first], rows[first]
        for s, (times, rows) in enumerate(best):
            if len(times):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(times), s, np.int32)), pa.array(times), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["start", "at", "row"])

    sent = feats.select(F.xxhash64(key), vector).mapInArrow(run, "start int, at double, row array<double>")
    sent = sent.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS)))
    for by in (["start", "bucket"], ["start"]):
        sent = sent.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("at", "row"))).where(F.col("rank") <= count)
    rows = sent.select("start", "rank", "row").collect()  # starts times count
    return [np.array([r["row"] for r in sorted(rows, key=lambda r: r["rank"]) if r["start"] == s]) for s in range(n)]


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres of the weighted candidates: each far from those before, then a few rounds of k-means among them."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.choice(len(points), p=weights / weights.sum())]]
    d2 = np.full(len(points), np.inf)
    for _ in range(1, k):
        d2 = np.minimum(d2, np.sum((points - centres[-1]) ** 2, axis=1))
        mass = d2 * weights
        centres.append(points[rng.choice(len(points), p=mass / mass.sum()) if mass.sum() > 0 else 0])
    out = np.array(centres)
    for _ in range(20):
        hot = np.eye(k)[nearest(points, out[None])[0][:, 0]] * weights[:, None]
        size = hot.sum(axis=0)
        out = np.where(size[:, None] > 0, hot.T @ points / np.maximum(size, 1e-300)[:, None], out)
    return out


def spread_starts(feats: DataFrame, k: int, seeds: list[int], vector: str = "feat", key: str = "spot_id") -> np.ndarray:
    """Starting centres for each seed (starts by ``k`` by width), by rounds of oversampling over all rows.

    A first row is drawn evenly, then ``DRAWN`` * k rows a round far from the rows drawn before. All rows are counted for their
    nearest candidate, and the weighted candidates, some tens for each cluster, become k centres on the driver. Where fewer
    vectors differ than ``k``, some centres are equal.
    """
    held = _drawn(feats, None, 1, seeds, 0, vector, key)
    if not all(len(h) for h in held):
        raise ValueError("no row with a vector")
    known = np.stack(held)
    for turn in range(1, SEEDING + 1):
        more = _drawn(feats, known, DRAWN * k, seeds, turn, vector, key)
        most = max(len(m) for m in more)
        if not most:
            break  # every row is a candidate's equal
        # a start with fewer rows to draw repeats its first candidate, which then counts for none
        known = np.stack([np.concatenate([c, m.reshape(-1, c.shape[1]), np.repeat(c[:1], most - len(m), axis=0)]) for c, m in zip(known, more, strict=True)])
    starts, each, _ = known.shape
    counts = _summed(feats, vector, lambda m: _chosen(nearest(m, known)[0], each).sum(axis=0), starts * each).reshape(starts, each)
    return np.stack([_reduced(c[n > 0], n[n > 0], k, seed) for c, n, seed in zip(known, counts, seeds, strict=True)])


def _chosen(own: np.ndarray, k: int) -> np.ndarray:
    """Ones at each start's chosen centre, else zeros: rows by (starts times k)."""
    return (own[:, :, None] == np.arange(k)).reshape(len(own), -1).astype(float)


def kmeans_starts(feats: DataFrame, k: int, seeds: list[int], rounds: int = 20, vector: str = "feat", key: str = "spot_id") -> tuple[np.ndarray, np.ndarray]:
    """For each seed the centres and the sum of squared distances from just these."""
    feats = feats.where(F.col(vector).isNotNull())
    centres = spread_starts(feats, k, seeds, vector, key)
    d, costs, going = centres.shape[2], np.full(len(seeds), np.inf), np.arange(len(seeds))
    for turn in range(rounds + 1):
        asked = centres[going]

        def partial(m, asked=asked):
            own, d2 = nearest(m, asked)
            hot = _chosen(own, k)
            return np.concatenate([(hot.T @ m).ravel(), hot.sum(axis=0), d2.sum(axis=0)])

        cells = len(going) * k
        sums = _summed(feats, vector, partial, cells * d + cells + len(going))
        totals, n, cost = sums[: cells * d].reshape(-1, k, d), sums[cells * d : -len(going)].reshape(-1, k, 1), sums[-len(going) :]
        moving = (costs[going] - cost > 1e-9 * np.maximum(costs[going], 1)) | np.isinf(costs[going])
        costs[going] = cost
        if turn == rounds or not moving.any():
            break
        centres[going[moving]] = np.where(n > 0, totals / np.maximum(n, 1), asked)[moving]
        going = going[moving]
    return centres, costs


def kmeans(feats: DataFrame, k: int, seed: int = 42, starts: int | None = None, rounds: int = 20, vector: str = "feat", key: str = "spot_id") -> tuple[np.ndarray, float]:
    """Centres and the sum of squared distances: the best of some starts, two for each cluster if nothing else is asked."""
    centres, costs = kmeans_starts(feats, k, [seed + turn for turn in range(2 * k if starts is None else starts)], rounds, vector, key)
    best = int(np.argmin(costs))
    return centres[best], float(costs[best])


class TiedMixture:
    """Weights, means and the covariance that all clusters share."""

    def __init__(self, weights, means, covariance):
        self.weights, self.means, self.covariance = weights, means, covariance

    def log_joint(self, m: np.ndarray) -> np.ndarray:
        root = np.linalg.cholesky(self.covariance)
        z = np.linalg.solve(root, m.T).T
        c = np.linalg.solve(root, self.means.T).T
        d2 = np.sum(z * z, axis=1)[:, None] + np.sum(c * c, axis=1)[None] - 2 * z @ c.T
        constant = -0.5 * m.shape[1] * np.log(2 * np.pi) - np.sum(np.log(np.diag(root)))
        return np.log(self.weights)[None] + constant - 0.5 * d2


def fit_tied(feats: DataFrame, k: int, seed: int = 2023, starts: int = 3, rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-5, vector: str = "feat", key: str = "spot_id") -> tuple[TiedMixture, list[float]]:
    """The mixture with the best likelihood of some starts, and its likelihoods by round."""
    feats = feats.where(F.col(vector).isNotNull())
    centres, _ = kmeans_starts(feats, k, [seed + turn for turn in range(starts)], 10, vector, key)
    d = centres.shape[2]
    fixed = _summed(feats, vector, lambda m: np.concatenate([(m.T @ m).ravel(), m.sum(0), [len(m)]]), d * d + d + 1)
    scatter, n = fixed[: d * d].reshape(d, d), fixed[-1]
    mean = fixed[d * d : -1] / n
    first = scatter / n - np.outer(mean, mean) + floor * np.eye(d)
    models = [TiedMixture(np.full(k, 1 / k), c, first) for c in centres]
    histories: list[list[float]] = [[] for _ in models]
    going = list(range(starts))
    for _ in range(rounds):

        def partial(m, asked=[models[s] for s in going]):
            out = []
            for model in asked:
                joint = model.log_joint(m)
                top = joint.max(1, keepdims=True)
                each = np.exp(joint - top)
                r = each / each.sum(1, keepdims=True)
                out += [(r.T @ m).ravel(), r.sum(0), [np.sum(top[:, 0] + np.log(each.sum(1)))]]
            return np.concatenate(out)

        moving = []
        for s, sums in zip(going, _summed(feats, vector, partial, len(going) * (k * d + k + 1)).reshape(len(going), -1), strict=True):
            size = sums[k * d : -1] + 10 * np.finfo(float).eps
            history = histories[s]
            history.append(float(sums[-1] / n))
            means = sums[: k * d].reshape(k, d) / size[:, None]
            covariance = (scatter - (means.T * size) @ means) / n + floor * np.eye(d)
            models[s] = TiedMixture(size / size.sum(), means, covariance)
            if len(history) < 2 or abs(history[-1] - history[-2]) >= tolerance:
                moving.append(s)
        going = moving
        if not going:
            break
    best = max(range(starts), key=lambda s: histories[s][-1])
    return models[best], histories[best]


def cluster(feats: DataFrame, k: int, seed: int = 2023, n_pcs: int | None = None, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """(spot_id, pred): the likeliest of ``k`` clusters of a fitted mixture; with ``n_pcs``, of that many principal
    components where the vectors are longer."""
    narrow = feats.select(key, F.col(vector).cast("array<double>").alias(vector))
    if n_pcs is not None and len(narrow.select(vector).first()[0]) > n_pcs:
        narrow = shared.written(preprocess.pca(narrow, n_pcs, vector, key)[0])
    return predict(narrow, fit_tied(narrow, k, seed, vector=vector, key=key)[0], vector, key)


def predict(feats: DataFrame, model: TiedMixture, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """(spot_id, pred): the likeliest cluster of each row; null without a vector."""
    held = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            has = batch.column(1).is_valid()
            some = batch.filter(has)
            pred = np.full(batch.num_rows, -1)
            if some.num_rows:
                pred[has.to_numpy(zero_copy_only=False)] = np.argmax(held.value.log_joint(_rows(some, 1)), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.int32(), mask=pred < 0)], names=[key, "pred"])

    return feats.select(key, vector).mapInArrow(run, T.StructType([feats.schema[key], T.StructField("pred", T.IntegerType())]))
