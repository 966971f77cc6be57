"""The baseline: an encoder with batch norms, two graph blocks of one and two hops, and a clustering phase.

The steps are those of ``stages``. Batch norm takes means and variances over all rows: they are aggregated, go into the
next part as parameters, and their gradients go back to the rows by what each row adds to them. Running values serve
where nothing is drawn. The first phase learns to rebuild the features of masked spots, the graph and like levels; the second
pulls the embedding to its k-means centres, with targets renewed every ``interval`` epochs.

The mask is on floor(rate n) spots, to whose features a token is added, also when the embedding is taken, unless
``deterministic_eval``. A level's second draw, not that which the next level took, is in the embedding. Logarithms of
deviations are learned, where the other model learns those of variances.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import graph, mixture, sampling, stages, tape
from spotweave.sources import shared

BATCH_EPS, MOMENTUM = 1e-3, 0.01
#: The shares of the hops that a penalty pulls to, and weights of the phases' losses.
HOP_PRIOR, HOP_WEIGHT = np.array([[0.7, 0.3]]), 0.15
FIRST, SECOND = {"mse": 10.0, "graph": 0.1, "self": 1.0, "dec": 0.0}, {"mse": 10.0, "graph": 0.1, "self": 0.0, "dec": 1.0}
VALUES = ("mse", "self", "dec", "kl")


@dataclass(frozen=True)
class Config:
    """Options of a run, with the baseline's own values."""

    n_clusters: int = 7
    hidden1: int = 64
    hidden2: int = 16
    graph1: int = 64
    graph2: int = 12
    k: int = 6
    dropout: float = 0.2
    mask: float = 0.8
    similarity: float = 0.3
    first_epochs: int = 200
    second_epochs: int = 200
    interval: int = 20
    rate: float = 0.005
    decay: float = 0.01
    deterministic_eval: bool = False
    seed: int = 0

    @property
    def latent(self) -> int:
        return self.hidden2 + 2 * self.graph2


def start(width: int, c: Config) -> stages.Params:
    rng = np.random.default_rng(c.seed)
    p: stages.Params = {}
    xavier = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    for name, a, b in (("enc1", width, c.hidden1), ("enc2", c.hidden1, c.hidden2)):
        p[f"{name}.w"], p[f"{name}.b"] = rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, (1, b)) / np.sqrt(a)
        p[f"{name}.scale"], p[f"{name}.shift"] = np.ones((1, b)), np.zeros((1, b))
    for name, a in (("one", c.hidden2), ("two", c.graph2)):
        p[f"{name}.w"], p[f"{name}.hops"] = xavier(a, c.graph1), np.array([[1.2, 0.0]])
        if a != c.graph1:
            p[f"{name}.res.w"], p[f"{name}.res.b"] = xavier(a, c.graph1), np.zeros((1, c.graph1))
        p[f"{name}.mean"], p[f"{name}.logstd"] = xavier(c.graph1, c.graph2), xavier(c.graph1, c.graph2)
    p["dec.w"] = xavier(c.latent, width)
    p["centres"] = xavier(c.n_clusters, c.latent)
    p["token"] = np.zeros((1, width))
    return p


class Parts:
    """The row-wise parts of one epoch. ``train`` False: without dropout and noise."""

    def __init__(self, c: Config, epoch: int, train: bool):
        self.c, self.epoch, self.train = c, epoch, train

    def drop(self, x: tape.Var, ids: np.ndarray, label: int) -> tape.Var:
        if not self.train or not self.c.dropout:
            return x
        kept = stages.uniforms(ids, x.value.shape[1], self.c.seed, self.epoch, label) >= self.c.dropout
        return x * (kept / (1 - self.c.dropout))

    def draw(self, x: tape.Var, ids: np.ndarray, label: int) -> tape.Var:
        mean, logstd = x[:, : self.c.graph2], x[:, self.c.graph2 :]
        if not self.train:
            return mean
        return mean + stages.normals(ids, self.c.graph2, self.c.seed, self.epoch, label) * tape.exp(logstd)

    def enter(self, p, x, ids):
        """x, masked -> u: the token is added to masked rows; the first linear map."""
        return {"u": (x["x"] + p["token"] * x["masked"].value) @ p["enc1.w"] + p["enc1.b"]}

    def block(self, name: str, ids, p, u, label: int) -> tape.Var:
        """Batch norm by the given means and variances, ELU, dropout."""
        normed = (u - p["mean"]) / (p["var"] + BATCH_EPS).power(0.5)
        return self.drop(tape.elu(normed * p[f"{name}.scale"] + p[f"{name}.shift"]), ids, label)

    def middle(self, p, x, ids):
        """u -> u of the second block."""
        return {"u": self.block("enc1", ids, p, x["u"], 11) @ p["enc2.w"] + p["enc2.b"]}

    def _into(self, p, name, x, ids, label):
        """What goes through the hops, and the residual beside it."""
        residual = x @ p[f"{name}.res.w"] + p[f"{name}.res.b"] if f"{name}.res.w" in p else x
        return self.drop(x, ids, label) @ p[f"{name}.w"], residual

    def features(self, p, x, ids):
        """u -> f, s, r."""
        f = self.block("enc2", ids, p, x["u"], 12)
        s, r = self._into(p, "one", f, ids, 13)
        return {"f": f, "s": s, "r": r}

    def heads(self, name: str, label: int):
        """stack, r -> m: mean and log deviation before their product."""

        def part(p, x, ids):
            n = self.c.graph1
            w = tape.softmax(p[f"{name}.hops"])
            h = tape.relu(x["stack"][:, n : 2 * n] * w[:, 0:1] + x["stack"][:, 2 * n :] * w[:, 1:2] + x["r"])
            return {"m": tape.concat([self.drop(h, ids, label) @ p[f"{name}.mean"], self.drop(h, ids, label + 1) @ p[f"{name}.logstd"]])}

        return part

    def second(self, p, x, ids):
        """m1 -> s, r of the second level, from the first draw."""
        s, r = self._into(p, "two", self.draw(x["m1"], ids, 21), ids, 22)
        return {"s": s, "r": r}

    def latent(self, p, x, ids):
        """f, m1, m2 -> z, d (before its product), both levels' draws."""
        g1, g2 = self.draw(x["m1"], ids, 31), self.draw(x["m2"], ids, 32)
        z = tape.concat([x["f"], g1, g2])
        return {"z": z, "d": self.drop(z, ids, 33) @ p["dec.w"], "g": tape.concat([g1, g2])}

    def soft(self, p, z: tape.Var) -> tape.Var:
        """Student-t shares of the centres."""
        apart = []
        for k in range(self.c.n_clusters):
            diff = z - p["centres"][k : k + 1, :]
            apart.append((tape.total(diff * diff, 1) + 1.0).power(-1.0))
        q = tape.concat(apart)
        return q / tape.total(q, 1)

    def loss(self, n_rows: int, n_masked: int):
        """x, masked, out, z, g, m1, m2, target -> loss: the row's share of VALUES."""
        c = self.c

        def part(p, x, ids):
            masked = x["masked"].value
            inp = x["x"] + p["token"] * masked
            diff = x["out"] - x["x"]
            mse = tape.total(diff * diff, 1) * (1 / (n_rows * diff.value.shape[1]))
            error = tape.var(1.0) - tape.total(tape.unit(x["out"]) * tape.unit(inp), 1)
            alike = tape.total(tape.unit(x["g"][:, : c.graph2]) * tape.unit(x["g"][:, c.graph2 :]), 1)
            own = error * error * error * (masked / max(n_masked, 1)) - alike * (c.similarity / n_rows)
            kl = tape.var(np.zeros((len(ids), 1)))
            for m in (x["m1"], x["m2"]):
                mean, s = m[:, : c.graph2], m[:, c.graph2 :]
                kl = kl + tape.total(s * 2.0 + 1.0 - mean * mean - tape.exp(s * 2.0), 1) * (-0.5 / n_rows / n_rows)
            target = x["target"].value
            known = np.where(target > 0, target, 1.0)
            dec = tape.total((tape.var(np.log(known)) - tape.log(self.soft(p, x["z"]))) * target, 1) * (1 / (n_rows * c.n_clusters))
            return {"loss": tape.concat([mse, own, dec, kl])}

        return part


def _pair_part(scale: float, n_pairs: int):
    def part(p, x, ids):
        logit = tape.total(x["a"] * x["b"], 1)
        return {"loss": (tape.softplus(logit) - logit * x["label"].value) * (scale / n_pairs)}

    return part


def _of_rows(p, x, ids):
    """Gradients of u: its own, and by its share in the means and variances."""
    return {"d_u": x["d_u"] + p["d_mean"] + (x["u"] - p["mean"]) * p["d_var"]}


class Model:
    """A baseline of ``spots`` (``spot_id`` long, ``feat``, ``x``, ``y``)."""

    def __init__(self, spots: DataFrame, c: Config):
        self.c, self.n = c, spots.count()
        self.spots = shared.written(spots.select("spot_id", F.col("feat").cast("array<double>").alias("feat"), "x", "y"))
        self.width = len(self.spots.select("feat").first()[0])
        edges = shared.written(graph.place_knn(self.spots, c.k))
        self.adj = shared.written(graph.normalize_adj(edges, self.spots))
        positive = shared.written(graph.with_loops(edges, self.spots).select("i", "j"))
        negative = sampling.negative_edges(positive, self.spots, None)
        self.pairs = shared.written(positive.withColumn("label", F.lit(1.0)).union(negative))
        self.n_pairs = self.pairs.count()
        held = positive.count()
        self.scale = self.n * self.n / (2 * max(self.n * self.n - held, 1))
        self.params = start(self.width, c)
        self.running = {name: (np.zeros((1, size)), np.ones((1, size))) for name, size in (("enc1", c.hidden1), ("enc2", c.hidden2))}
        self.target: DataFrame | None = None
        self.history: list[dict[str, float]] = []

    def _statistics(self, rows: DataFrame, name: str, width: int, train: bool) -> stages.Params:
        """Means and variances of ``u`` over all rows, or the running ones."""
        if not train:
            mean, var = self.running[name]
            return {"mean": mean, "var": var}
        sums = rows.select(F.posexplode("u").alias("at", "u")).groupBy("at").agg(F.avg("u").alias("m"), F.var_pop("u").alias("v")).toPandas()  # width rows
        mean, var = np.zeros((1, width)), np.zeros((1, width))
        mean[0, sums["at"]], var[0, sums["at"]] = sums["m"], sums["v"]
        return {"mean": mean, "var": var}

    def _forward(self, epoch: int, train: bool, masked: bool = True) -> dict:
        c, parts, p = self.c, Parts(self.c, epoch, train), self.params
        flagged = sampling.exact_mask(self.spots, c.mask if masked else 0.0, c.seed * 100_003 + epoch)
        t: dict = {"rows": shared.written(flagged.select(F.col("spot_id").alias("id"), F.col("feat").alias("x"), F.array(F.col("masked").cast("double")).alias("masked")))}
        t["u1"] = stages.forward(t["rows"], parts.enter, p, ["x", "masked"], ["u"])
        t["s1"] = self._statistics(t["u1"], "enc1", c.hidden1, train)
        t["u2"] = stages.forward(t["u1"], parts.middle, p | t["s1"], ["u"], ["u"])
        t["s2"] = self._statistics(t["u2"], "enc2", c.hidden2, train)
        t["f"] = stages.forward(t["u2"], parts.features, p | t["s2"], ["u"], ["f", "s", "r"])
        for level, source in (("1", "f"), ("2", "v")):
            if level == "2":
                t["v"] = stages.forward(t["m1"], parts.second, p, ["m1"], ["s", "r"])
            stack = stages.hops(self.adj, t[source], "s", c.graph1, 2)
            t[f"h{level}"] = shared.written(stack.join(t[source].select("id", "r"), "id"))
            m = stages.forward(t[f"h{level}"], parts.heads("one" if level == "1" else "two", 14 if level == "1" else 24), p, ["stack", "r"], ["m"])
            t[f"m{level}"] = stages.product(self.adj, m, "m", 2 * c.graph2).withColumnRenamed("m", f"m{level}")
        t["in"] = shared.written(t["f"].select("id", "f").join(t["m1"], "id").join(t["m2"], "id"))
        t["z"] = stages.forward(t["in"], parts.latent, p, ["f", "m1", "m2"], ["z", "d", "g"])
        return t

    def _end(self, t: dict) -> DataFrame:
        out = stages.product(self.adj, t["z"], "d", self.width).withColumnRenamed("d", "out")
        target = self.target if self.target is not None else t["z"].select("id", F.array_repeat(F.lit(0.0), self.c.n_clusters).alias("target"))
        rows = t["z"].select("id", "z", "g").join(out, "id").join(t["rows"], "id").join(t["in"].select("id", "m1", "m2"), "id").join(target, "id")
        return shared.written(rows)

    def value_and_gradients(self, epoch: int, weights: dict[str, float], gradients: bool = True) -> tuple[dict[str, float], stages.Params | None, dict]:
        """The losses of an epoch's draws, the gradients of their weighted sum, and the statistics of the batch norms."""
        c, p, parts = self.c, self.params, Parts(self.c, epoch, True)
        t = self._forward(epoch, True)
        rows = self._end(t)
        inputs = ["x", "masked", "out", "z", "g", "m1", "m2", "target"]
        w = {"mse": weights["mse"], "self": weights["self"], "dec": weights["dec"], "kl": weights["graph"]}
        upstream = F.array(*[F.lit(float(w[k])) for k in VALUES])
        d, grads, made = stages.backward_with_sums(rows.withColumn("d_loss", upstream), parts.loss(self.n, int(c.mask * self.n)), p, inputs, ["loss"])
        z = t["z"].select(F.col("id").alias("spot_id"), "z")
        ends = shared.written(graph.at_ends(self.pairs, z, "z").select(F.monotonically_increasing_id().alias("id"), "i", "j", "a", "b", F.array("label").alias("label")))
        d_ends, _, pair = stages.backward_with_sums(ends.withColumn("d_loss", F.array(F.lit(float(weights["graph"])))), _pair_part(self.scale, self.n_pairs), {}, ["a", "b", "label"], ["loss"])
        shares = {k: np.exp(p[f"{k}.hops"] - p[f"{k}.hops"].max()) for k in ("one", "two")}
        shares = {k: v / v.sum() for k, v in shares.items()}
        prior = sum(float((HOP_PRIOR * (np.log(HOP_PRIOR) - np.log(v))).sum()) for v in shares.values())
        values = dict(zip(VALUES, made.tolist(), strict=True))
        values["graph"] = values.pop("kl") + float(pair[0])
        values["self"] += HOP_WEIGHT * prior
        if not gradients:
            return values, None, t
        named = d_ends.join(ends.select("id", "i", "j"), "id")
        of_z = d.select("id", F.col("d_z").alias("g")).union(named.select(F.col("i").alias("id"), F.col("d_a").alias("g"))).union(named.select(F.col("j").alias("id"), F.col("d_b").alias("g")))
        found = {"d_z": _summed(of_z, c.latent, "d_z"), "d_g": d.select("id", "d_g"), "d_d": stages.product(self.adj, d.select("id", F.col("d_out").alias("d_d")), "d_d", self.width)}
        d_in, g = stages.backward(_with(t["in"], found), parts.latent, p, ["f", "m1", "m2"], ["z", "d", "g"])
        grads = _added(grads, g)
        d_m2 = _summed(d_in.select("id", F.col("d_m2").alias("g")).union(d.select("id", "d_m2")), 2 * c.graph2, "d_m2")
        d_r, d_s, g = self._level_back(t["h2"], d_m2, "d_m2", parts.heads("two", 24))
        grads = _added(grads, g)
        d_v, g = stages.backward(_with(t["m1"], {"d_s": d_s, "d_r": d_r}), parts.second, p, ["m1"], ["s", "r"])
        grads = _added(grads, g)
        d_m1 = _summed(d_in.select("id", F.col("d_m1").alias("g")).union(d.select("id", "d_m1")).union(d_v.select("id", "d_m1")), 2 * c.graph2, "d_m1")
        d_r, d_s, g = self._level_back(t["h1"], d_m1, "d_m1", parts.heads("one", 14))
        grads = _added(grads, g)
        upstream = {"d_f": d_in.select("id", "d_f"), "d_s": d_s, "d_r": d_r}
        d_u, grads = self._norm_back(t["u2"], t["s2"], upstream, parts.features, ["f", "s", "r"], grads)
        d_u, grads = self._norm_back(t["u1"], t["s1"], {"d_u": d_u}, parts.middle, ["u"], grads)
        _, g = stages.backward(_with(t["rows"], {"d_u": d_u}), parts.enter, p, ["x", "masked"], ["u"])
        grads = _added(grads, g)
        for k, v in shares.items():
            grads[f"{k}.hops"] = grads[f"{k}.hops"] + weights["self"] * HOP_WEIGHT * (v - HOP_PRIOR)
        return values, grads, t

    def _level_back(self, rows, d_m, name, part):
        """Gradients of a level's residual and of what went through its hops, from those of its means and deviations."""
        back = stages.product(self.adj, d_m.withColumnRenamed(name, "d_m"), "d_m", 2 * self.c.graph2)
        d, g = stages.backward(_with(rows, {"d_m": back}), part, self.params, ["stack", "r"], ["m"])
        return d.select("id", "d_r"), stages.hops_back(self.adj, d, "d_stack", self.c.graph1, 2, "d_s"), g

    def _norm_back(self, rows, statistics, upstream, part, outputs, grads):
        """The gradient of the input of a batch norm, and the parameters' sums with those of the part."""
        d, g = stages.backward(_with(rows, upstream), part, self.params | statistics, ["u"], outputs)
        through = {"d_mean": g.pop("mean") / self.n, "d_var": 2 * g.pop("var") / self.n, "mean": statistics["mean"]}
        d_u = stages.forward(rows.join(d, "id"), _of_rows, through, ["u", "d_u"], ["d_u"])
        return d_u, _added(grads, g)

    def _step(self, epoch: int, steps: stages.Adam, weights: dict[str, float]) -> None:
        with shared.passing(self.spots.sparkSession):
            values, grads, t = self.value_and_gradients(epoch, weights)
            self.history.append(values)
        for name, own in (("enc1", t["s1"]), ("enc2", t["s2"])):
            mean, var = self.running[name]
            self.running[name] = ((1 - MOMENTUM) * mean + MOMENTUM * own["mean"], (1 - MOMENTUM) * var + MOMENTUM * own["var"] * self.n / max(self.n - 1, 1))
        self.params = steps.step(self.params, grads)

    def fit(self) -> Model:
        """Both phases."""
        c = self.c
        steps = stages.Adam(self.params, c.rate, c.decay, None)
        for epoch in range(c.first_epochs):
            self._step(epoch, steps, FIRST)
        if c.second_epochs:
            centres, _ = mixture.kmeans(shared.written(self.embed()), c.n_clusters, 42, vector="z")
            self.params["centres"] = centres
        for epoch in range(c.second_epochs):
            if epoch % c.interval == 0:
                self.renew_target(c.first_epochs + epoch)
            self._step(c.first_epochs + epoch, steps, SECOND)
        return self

    def renew_target(self, epoch: int) -> None:
        """Sharpened shares of the centres, from the embedding without noise."""
        z = self._forward(epoch, False, not self.c.deterministic_eval)["z"]
        parts = Parts(self.c, epoch, False)
        q = stages.forward(z, lambda p, x, ids: {"q": parts.soft(p, x["z"])}, self.params, ["z"], ["q"])
        sums = q.select(F.posexplode("q").alias("k", "q")).groupBy("k").agg(F.sum("q").alias("f")).orderBy("k").collect()  # a row for each centre
        f = F.array(*[F.lit(float(r["f"])) for r in sums])
        raw = F.zip_with("q", f, lambda a, b: a * a / b)
        summed = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        self.target = shared.written(q.select("id", raw.alias("p")).select("id", F.transform("p", lambda x: x / summed).alias("target")), keep=True)

    def embed(self) -> DataFrame:
        """(spot_id, z)."""
        t = self._forward(len(self.history), False, not self.c.deterministic_eval)
        return t["z"].select(F.col("id").alias("spot_id"), "z")


def _added(a: stages.Params, b: stages.Params) -> stages.Params:
    return {k: v + b.get(k, 0.0) for k, v in a.items()}


def _summed(rows: DataFrame, width: int, out: str) -> DataFrame:
    sums = rows.groupBy("id").agg(*[F.sum(F.col("g")[k]).alias(f"_{k}") for k in range(width)])
    return sums.select("id", F.array(*[F.col(f"_{k}") for k in range(width)]).alias(out))


def _with(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    for k, table in tables.items():
        rows = rows.join(table.select("id", k), "id")
    return rows
