"""The two-level variational graph model, trained on distributed rows.

``encode``: an encoder of each spot's features (f0), then two levels; each projects its input, takes it through several
products with the adjacency, mixes these hops by each spot's own attention, and gives a mean and a log variance. Levels are fused by attention
(or put side by side), and a linear decoder, with columns for the batch, is taken through the adjacency once. The row-wise parts
and the products are steps of ``stages``. A second view of the graph with permuted features runs through the same steps
as rows of its own: spot i has the ids 2 i (its own features) and 2 i + 1 (those of another spot).

Losses: reconstruction of masked spots, agreement of the levels, local against global (both views), edges against
negative edges; weighted by learned variances, by their first values or by fixed numbers; and the KL from the unit normal,
which warms up over the first quarter of the epochs. Masks, noise, dropout and draws are hashes of spot, epoch and seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import blocks, graph, losses, sampling, stages, tape
from spotweave.sources import shared

LOSSES = ("rec", "xlevel", "lg", "edge")
XLEVEL, BALANCE = ("none", "cos", "spot", "nbr"), ("kendall", "init")


@dataclass(frozen=True)
class Config:
    """Options of a run, with the model's own values; unknown modes raise an error."""

    hid: int = 256
    f0: int = 64
    z: int = 32
    out: int = 32
    hops: tuple[int, int] = (3, 6)
    dropout: float = 0.1
    mask: float = 0.3
    k: int = 6
    mnn_k: int = 3
    narrow: int = 30
    epochs: int = 600
    rate: float = 1e-3
    decay: float = 1e-4
    beta: float = 1e-3
    tau: float = 0.5
    n_contrast: int = 2048
    refine_at: tuple[float, ...] = (0.5,)
    refine_mix: float = 0.5
    xlevel: str = "cos"
    balance: str = "kendall"
    seed: int = 0
    expr_graph: bool = True
    refine_graph: bool = False
    adaptive_hops: bool = True
    local_global: bool = True
    fusion: bool = True
    auto_balance: bool = True
    batch_decoder: bool = True

    def __post_init__(self):
        if self.xlevel not in XLEVEL or self.balance not in BALANCE:
            raise ValueError(f"xlevel is one of {XLEVEL} and balance one of {BALANCE}, not {self.xlevel!r} and {self.balance!r}")


def start(width: int, batches: int, c: Config) -> stages.Params:
    """Parameters of a model for features of ``width`` and columns for ``batches`` (0: none)."""
    rng = np.random.default_rng(c.seed)
    p: stages.Params = {}

    def linear(name: str, a: int, b: int, bias: bool = True) -> None:
        p[f"{name}.w"] = rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
        if bias:
            p[f"{name}.b"] = rng.uniform(-1, 1, (1, b)) / np.sqrt(a)

    def norm(name: str, n: int) -> None:
        p[f"{name}.scale"], p[f"{name}.shift"] = np.ones((1, n)), np.zeros((1, n))

    linear("enc1", width, c.hid)
    norm("enc1", c.hid)
    linear("enc2", c.hid, c.f0)
    for level, size in (("one", c.f0), ("two", c.z)):
        linear(f"{level}.in", size, 2 * c.z)
        if c.adaptive_hops:
            linear(f"{level}.q", 2 * c.z, 1, bias=False)
        norm(level, 2 * c.z)
        linear(f"{level}.mean", 2 * c.z, c.z)
        linear(f"{level}.logvar", 2 * c.z, c.z)
    if c.fusion:
        for n, size in enumerate((c.f0, c.z, c.z)):
            linear(f"fuse{n}", size, c.out)
        linear("score", c.out, c.out)
        linear("score.v", c.out, 1, bias=False)
    for side in ("head1", "head2") if c.xlevel in ("spot", "nbr") else ():
        linear(f"{side}.a", c.z, c.z)
        linear(f"{side}.b", c.z, c.z)
    if c.local_global:
        p["disc.w"], p["disc.b"] = rng.uniform(-1, 1, (size_of(c), size_of(c))) / np.sqrt(size_of(c)), np.zeros((1, 1))
    linear("dec", size_of(c) + batches, width)
    p["token"] = np.zeros((1, width))
    p["logvars"] = np.zeros((1, len(LOSSES)))
    return p


def size_of(c: Config) -> int:
    """Components of the embedding."""
    return c.out if c.fusion else c.f0 + 2 * c.z


def _linear(p: dict, name: str, x: tape.Var) -> tape.Var:
    return x @ p[f"{name}.w"] + p[f"{name}.b"]


def _norm(p: dict, name: str, x: tape.Var) -> tape.Var:
    return tape.layer_norm(x, p[f"{name}.scale"], p[f"{name}.shift"])


class Parts:
    """The row-wise parts for one epoch; ``epoch`` None: without mask, noise and dropout."""

    def __init__(self, c: Config, epoch: int | None):
        self.c, self.epoch = c, epoch

    def drop(self, x: tape.Var, ids: np.ndarray, label: int) -> tape.Var:
        if self.epoch is None or not self.c.dropout:
            return x
        kept = stages.uniforms(ids, x.value.shape[1], self.c.seed, self.epoch, label) >= self.c.dropout
        return x * (kept / (1 - self.c.dropout))

    def masked(self, spots: np.ndarray) -> np.ndarray:
        return stages.uniforms(spots, 1, self.c.seed, self.epoch, 1)[:, 0] < self.c.mask

    def draw(self, mean: tape.Var, logvar: tape.Var, ids: np.ndarray, label: int) -> tape.Var:
        if self.epoch is None:
            return mean
        return mean + stages.normals(ids, self.c.z, self.c.seed, self.epoch, label) * tape.exp(logvar * 0.5)

    def encoder(self, p, x, ids):
        """x, src (the spot that x is of) -> f0, h."""
        inp = x["x"]
        if self.epoch is not None:
            inp = tape.where(self.masked(x["src"].value[:, 0].astype(np.int64)), p["token"] + np.zeros_like(inp.value), inp)
        f0 = _linear(p, "enc2", self.drop(tape.elu(_norm(p, "enc1", _linear(p, "enc1", inp))), ids, 2))
        return {"f0": f0, "h": _linear(p, "one.in", self.drop(f0, ids, 3))}

    def _level(self, p, name, stack, n_hops, ids, label):
        width = 2 * self.c.z
        each = [stack[:, k * width : (k + 1) * width] for k in range(n_hops + 1)]
        if self.c.adaptive_hops:
            weights = tape.softmax(tape.concat([tape.tanh(h) @ p[f"{name}.q.w"] for h in each]))
        else:
            weights = tape.var(np.full((len(ids), n_hops + 1), 1 / (n_hops + 1)))
        mixed = each[0] * weights[:, 0:1]
        for k in range(1, n_hops + 1):
            mixed = mixed + each[k] * weights[:, k : k + 1]
        h = tape.elu(_norm(p, name, mixed))
        mean, logvar = _linear(p, f"{name}.mean", h), tape.clamp(_linear(p, f"{name}.logvar", h), -8, 8)
        return mean, logvar, self.draw(mean, logvar, ids, label), weights

    def first(self, p, x, ids):
        """stack -> mean1, logvar1, z1, h, hops1."""
        mean, logvar, z, weights = self._level(p, "one", x["stack"], self.c.hops[0], ids, 4)
        return {"mean1": mean, "logvar1": logvar, "z1": z, "h": _linear(p, "two.in", self.drop(z, ids, 5)), "hops1": weights}

    def second(self, p, x, ids):
        """stack, f0, z1 (and hot) -> mean2, logvar2, z2, z, dz (z beside the decoder's output), hops2, levels."""
        mean, logvar, z2, weights = self._level(p, "two", x["stack"], self.c.hops[1], ids, 6)
        parts = [x["f0"], x["z1"], z2]
        if self.c.fusion:
            sides = [_linear(p, f"fuse{n}", part) for n, part in enumerate(parts)]
            share = tape.softmax(tape.concat([tape.tanh(_linear(p, "score", s)) @ p["score.v.w"] for s in sides]))
            z = sides[0] * share[:, 0:1] + sides[1] * share[:, 1:2] + sides[2] * share[:, 2:3]
        else:
            z, share = tape.concat(parts), tape.var(np.zeros((len(ids), 3)))
        decoded = _linear(p, "dec", tape.concat([z, x["hot"]]) if "hot" in x else z)
        return {"mean2": mean, "logvar2": logvar, "z2": z2, "z": z, "zd": tape.concat([z, decoded]), "hops2": weights, "levels": share}

    def loss(self, n_rows: int, n_masked: int):
        """x, zd and the product of zd of both views, levels' means and variances -> loss: the row's share of rec, xlevel, lg, kl."""
        c = self.c
        size = size_of(c)

        def bce(logit, label):
            return tape.softplus(logit) - logit * label

        def part(p, x, ids):
            z, z_other = x["z"], x["z_other"]
            summary, out = x["sum"][:, :size], x["sum"][:, size:]
            masked = self.masked(ids)[:, None].astype(float)
            error = tape.var(1.0) - tape.total(tape.unit(out) * tape.unit(x["x"]), 1)
            diff = out - x["x"]
            rec = error * error * (masked / n_masked) + tape.total(diff * diff, 1) * (0.1 / (n_rows * out.value.shape[1]))
            zero = tape.var(np.zeros((len(ids), 1)))
            level = -tape.total(tape.unit(x["z1"]) * tape.unit(x["z2"]), 1) * (1 / n_rows) if c.xlevel == "cos" else zero
            lg = zero
            if c.local_global:
                s, t = tape.sigmoid(summary), tape.sigmoid(x["sum_other"][:, :size])
                form = lambda a, b: tape.total((a @ p["disc.w"]) * b, 1) + p["disc.b"]
                lg = (bce(form(z, s), 1.0) + bce(form(z_other, t), 1.0) + bce(form(z_other, s), 0.0) + bce(form(z, t), 0.0)) * (0.5 / n_rows)
            kl = zero
            for a, b in (("mean1", "logvar1"), ("mean2", "logvar2")):
                kl = kl + tape.total(x[b] + 1.0 - x[a] * x[a] - tape.exp(x[b]), 1) * (-0.5 / n_rows)
            return {"loss": tape.concat([rec, level, lg, kl])}

        return part


def _edge_part(tau: float, n_edges: int):
    """a, b, label -> loss: the row's share of the edge loss."""

    def part(p, x, ids):
        logit = tape.total(tape.unit(x["a"]) * tape.unit(x["b"]), 1) * (1 / tau)
        return {"loss": (tape.softplus(logit) - logit * x["label"].value) * (1 / n_edges)}

    return part


class _Local:
    """What a task needs to run the model on a block."""

    def __init__(self, c: Config, batches: int):
        self.c, self.batches = c, batches

    def _in_block(self, p: dict, row: dict, parts: Parts):
        """All of the model on a block's nodes: ids, the own ones' places, features, and the steps' outputs."""
        c = self.c
        ids, own, product = blocks.read(row)
        x = np.array([r["x"] for r in row["rows"]], float)
        src, views = ids, 1
        both = 2 * ids
        if c.local_global:
            x, views = np.concatenate([x, np.array([r["px"] for r in row["rows"]], float)]), 2
            src, both = np.concatenate([ids, [r["src"] for r in row["rows"]]]), np.concatenate([2 * ids, 2 * ids + 1])
        more = {"hot": tape.Var(np.tile(np.eye(self.batches)[[r["batch"] for r in row["rows"]]], (views, 1)))} if self.batches else {}

        def stack(h: tape.Var, n: int) -> tape.Var:
            each = [h]
            for _ in range(n):
                each.append(product(each[-1]))
            return tape.concat(each)

        enc = parts.encoder(p, {"x": tape.Var(x), "src": tape.Var(src[:, None])}, both)
        one = parts.first(p, {"stack": stack(enc["h"], c.hops[0])}, both)
        two = parts.second(p, {"stack": stack(one["h"], c.hops[1]), "f0": enc["f0"], "z1": one["z1"], **more}, both)
        return ids, own, x, product, one, two


class Model:
    """A model of ``spots`` (``spot_id`` long, ``feat``, ``x``, ``y``, and ``batch`` 0, 1, ... where there are several)."""

    def __init__(self, spots: DataFrame, c: Config, block_nodes: int = blocks.BLOCK_NODES):
        self.c, self.n = c, spots.count()
        columns = ["spot_id", F.col("feat").cast("array<double>").alias("feat"), "x", "y", *(["batch"] if "batch" in spots.columns else [])]
        self.spots = shared.written(spots.select(*columns))
        batches = int(self.spots.agg(F.max("batch")).first()[0]) + 1 if "batch" in spots.columns else 1
        self.batches = batches if batches > 1 and c.batch_decoder else 0
        self.width = len(self.spots.select("feat").first()[0])
        narrow = self.spots.select("spot_id", F.slice("feat", 1, c.narrow).alias("feat"))
        edges = graph.place_knn(self.spots, c.k)
        if batches > 1:
            mutual = graph.mnn_edges(narrow.join(self.spots.select("spot_id", "batch"), "spot_id"), c.mnn_k)
            edges = graph.binarise(graph.union_graph(edges, mutual))
        self.edges = shared.written(edges)
        self.numbers = shared.written(sampling.numbered(self.spots.select("spot_id"), 0).select(F.col("spot_id").alias("j"), "at"))
        self.made: tuple | None = None
        self.held = blocks.dealt(self.spots, self.edges, sum(c.hops) + 1, block_nodes)
        self.set_weights(graph.expression_weights(self.edges, narrow) if c.expr_graph else self.edges)
        self.params = start(self.width, self.batches, c)
        self.history: list[dict[str, float]] = []
        self.first_losses: dict[str, float] | None = None

    def set_weights(self, weights: DataFrame) -> None:
        self.weights, self.dealt = shared.written(weights.select("i", "j", "w")), None
        one = graph.normalize_adj(self.weights, self.spots)
        self.adj = shared.written(one.select((F.col("i") * 2).alias("i"), (F.col("j") * 2).alias("j"), "v"))

    def _both(self, view: bool) -> DataFrame:
        """The adjacency of the ids in use: with ``view``, of the permuted rows too."""
        if not view:
            return self.adj
        return self.adj.union(self.adj.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v"))

    def _rows(self, epoch: int | None) -> DataFrame:
        """(id, x, src, hot): the spots' features, and in training those of the permuted view."""
        own = self.spots.select((F.col("spot_id") * 2).alias("id"), F.col("feat").alias("x"), F.array(F.col("spot_id").cast("double")).alias("src"), *([F.col("batch")] if self.batches else []))
        rows = own
        if epoch is not None and self.c.local_global:
            packed = own.withColumn("pair", F.struct("x", "src"))
            other = sampling.permuted(packed, self.c.seed * 100_003 + epoch, "id", "pair")
            rows = own.unionByName(other.withColumns({"id": F.col("id") + 1, "x": F.col("pair.x"), "src": F.col("pair.src")}).drop("pair"))
        if self.batches:
            hot = F.transform(F.sequence(F.lit(0), F.lit(self.batches - 1)), lambda k: (k == F.col("batch")).cast("double"))
            rows = rows.withColumn("hot", hot).drop("batch")
        return shared.written(rows)

    def _forward(self, epoch: int | None) -> dict[str, DataFrame]:
        """The tables of all steps up to the embedding."""
        c, parts = self.c, Parts(self.c, epoch)
        adj = self._both(epoch is not None and c.local_global)
        hot = ["hot"] if self.batches else []
        t = {"rows": self._rows(epoch)}
        t["enc"] = stages.forward(t["rows"], parts.encoder, self.params, ["x", "src"], ["f0", "h"])
        t["in1"] = shared.written(stages.hops(adj, t["enc"], "h", 2 * c.z, c.hops[0]))
        t["one"] = stages.forward(t["in1"], parts.first, self.params, ["stack"], ["mean1", "logvar1", "z1", "h", "hops1"])
        stack = stages.hops(adj, t["one"], "h", 2 * c.z, c.hops[1])
        t["in2"] = shared.written(stack.join(t["enc"].select("id", "f0"), "id").join(t["one"].select("id", "z1"), "id").join(t["rows"].select("id", *hot), "id"))
        t["two"] = stages.forward(t["in2"], parts.second, self.params, ["stack", "f0", "z1", *hot], ["mean2", "logvar2", "z2", "z", "zd", "hops2", "levels"])
        return t

    def n_masked(self, epoch: int) -> int:
        """The spots that the epoch masks (1 at least)."""
        parts = Parts(self.c, epoch)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(parts.masked(batch.column(0).to_numpy()).sum())], pa.int64())], names=["n"])

        return max(1, self.spots.select("spot_id").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)

    def _losses(self, t: dict[str, DataFrame], epoch: int, weights: dict[str, float] | None):
        """The values of the losses, and with ``weights`` also the gradients: of the parameters, and tables by step."""
        c, parts, size = self.c, Parts(self.c, epoch), size_of(self.c)
        n_masked = self.n_masked(epoch)
        adj = self._both(c.local_global)
        sums = stages.product(adj, t["two"], "zd", size + self.width).withColumnRenamed("zd", "sum")
        own = t["two"].join(sums, "id").where("id % 2 = 0")
        if c.local_global:
            other = t["two"].join(sums, "id").where("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("z").alias("z_other"), F.col("sum").alias("sum_other"))
            own = own.join(other, "id")
        else:
            own = own.withColumns({"z_other": F.col("z"), "sum_other": F.col("sum")})
        rows = own.join(t["one"].select("id", "mean1", "logvar1", "z1"), "id").join(t["rows"].select("id", "x"), "id")
        inputs = ["x", "z", "z_other", "sum", "sum_other", "z1", "z2", "mean1", "logvar1", "mean2", "logvar2"]
        rows = rows.select(F.expr("id div 2").alias("id"), *inputs)
        n_edges = self.edges.count()
        negative = sampling.negative_edges(self.edges, self.spots, epoch)
        pairs = self.edges.select("i", "j", F.lit(1.0).alias("label")).union(negative)
        z = t["two"].where("id % 2 = 0").select(F.expr("id div 2").alias("spot_id"), "z")
        ends = shared.written(graph.at_ends(pairs, z, "z").select(F.monotonically_increasing_id().alias("id"), "i", "j", "a", "b", F.array("label").alias("label")))
        edge = _edge_part(c.tau, n_edges)
        if weights is None:
            flat = stages.forward(rows, parts.loss(self.n, n_masked), self.params, inputs, ["loss"]).agg(*[F.sum(F.col("loss")[k]).alias(f"l{k}") for k in range(4)]).first()
            e = stages.forward(ends, edge, {}, ["a", "b", "label"], ["loss"]).agg(F.sum(F.col("loss")[0])).first()[0]
            values = dict(zip((*LOSSES[:3], "kl"), flat, strict=True)) | {"edge": e}
        else:
            upstream = F.array(*[F.lit(float(weights[k])) for k in (*LOSSES[:3], "kl")])
            d_rows, grads, made = stages.backward_with_sums(rows.withColumn("d_loss", upstream), parts.loss(self.n, n_masked), self.params, inputs, ["loss"])
            d_ends, _, e = stages.backward_with_sums(ends.withColumn("d_loss", F.array(F.lit(float(weights["edge"])))), edge, {}, ["a", "b", "label"], ["loss"])
            values = dict(zip((*LOSSES[:3], "kl"), made.tolist(), strict=True)) | {"edge": float(e[0])}
        if c.xlevel in ("spot", "nbr"):
            values["xlevel"], contrast = self._contrast(t, adj, epoch, 0.0 if weights is None else weights["xlevel"])
        if weights is None:
            return values, None, None
        named = d_ends.join(ends.select("id", "i", "j"), "id")
        of_ends = named.select((F.col("i") * 2).alias("id"), F.col("d_a").alias("g")).union(named.select((F.col("j") * 2).alias("id"), F.col("d_b").alias("g")))
        twice = lambda c_, shift=0: d_rows.select((F.col("id") * 2 + shift).alias("id"), F.col(c_).alias("g"))
        d_z = of_ends.union(twice("d_z"))
        d_sum = twice("d_sum")
        if c.local_global:
            d_z, d_sum = d_z.union(twice("d_z_other", 1)), d_sum.union(twice("d_sum_other", 1))
        tables = {"d_z": _summed(d_z, size, "d_z"), "d_zd": stages.product(adj, d_sum.withColumnRenamed("g", "d_zd"), "d_zd", size + self.width)}
        for k, width in (("z1", c.z), ("z2", c.z), ("mean1", c.z), ("logvar1", c.z), ("mean2", c.z), ("logvar2", c.z)):
            rows_of = twice(f"d_{k}")
            if c.xlevel in ("spot", "nbr") and k in ("z1", "z2"):
                rows_of = rows_of.union(contrast[k])
            tables[f"d_{k}"] = _summed(rows_of, width, f"d_{k}")
        if c.xlevel in ("spot", "nbr"):
            grads = {k: g + contrast["params"].get(k, 0.0) for k, g in grads.items()}
        return values, grads, tables

    def _contrast(self, t, adj, epoch, weight):
        """The contrast of the levels over a sample of ``n_contrast`` spots, which comes to the driver; its gradients."""
        spark = self.spots.sparkSession
        second = t["two"].where("id % 2 = 0").select("id", "z2")
        if self.c.xlevel == "nbr":
            second = stages.product(self.adj, second, "z2", self.c.z)
        known = t["one"].where("id % 2 = 0").select("id", "z1").join(second, "id")
        picked = sampling.contrast_sample(known, self.c.n_contrast, epoch, "id").toPandas()  # n_contrast rows
        a, b = (tape.Var(np.array(picked[k].tolist())) for k in ("z1", "z2"))
        p = {k: tape.Var(v) for k, v in self.params.items() if k.startswith("head")}
        left, right = (tape.unit(_linear(p, f"{h}.b", tape.elu(_linear(p, f"{h}.a", v)))) for h, v in (("head1", a), ("head2", b)))
        logits = left @ tape.Var(right.value.T, ((right, lambda g: g.T),)) * (1 / self.c.tau)
        n = len(picked)
        own = np.eye(n)
        by_row = tape.log(tape.total(tape.exp(logits - logits.value.max()), 1)) + logits.value.max()
        by_col = tape.log(tape.total(tape.exp(logits - logits.value.max()), 0)) + logits.value.max()
        value = (tape.total(by_row) + tape.total(by_col) - tape.total(logits * own) * 2.0) * (0.5 / n)
        tape.backward([(value, np.array(weight))])
        schema = "id long, g array<double>"
        grads = {k: spark.createDataFrame(list(zip(picked["id"].tolist(), v.grad.tolist(), strict=True)), schema) for k, v in (("z1", a), ("z2", b))}
        if self.c.xlevel == "nbr":
            grads["z2"] = stages.product(self.adj, grads["z2"], "g", self.c.z)
        return float(value.value), grads | {"params": {k: v.grad for k, v in p.items()}}

    def _backward(self, t: dict[str, DataFrame], epoch: int, tables: dict[str, DataFrame]) -> stages.Params:
        c, parts = self.c, Parts(self.c, epoch)
        adj = self._both(c.local_global)
        hot = ["hot"] if self.batches else []
        zeros = {"mean2": c.z, "logvar2": c.z, "z2": c.z, "z": size_of(c), "zd": size_of(c) + self.width}
        d_two, g2 = stages.backward(_with(t["in2"], tables, zeros), parts.second, self.params, ["stack", "f0", "z1", *hot], list(zeros))
        d_h = stages.hops_back(adj, d_two, "d_stack", 2 * c.z, c.hops[1], "d_h")
        more = d_two.select("id", F.col("d_z1").alias("g")).union(tables["d_z1"].select("id", F.col("d_z1").alias("g")))
        found = {"d_h": d_h, "d_z1": _summed(more, c.z, "d_z1"), "d_mean1": tables["d_mean1"], "d_logvar1": tables["d_logvar1"]}
        d_one, g1 = stages.backward(_with(t["in1"], found, {"mean1": c.z, "logvar1": c.z, "z1": c.z, "h": 2 * c.z}), parts.first, self.params, ["stack"], ["mean1", "logvar1", "z1", "h"])
        d_h = stages.hops_back(adj, d_one, "d_stack", 2 * c.z, c.hops[0], "d_h")
        _, g0 = stages.backward(_with(t["rows"], {"d_h": d_h, "d_f0": d_two.select("id", "d_f0")}, {"f0": c.f0, "h": 2 * c.z}), parts.encoder, self.params, ["x", "src"], ["f0", "h"])
        return {k: g0[k] + g1[k] + g2[k] for k in self.params}

    def loss_weights(self, epoch: int) -> dict[str, float]:
        """The weight of each loss in the total of an epoch."""
        c = self.c
        if c.auto_balance and c.balance == "init":
            weights = {k: 1 / max(self.first_losses[k], 1e-3) for k in LOSSES}
        elif c.auto_balance:
            weights = dict(zip(LOSSES, np.exp(-self.params["logvars"][0]).tolist(), strict=True))
        else:
            weights = dict(losses.MANUAL)
        if c.xlevel == "none":
            weights["xlevel"] = 0.0
        return weights | {"kl": c.beta * min(1.0, epoch / max(1, c.epochs // 4))}

    # --- epochs over blocks with halos

    def _by_blocks(self) -> blocks.Dealt | None:
        """The graph in blocks with halos, or None where products are joins."""
        if self.c.xlevel not in ("none", "cos") or self.held is None:
            return None
        if self.dealt is None:
            adj = self.adj.select(F.expr("i div 2").alias("i"), F.expr("j div 2").alias("j"), "v")
            self.dealt = blocks.with_entries(self.held, adj)
        return self.dealt

    def _block_rows(self, dealt: blocks.Dealt, epoch: int) -> DataFrame:
        """The blocks with their nodes' features (``rows``: x, batch; with two views also px and src)."""
        own = self.spots.select("spot_id", F.col("feat").alias("x"), *([F.col("batch").cast("long").alias("batch")] if self.batches else []))
        columns = ["x", *(["batch"] if self.batches else [])]
        if self.c.local_global:
            packed = own.select((F.col("spot_id") * 2).alias("id"), F.struct("x", F.col("spot_id").alias("src")).alias("pair"))
            other = sampling.permuted(packed, self.c.seed * 100_003 + epoch, "id", "pair")
            own = own.join(other.select(F.expr("id div 2").alias("spot_id"), F.col("pair.x").alias("px"), F.col("pair.src").alias("src")), "spot_id")
            columns += ["px", "src"]
        return shared.written(dealt.parts.join(dealt.grouped(own, columns, "rows"), "block"))

    def _edges_of(self, z: DataFrame, epoch: int, weight: float) -> tuple[float, DataFrame]:
        """The edge loss from the spots' ``z``, and (spot_id, g): its gradient at each spot, times ``weight``."""
        n_edges = self.edges.count()
        part, size = _edge_part(self.c.tau, n_edges), size_of(self.c)
        negative = sampling.drawn(self.edges, self.numbers, self.n, epoch)
        pairs = self.edges.select("i", "j", F.lit(1.0).alias("label")).union(negative)
        ends = graph.at_ends(pairs, z, "z").select("i", "j", "a", "b", "label")

        def run(batches):
            total = 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = {k: tape.Var(stages._matrix(batch.column(n))) for n, k in ((2, "a"), (3, "b"))} | {"label": tape.Var(batch.column(4).to_numpy()[:, None])}
                made = part({}, x, batch.column(0).to_numpy())["loss"]
                total += float(made.value.sum())
                tape.backward([(made, np.full(made.value.shape, weight))])
                for n, k in ((0, "a"), (1, "b")):
                    yield pa.RecordBatch.from_arrays([batch.column(n), stages._lists(x[k].grad)], names=["spot_id", "g"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), stages._lists(np.array([[total]]))], names=["spot_id", "g"])

        both = shared.written(ends.mapInArrow(run, "spot_id long, g array<double>"))
        value = both.where("spot_id is null").agg(F.sum(F.col("g")[0])).first()[0]
        return float(value), _summed(both.where("spot_id is not null").withColumnRenamed("spot_id", "id"), size, "g").withColumnRenamed("id", "spot_id")

    def _epoch_in_blocks(self, dealt: blocks.Dealt, epoch: int, weights: dict[str, float]) -> tuple[dict[str, float], stages.Params]:
        """The losses and the gradients of an epoch: a pass over the blocks forward, the edges' loss, and a pass back."""
        c, parts, n, size = self.c, Parts(self.c, epoch), self.n, size_of(self.c)
        held, local = self.spots.sparkSession.sparkContext.broadcast(self.params), _Local(c, self.batches)
        rows, names = self._block_rows(dealt, epoch), sorted(self.params)

        def ahead(batches):
            p = {k: tape.Var(v) for k, v in held.value.items()}
            for batch in batches:
                for row in batch.to_pylist():
                    ids, own, _, _, _, two = local._in_block(p, row, parts)
                    masked = parts.masked(ids[own]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), stages._lists(two["z"].value[own]), pa.array(masked)], names=["spot_id", "z", "masked"])

        def back(batches):
            step = None
            for batch in batches:
                for row in batch.to_pylist():
                    p = {k: tape.Var(v) for k, v in held.value.items()}
                    ids, own, x, product, one, two = local._in_block(p, row, parts)
                    other = own + len(ids) if c.local_global else own
                    sums = product(two["zd"])
                    inputs = {k: two[k][own] for k in ("z", "z2", "mean2", "logvar2")} | {k: one[k][own] for k in ("z1", "mean1", "logvar1")}
                    inputs |= {"x": tape.Var(x[own]), "sum": sums[own], "z_other": two["z"][other], "sum_other": sums[other]}
                    loss = parts.loss(n, n_masked)(p, inputs, ids[own])["loss"]
                    upstream = np.tile([weights[k] for k in (*LOSSES[:3], "kl")], (len(own), 1))
                    tape.backward([(loss, upstream), (two["z"][own], np.array([r["g"] for r in row["edges"]], float))])
                    flat = np.concatenate([*((np.zeros(p[k].value.size) if p[k].grad is None else p[k].grad.ravel()) for k in names), loss.value.sum(axis=0)])
                    step = flat if step is None else step + flat
            if step is not None:
                yield pa.RecordBatch.from_arrays([stages._lists(step[None])], names=["sums"])

        made = shared.written(rows.mapInArrow(ahead, "spot_id long, z array<double>, masked long"))
        n_masked = max(1, made.agg(F.sum("masked")).first()[0])
        edge, d_z = self._edges_of(made.select("spot_id", "z"), epoch, weights["edge"])
        zeros = F.array_repeat(F.lit(0.0), size)
        known = made.select("spot_id").join(d_z, "spot_id", "left").select("spot_id", F.coalesce("g", zeros).alias("g"))
        both = rows.join(dealt.grouped(known, ["g"], "edges", own_only=True), "block")
        summed = both.mapInArrow(back, "sums array<double>").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).toPandas()  # a row for each parameter
        flat = np.zeros(len(summed))
        flat[summed["at"]] = summed["s"]
        cut = sum(v.size for v in self.params.values())
        return dict(zip((*LOSSES[:3], "kl"), flat[cut:].tolist(), strict=True)) | {"edge": edge}, stages.unflatten(flat[:cut], self.params)

    def value_and_gradients(self, epoch: int) -> tuple[dict[str, float], stages.Params]:
        """The losses of an epoch's draws, and the gradients of the total: over blocks with halos where they are small, else by joins."""
        dealt = self._by_blocks()
        if dealt is None:
            return self.value_and_gradients_by_joins(epoch)
        if self.c.auto_balance and self.c.balance == "init" and self.first_losses is None:
            self.first_losses = self._losses(self._forward(epoch), epoch, None)[0]
        weights = self.loss_weights(epoch)
        values, grads = self._epoch_in_blocks(dealt, epoch, weights)
        return values, self._with_logvars(values, grads, weights)

    def _with_logvars(self, values: dict[str, float], grads: stages.Params, weights: dict[str, float]) -> stages.Params:
        if self.c.auto_balance and self.c.balance == "kendall":
            used = [1.0, float(self.c.xlevel != "none"), float(self.c.local_global), 1.0]
            grads["logvars"] = np.array([[u * (1 - weights[k] * values[k]) for k, u in zip(LOSSES, used, strict=True)]])
        return grads

    def value_and_gradients_by_joins(self, epoch: int) -> tuple[dict[str, float], stages.Params]:
        """The same with a join for each product."""
        t = self._forward(epoch)
        if self.c.auto_balance and self.c.balance == "init" and self.first_losses is None:
            self.first_losses = self._losses(t, epoch, None)[0]
        weights = self.loss_weights(epoch)
        values, grads, tables = self._losses(t, epoch, weights)
        more = self._backward(t, epoch, tables)
        return values, self._with_logvars(values, {k: grads[k] + more[k] for k in self.params}, weights)

    def total(self, values: dict[str, float], epoch: int) -> float:
        weights = self.loss_weights(epoch)
        out = sum(weights[k] * values[k] for k in (*LOSSES, "kl"))
        if self.c.auto_balance and self.c.balance == "kendall":
            used = [1.0, float(self.c.xlevel != "none"), float(self.c.local_global), 1.0]
            out += float(np.dot(used, self.params["logvars"][0]))
        return out

    def fit(self, progress=None) -> Model:
        """All epochs; ``progress(epoch, losses)`` is called after each."""
        c = self.c
        steps = stages.Adam(self.params, c.rate, c.decay)
        refine = {int(r * c.epochs) for r in c.refine_at} if c.refine_graph else set()
        for epoch in range(c.epochs):
            if epoch in refine and c.expr_graph:
                self.set_weights(graph.refine_graph(self.weights, graph.expression_weights(self.edges, self.embed(), vector="z"), c.refine_mix))
            self._by_blocks()  # the blocks outlive the epoch's own tables
            with shared.passing(self.spots.sparkSession):
                values, grads = self.value_and_gradients(epoch)
            self.params = steps.step(self.params, grads)
            self.history.append(values)
            if progress:
                progress(epoch, values)
        return self

    def _outputs(self) -> dict[str, DataFrame]:
        """The tables of a pass without mask and noise, made once for the parameters as they are."""
        if self.made is None or self.made[0] is not self.params or self.made[1] is not self.adj:
            self.made = (self.params, self.adj, self._forward(None))
        return self.made[2]

    def embed(self) -> DataFrame:
        """(spot_id, z): the embedding from the means, without mask and noise."""
        return self._outputs()["two"].select(F.expr("id div 2").alias("spot_id"), "z")

    def attention(self) -> DataFrame:
        """(spot_id, hop_level1, hop_level2, levels): the shares of the hops, and of the levels where they are fused."""
        t = self._outputs()
        both = t["one"].select("id", F.col("hops1").alias("hop_level1")).join(t["two"].select("id", F.col("hops2").alias("hop_level2"), "levels"), "id")
        return both.select(F.expr("id div 2").alias("spot_id"), "hop_level1", "hop_level2", *(["levels"] if self.c.fusion else []))


def _summed(rows: DataFrame, width: int, out: str) -> DataFrame:
    """(id, out): the sum of ``g`` for each id."""
    sums = rows.groupBy("id").agg(*[F.sum(F.col("g")[k]).alias(f"_{k}") for k in range(width)])
    return sums.select("id", F.array(*[F.col(f"_{k}") for k in range(width)]).alias(out))


def _with(rows: DataFrame, tables: dict[str, DataFrame], widths: dict[str, int]) -> DataFrame:
    """``rows`` with the columns ``d_`` of ``tables`` for all in ``widths``; zeros where there are none."""
    for k, width in widths.items():
        zero = F.array_repeat(F.lit(0.0), width)
        if f"d_{k}" in tables:
            rows = rows.join(tables[f"d_{k}"].select("id", f"d_{k}"), "id", "left").withColumn(f"d_{k}", F.coalesce(f"d_{k}", zero))
        else:
            rows = rows.withColumn(f"d_{k}", zero)
    return rows
