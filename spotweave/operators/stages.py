"""Steps of a graph model over distributed rows.

A model alternates row-wise parts (small matrices, broadcast) and products with the adjacency (joins). ``forward`` runs a
row-wise part in one Arrow pass; ``backward`` runs it again and takes the gradients of its outputs back to its inputs and
to the parameters, whose sums over tasks are an aggregation. The adjacency is symmetric, so the gradient of a product is a product.
Rows are (id, columns of ``array<double>``). No task and no driver sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import graph, tape
from spotweave.sources import shared

Params = dict[str, np.ndarray]
#: A part: (parameters, inputs by name, ids) to outputs by name.
Part = Callable[[dict[str, tape.Var], dict[str, tape.Var], np.ndarray], dict[str, tape.Var]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def forward(rows: DataFrame, part: Part, params: Params, inputs: list[str], outputs: list[str]) -> DataFrame:
    """(id, outputs) of a part, as a written table."""
    held = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        p = {k: tape.Var(v) for k, v in held.value.items()}
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                made = part(p, {k: tape.Var(_matrix(batch.column(n))) for n, k in enumerate(inputs, 1)}, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists(made[k].value) for k in outputs)], names=["id", *outputs])

    schema = ", ".join(["id long", *(f"{k} array<double>" for k in outputs)])
    return shared.written(rows.select("id", *inputs).mapInArrow(run, schema))


def backward(rows: DataFrame, part: Part, params: Params, inputs: list[str], outputs: list[str]) -> tuple[DataFrame, Params]:
    """(id, d_inputs), a written table, and the parameters' gradients, from ``d_`` columns of the outputs."""
    return backward_with_sums(rows, part, params, inputs, outputs)[:2]


def backward_with_sums(rows: DataFrame, part: Part, params: Params, inputs: list[str], outputs: list[str]) -> tuple[DataFrame, Params, np.ndarray]:
    """As ``backward``, and the sums of the first output over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(params)
    names = sorted(params)
    empty = pa.array([None], pa.list_(pa.float64()))

    def run(batches):
        total, first = np.zeros(sum(v.size for v in held.value.values())), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            p = {k: tape.Var(v) for k, v in held.value.items()}
            x = {k: tape.Var(_matrix(batch.column(n))) for n, k in enumerate(inputs, 1)}
            made = part(p, x, batch.column(0).to_numpy())
            tape.backward([(made[k], _matrix(batch.column(n))) for n, k in enumerate(outputs, 1 + len(inputs))])
            total += np.concatenate([np.empty(0), *((np.zeros(p[k].value.size) if p[k].grad is None else p[k].grad.ravel()) for k in names)])
            first = first + made[outputs[0]].value.sum(axis=0)
            grads = [_lists(np.zeros_like(v.value) if v.grad is None else v.grad) for v in x.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *grads, pa.nulls(batch.num_rows, pa.list_(pa.float64()))], names=schema)
        sums = np.concatenate([total, np.atleast_1d(first)])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[empty] * len(inputs), _lists(sums[None])], names=schema)

    schema = ["id", *(f"d_{k}" for k in inputs), "sums"]
    kinds = ", ".join(["id long", *(f"d_{k} array<double>" for k in inputs), "sums array<double>"])
    both = shared.written(rows.select("id", *inputs, *(f"d_{k}" for k in outputs)).mapInArrow(run, kinds))
    summed = both.where("sums is not null").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).toPandas()  # a row for each parameter
    size = sum(v.size for v in params.values())
    flat = np.zeros(int(summed["at"].max()) + 1)
    flat[summed["at"]] = summed["s"]
    return both.where("id is not null").drop("sums"), unflatten(flat[:size], params), flat[size:]


def flatten(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflatten(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def product(adj: DataFrame, rows: DataFrame, column: str, width: int) -> DataFrame:
    """(id, column) times the adjacency (i, j, v), a written table."""
    return shared.written(graph.propagate(adj, rows, width, column, "id"))


def hops(adj: DataFrame, rows: DataFrame, column: str, width: int, n: int, out: str = "stack") -> DataFrame:
    """(id, out): the rows after 0 to ``n`` products, one after the other in one array."""
    each = [rows.select("id", column)]
    for _ in range(n):
        each.append(product(adj, each[-1], column, width))
    joined = each[0].withColumnRenamed(column, "_0")
    for k, h in enumerate(each[1:], 1):
        joined = joined.join(h.withColumnRenamed(column, f"_{k}"), "id")
    return joined.select("id", F.concat(*[F.col(f"_{k}") for k in range(n + 1)]).alias(out))


def hops_back(adj: DataFrame, rows: DataFrame, stack: str, width: int, n: int, out: str) -> DataFrame:
    """The gradient of ``hops``' input from that of the stack: each product goes back by one."""
    piece = lambda k: F.slice(stack, k * width + 1, width)
    g = rows.select("id", piece(n).alias(out))
    for k in range(n - 1, -1, -1):
        back = product(adj, g, out, width)
        g = rows.select("id", piece(k).alias("_own")).join(back, "id", "left").select("id", F.when(F.col(out).isNull(), F.col("_own")).otherwise(F.zip_with("_own", out, lambda a, b: a + b)).alias(out))
    return g


class Adam:
    """Steps of Adam with weight decay and a bound on the gradient's length."""

    def __init__(self, params: Params, rate: float, decay: float, clip: float | None = 5.0):
        self.rate, self.decay, self.clip, self.turn = rate, decay, clip, 0
        self.m = np.zeros(len(flatten(params)))
        self.v = np.zeros_like(self.m)

    def step(self, params: Params, grads: Params) -> Params:
        p, g = flatten(params), flatten(grads)
        if self.clip is not None:
            g = g * min(1.0, self.clip / max(float(np.linalg.norm(g)), 1e-12))
        g = g + self.decay * p
        self.turn += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        change = self.rate * (self.m / (1 - 0.9**self.turn)) / (np.sqrt(self.v / (1 - 0.999**self.turn)) + 1e-8)
        return unflatten(p - change, params)


def uniforms(ids: np.ndarray, width: int, *labels: int) -> np.ndarray:
    """Numbers in (0, 1) for each row and column, the same wherever the rows are."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        for label in labels:
            x = x ^ np.uint64((label * 0x8CB92BA72F3D8DD7 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(ids: np.ndarray, width: int, *labels: int) -> np.ndarray:
    u = uniforms(ids, 2 * width, *labels)
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])
