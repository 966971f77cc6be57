"""Graphs as edge tables (i, j, w), both directions materialised, and products of them with vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.functions import vectors as V
from spotweave.operators import neighbours, pivots, selection
from spotweave.sources import shared

#: Components that are summed in one row.
WIDE = 64


def symmetrise(pairs: DataFrame) -> DataFrame:
    """(i, j) in both directions, each once, without loops."""
    return pairs.select("i", "j").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()


def binarise(edges: DataFrame) -> DataFrame:
    return edges.where("w > 0").select("i", "j").distinct().withColumn("w", F.lit(1.0))


def union_graph(*graphs: DataFrame) -> DataFrame:
    """The edges of any of the graphs, with weight 1."""
    out = graphs[0].select("i", "j")
    for g in graphs[1:]:
        out = out.union(g.select("i", "j"))
    return out.distinct().withColumn("w", F.lit(1.0))


def coalesce(entries: DataFrame) -> DataFrame:
    """One entry for each place, the sum of those given."""
    return entries.groupBy("i", "j").agg(F.sum("w").alias("w"))


def place_knn(spots: DataFrame, k: int = 6) -> DataFrame:
    """The symmetric graph of the k nearest places, with weight 1."""
    return symmetrise(neighbours.grid_neighbours(spots, k)).withColumn("w", F.lit(1.0))


def at_ends(edges: DataFrame, feats: DataFrame, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """``edges`` with the vectors of their ends, ``a`` and ``b``."""
    left = feats.select(F.col(key).alias("i"), F.col(vector).alias("a"))
    right = feats.select(F.col(key).alias("j"), F.col(vector).alias("b"))
    return edges.join(left, "i").join(right, "j")


def edge_distances(edges: DataFrame, feats: DataFrame, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """(i, j, d): 1 - cosine of the ends."""
    unit = feats.select(key, V.l2_normalise(vector).alias("_u"))
    return at_ends(edges.select("i", "j"), unit, "_u", key).select("i", "j", (F.lit(1.0) - V.dot("a", "b")).alias("d"))


def scale_of(distances: DataFrame) -> float | None:
    """The exact median of the distances of directed edges (a written table), and a little; None without edges."""
    median = selection.quantile(distances, "d", 0.5)
    return None if median is None else median + 1e-8


def expression_weights(edges: DataFrame, feats: DataFrame, tau: float | None = None, floor: float = 0.05, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """Weights exp(-d / tau) in [floor, 1] for the edges; weights that they have are ignored."""
    d = edge_distances(edges, feats, vector, key)
    if tau is None:
        d = shared.written(d)
        tau = scale_of(d)
    return d.select("i", "j", V.clip(F.exp(-F.col("d") / F.lit(tau)), floor, 1.0).alias("w"))


def mnn_edges(feats: DataFrame, k: int = 3, batch: str = "batch", key: str = "spot_id", vector: str = "feat") -> DataFrame:
    """Mutual k nearest neighbours by cosine between each two batches, in both directions, with weight 1."""
    unit = feats.select(key, batch, V.l2_normalise(vector).alias("_u"))
    near = pivots.pivot_neighbours(unit, unit, k, key=key, vector="_u", group=batch).select("i", "j")
    return near.intersect(near.select(F.col("j").alias("i"), F.col("i").alias("j"))).withColumn("w", F.lit(1.0))


def with_loops(edges: DataFrame, spots: DataFrame, key: str = "spot_id") -> DataFrame:
    return edges.select("i", "j", "w").union(spots.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(1.0).alias("w")))


def normalize_adj(edges: DataFrame, spots: DataFrame, self_loops: bool = True, key: str = "spot_id") -> DataFrame:
    """(i, j, v): the adjacency with loops, divided by the roots of both ends' degrees."""
    full = with_loops(edges, spots, key) if self_loops else edges.select("i", "j", "w")
    inverse = full.groupBy("i").agg((F.lit(1.0) / F.sqrt(F.greatest(F.sum("w"), F.lit(1e-12)))).alias("s"))
    other = inverse.select(F.col("i").alias("j"), F.col("s").alias("t"))
    return full.join(inverse, "i").join(other, "j").select("i", "j", (F.col("s") * F.col("w") * F.col("t")).alias("v"))


def propagate(adj: DataFrame, feats: DataFrame, width: int, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """The product of ``adj`` (i, j, v) with the vectors: one sum for each component, merged before the exchange."""
    if width > WIDE:  # parts of a long vector are rows of their own
        cut = feats.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(width - 1), F.lit(WIDE)), lambda a: F.slice(vector, a + 1, WIDE))).alias("_part", "_x"))
        sums = adj.join(cut.withColumnRenamed(key, "j"), "j").groupBy("i", "_part").agg(*[F.sum(F.col("v") * F.get("_x", F.lit(c))).alias(f"_{c}") for c in range(WIDE)])
        parts = sums.groupBy("i").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_part", F.array(*[F.col(f"_{c}") for c in range(WIDE)]).alias("x")))), lambda s: s["x"])).alias("_all"))
        return parts.select(F.col("i").alias(key), F.slice("_all", 1, width).alias(vector))
    joined = adj.join(feats.select(F.col(key).alias("j"), F.col(vector).alias("_x")), "j")
    sums = joined.groupBy("i").agg(*[F.sum(F.col("v") * F.col("_x")[c]).alias(f"_{c}") for c in range(width)])
    return sums.select(F.col("i").alias(key), F.array(*[F.col(f"_{c}") for c in range(width)]).alias(vector))


def multihop(adj: DataFrame, feats: DataFrame, width: int, hops: int, vector: str = "feat", key: str = "spot_id") -> list[DataFrame]:
    """The vectors after 0, 1, ... ``hops`` products."""
    out = [feats.select(key, vector)]
    for _ in range(hops):
        out.append(propagate(adj, out[-1], width, vector, key))
    return out


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices (i, j, v)."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    left = a.select("i", F.col("j").alias("k"), "v")
    return left.join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def refine_graph(weights: DataFrame, fresh: DataFrame, mix: float = 0.5) -> DataFrame:
    """mix * fresh + (1 - mix) * weights, over the edges of ``weights``."""
    new = fresh.select("i", "j", F.col("w").alias("_w"))
    return weights.join(new, ["i", "j"]).select("i", "j", (F.lit(float(mix)) * F.col("_w") + F.lit(1.0 - mix) * F.col("w")).alias("w"))


def neighbourhood_summary(adj: DataFrame, feats: DataFrame, width: int, vector: str = "feat", key: str = "spot_id") -> DataFrame:
    """The logistic function of the vectors' product with ``adj``."""
    return propagate(adj, feats, width, vector, key).withColumn(vector, F.transform(vector, V.sigmoid))


def hop_attention(stack: Column, query: Column) -> Column:
    """Softmax over hops of query . tanh(hop), for an array of hop vectors."""
    return V.softmax(F.transform(stack, lambda h: V.dot(query, F.transform(h, F.tanh))))


def hop_softmax(scores: DataFrame, key: str = "spot_id", score: str = "s") -> DataFrame:
    """Softmax of ``score`` within each ``key``, on long rows."""
    w = W.partitionBy(key)
    shifted = scores.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return shifted.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")
