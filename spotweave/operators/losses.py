"""Losses of graph autoencoders as aggregations: each takes a table and returns one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.functions import vectors as V

#: Rows of a sample that is held against itself.
MOST_CONTRAST = 4096


def scaled_cosine_error(rows: DataFrame, x: str, y: str, alpha: float = 2.0) -> DataFrame:
    """Mean of (1 - cosine) to the power alpha."""
    return rows.agg(F.avg(F.pow(F.lit(1.0) - V.cosine(x, y), F.lit(float(alpha)))).alias("sce"))


def mean_squared_error(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mean over all components of all rows."""
    return rows.agg((F.sum(V.squared_distance(x, y)) / F.sum(F.size(x))).alias("mse"))


def reconstruction(rows: DataFrame, x: str, y: str, mask: str) -> DataFrame:
    """The cosine error of masked rows and a tenth of the squared error of all."""
    error = F.pow(F.lit(1.0) - V.cosine(x, y), F.lit(2.0))
    return rows.agg((F.avg(F.when(F.col(mask), error)) + F.lit(0.1) * F.sum(V.squared_distance(x, y)) / F.sum(F.size(x))).alias("rec"))


def kl_normal(rows: DataFrame, mean: str, logvar: str) -> DataFrame:
    """Mean over rows of the KL from the unit normal, summed over components."""
    return rows.agg(F.avg(V.total(F.zip_with(mean, logvar, V.kl_to_unit_normal))).alias("kl"))


def kl_log_std(rows: DataFrame, mean: str, logstd: str) -> DataFrame:
    """The baseline's KL: ``logstd`` is a log standard deviation, and the mean over rows is divided by their number again."""
    each = V.total(F.zip_with(mean, logstd, lambda m, s: F.lit(1.0) + 2.0 * s - m * m - F.exp(2.0 * s)))
    return rows.agg((F.lit(-0.5) / F.count(F.lit(1)) * F.avg(each)).alias("kl"))


def info_nce(rows: DataFrame, a: str, b: str, tau: float = 0.5, key: str = "spot_id") -> DataFrame:
    """Symmetric cross entropy of the rows' similarities, of vectors of length 1. ``rows`` is a contrast sample of at
    most ``MOST_CONTRAST`` rows; more raise an error."""
    if rows.limit(MOST_CONTRAST + 1).count() > MOST_CONTRAST:
        raise ValueError(f"a contrast sample has at most {MOST_CONTRAST} rows")
    left = rows.select(F.col(key).alias("i"), _unit(a).alias("_a"))
    right = rows.select(F.col(key).alias("j"), _unit(b).alias("_b"))
    logits = left.crossJoin(F.broadcast(right)).select("i", "j", (V.dot("_a", "_b") / F.lit(float(tau))).alias("l"))  # a sample with itself

    def side(by: str) -> DataFrame:
        top = logits.groupBy(by).agg(F.max("l").alias("m"))
        sums = logits.join(top, by).groupBy(by).agg((F.first("m") + F.ln(F.sum(F.exp(F.col("l") - F.col("m"))))).alias("z"))
        own = logits.where("i = j").select(F.col("i").alias(by), "l") if by == "i" else logits.where("i = j").select("j", "l")
        return sums.join(own, by).agg(F.avg(F.col("z") - F.col("l")).alias(f"ce_{by}"))

    return side("i").crossJoin(side("j")).select(((F.col("ce_i") + F.col("ce_j")) / 2).alias("nce"))


def _unit(v: str) -> Column:
    """The vector over its length, or over a tiny number if that is less."""
    length = F.greatest(V.norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def cross_level(rows: DataFrame, a: str, b: str, mode: str = "cos", tau: float = 0.5, key: str = "spot_id") -> DataFrame:
    """One row (xlevel): ``cos`` is less the mean cosine of the two levels, ``spot`` the contrast of the rows, a sample,
    ``nbr`` the same where ``b`` is the neighbourhood's mean of the second level; ``none`` is 0."""
    if mode == "none":
        return rows.sparkSession.range(1).select(F.lit(0.0).alias("xlevel"))
    if mode == "cos":
        return rows.agg(F.avg(-V.dot(_unit(a), _unit(b))).alias("xlevel"))
    if mode in ("spot", "nbr"):
        return info_nce(rows, a, b, tau, key).withColumnRenamed("nce", "xlevel")
    raise ValueError(f"mode is none, cos, spot or nbr, not {mode!r}")


def bilinear(z: str, s: str, weights: list[list[float]], bias: float) -> Column:
    """z . W s + b."""
    w = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    return V.dot(z, F.transform(w, lambda row: V.dot(row, s))) + F.lit(float(bias))


def local_global(rows: DataFrame, z: str, summary: str, z_other: str, summary_other: str, weights: list[list[float]], bias: float) -> DataFrame:
    """One row (lg): cross entropy of the bilinear form. A view with its own neighbourhood's summary counts as true, with
    the other view's as false; the two means over both views are added."""
    pairs = [(z, summary, 1.0), (z_other, summary_other, 1.0), (z_other, summary, 0.0), (z, summary_other, 0.0)]
    each = F.array(*[V.bce_with_logits(bilinear(a, b, weights, bias), F.lit(y)) for a, b, y in pairs])
    return rows.select(each.alias("_e")).agg(F.avg((F.col("_e")[0] + F.col("_e")[1] + F.col("_e")[2] + F.col("_e")[3]) / 2).alias("lg"))


def edge_bce(edges: DataFrame, units: DataFrame, tau: float = 0.5, key: str = "spot_id", vector: str = "feat") -> DataFrame:
    """The mean cross entropy of edges (i, j, label 1) and that of negative edges (label 0), added; the logit is the cosine over tau."""
    a = units.select(F.col(key).alias("i"), F.col(vector).alias("_a"))
    b = units.select(F.col(key).alias("j"), F.col(vector).alias("_b"))
    each = V.bce_with_logits(V.dot(_unit("_a"), _unit("_b")) / F.lit(float(tau)), "label")
    found = edges.join(a, "i").join(b, "j").select("label", each.alias("_e"))
    return found.agg((F.avg(F.when(F.col("label") == 1, F.col("_e"))) + F.avg(F.when(F.col("label") == 0, F.col("_e")))).alias("edge"))


def adjacency_bce(edges: DataFrame, scale: Column, logit: str = "logit", label: str = "label") -> DataFrame:
    return edges.agg((scale * F.avg(V.bce_with_logits(logit, label))).alias("adj"))


def class_balance(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """One row (scale): n^2 / (2 (n^2 - the sum of A + I))."""
    n = spots.agg(F.count(F.lit(1)).cast("double").alias("n"))
    e = edges.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("e"))
    return n.crossJoin(e).select((F.col("n") * F.col("n") / (2 * (F.col("n") * F.col("n") - F.col("e") - F.col("n")))).alias("scale"))


def student_t(points: DataFrame, centroids: DataFrame, alpha: float = 1.0, key: str = "spot_id", vector: str = "feat") -> DataFrame:
    """(spot_id, k, q): soft assignments; ``centroids`` (k, centre) are few and broadcast."""
    pairs = points.select(key, vector).crossJoin(F.broadcast(centroids))
    raw = pairs.select(key, "k", F.pow(F.lit(1.0) + V.squared_distance(vector, "centre") / F.lit(float(alpha)), F.lit(-(alpha + 1.0) / 2.0)).alias("_q"))
    return raw.select(key, "k", (F.col("_q") / F.sum("_q").over(W.partitionBy(key))).alias("q"))


def sharpened_target(soft: DataFrame, key: str = "spot_id") -> DataFrame:
    """``soft`` with p = (q^2 / column sum) / row sum. Column sums are aggregated and joined: k rows."""
    columns = soft.groupBy("k").agg(F.sum("q").alias("f"))
    raw = soft.join(F.broadcast(columns), "k").withColumn("_p", F.col("q") * F.col("q") / F.col("f"))
    return raw.withColumn("p", F.col("_p") / F.sum("_p").over(W.partitionBy(key))).select(key, "k", "q", "p")


def assignment_kl(target: DataFrame) -> DataFrame:
    """Mean of p (ln p - ln q) over all rows and clusters."""
    return target.agg(F.avg(F.col("p") * (F.ln("p") - F.ln("q"))).alias("kl"))


def hop_prior_kl(weights: Column, prior: list[float]) -> Column:
    """KL of hop weights from a prior, for an array of weights."""
    p = F.array(*[F.lit(float(x)) for x in prior])
    return V.total(F.zip_with(weights, p, lambda w, q: w * (F.ln(w) - F.ln(q))))


def kl_warm_up(epoch: Column, epochs: int) -> Column:
    """The KL's share in an epoch: it grows over the first quarter."""
    return F.least(F.lit(1.0), epoch.cast("double") / F.lit(float(max(1, epochs // 4))))


#: The weights of the losses where no balance is learned.
MANUAL = {"rec": 10.0, "xlevel": 0.3, "lg": 1.0, "edge": 0.1}


def balanced(losses: dict[str, Column], balance: str = "kendall", log_vars: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> Column:
    """The sum of the losses: ``kendall`` of exp(-s) L + s with learned ``log_vars``, ``init`` of each over its ``first``
    value (0.001 at least), ``manual`` with fixed weights."""
    if balance == "kendall":
        parts = [F.exp(-log_vars[k]) * v + log_vars[k] for k, v in losses.items()]
    elif balance == "init":
        parts = [v / F.greatest(first[k], F.lit(1e-3)) for k, v in losses.items()]
    elif balance == "manual":
        parts = [F.lit(MANUAL[k]) * v for k, v in losses.items()]
    else:
        raise ValueError(f"balance is kendall, init or manual, not {balance!r}")
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out
