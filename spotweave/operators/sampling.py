"""Samples by hash: the same rows in any engine, at any number of partitions, without a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.functions import vectors as V

#: First hex digits of a hash that rows are counted by.
DIGITS = 4


def bernoulli_mask(rate: float, *parts: Column | str) -> Column:
    """True for a share ``rate`` of rows, by the hash of the parts (such as id, epoch, seed)."""
    return V.hashed(*parts) < F.lit(f"{int(rate * 2**32):08x}")


def exact_mask(rows: DataFrame, rate: float, seed: int, key: str = "spot_id") -> DataFrame:
    """``rows`` with ``masked`` for exactly floor(rate n) of them: those first in the order of hashes.

    Rows are counted by the hash's first digits; only those whose digits hold the last rank are sorted.
    """
    hashed = rows.withColumn("_h", V.hashed(key, F.lit(seed)))
    most, before, last = 0, 0, None
    counts = hashed.groupBy(F.substring("_h", 1, DIGITS).alias("d")).count().orderBy("d").collect()  # 16 ** DIGITS rows at most
    most = int(rate * sum(r["count"] for r in counts))
    for r in counts:
        last = r["d"]
        if before + r["count"] >= most:
            break
        before += r["count"]
    if not most:
        return rows.withColumn("masked", F.lit(False))
    ranked = hashed.where(F.substring("_h", 1, DIGITS) == last).select("_h", key).orderBy("_h", key).limit(most - before)
    edge = ranked.agg(F.max(F.struct("_h", key)).alias("_last"))
    return hashed.crossJoin(F.broadcast(edge)).withColumn("masked", F.struct("_h", key) <= F.col("_last")).drop("_h", "_last")  # one row is broadcast


def numbered(rows: DataFrame, seed: int, key: str = "spot_id", out: str = "at") -> DataFrame:
    """``rows`` with their places ``out``, 0 to n - 1, in the order of hashes.

    Rows are numbered among those with the same first digits of the hash; how many stand before these is a sum over the
    counts by digits, a table of 16 ** DIGITS rows at most.
    """
    hashed = rows.withColumn("_h", V.hashed(key, F.lit(seed))).withColumn("_d", F.substring("_h", 1, DIGITS))
    counts = hashed.groupBy("_d").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_d", (F.sum("_c").over(W.orderBy("_d")) - F.col("_c")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_d").orderBy("_h", key)) - 1
    return hashed.join(F.broadcast(before), "_d").withColumn(out, F.col("_before") + within).drop("_h", "_d", "_before")


def contrast_sample(rows: DataFrame, n: int, seed: int, key: str = "spot_id") -> DataFrame:
    """``n`` rows without replacement."""
    return rows.withColumn("_h", V.hashed(key, F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")


def negative_edges(edges: DataFrame, spots: DataFrame, epoch: int | None = None, key: str = "spot_id") -> DataFrame:
    """(i, j, label 0): each edge's first end with another spot, drawn by hash for the epoch (None: once for all epochs).

    The draw is a place among all spots, so ids may be any numbers.
    """
    places = numbered(spots.select(key), 0, key).select(F.col(key).alias("j"), "at")
    return drawn(edges, places, spots.count(), epoch)


def drawn(edges: DataFrame, places: DataFrame, n: int, epoch: int | None = None) -> DataFrame:
    """``negative_edges`` from the spots' places (``j``, ``at``) and their number."""
    draw = F.conv(V.hashed("i", "j", F.lit("once" if epoch is None else epoch)), 16, 10).cast("long")
    return edges.select("i", F.pmod(draw, F.lit(n)).alias("at")).join(places, "at").select("i", "j", F.lit(0.0).alias("label"))


def permuted(rows: DataFrame, seed: int, key: str = "spot_id", vector: str = "feat") -> DataFrame:
    """``rows`` with the vectors dealt anew: each row takes that of the row after it in the order of hashes, the last
    that of the first. Vectors move by a join on the rows' places."""
    placed = numbered(rows, seed, key, "_at")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    given = placed.crossJoin(F.broadcast(n)).select(F.pmod(F.col("_at") - 1, F.col("_n")).alias("_at"), F.col(vector).alias("_given"))  # one row is broadcast
    return placed.join(given, "_at").withColumn(vector, F.col("_given")).select(*rows.columns)
