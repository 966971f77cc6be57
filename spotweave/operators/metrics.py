"""Agreement of labels, mixing of batches, and the neighbourhood vote. Labels are in columns ``truth`` and ``pred``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.operators import neighbours, pivots, places
from spotweave.sources import shared

#: Where all rows are held against all: rows of a block, blocks up to which they stay so small, and rows that a block grows to before there are more.
BLOCK_ROWS, FEW_BLOCKS, MOST_ROWS = 4000, 8, 64_000
#: Tasks that a value which many rows share is dealt to, and pairs up to which a signed-rank test's p is exact.
TIE_SALTS, EXACT_PAIRS = 32, 256


def labelled_only(rows: DataFrame, truth: str = "truth") -> DataFrame:
    return rows.where(F.col(truth).isNotNull())


def contingency(rows: DataFrame) -> DataFrame:
    """(truth, pred, n) over rows with a truth."""
    return labelled_only(rows).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row with ``ari``, ``nmi`` and ``fms``: all come from the contingency table and its margins."""
    cells = contingency(rows).select("truth", "pred", F.col("n").cast("double").alias("n"))
    a = cells.groupBy("truth").agg(F.sum("n").alias("s"))
    b = cells.groupBy("pred").agg(F.sum("n").alias("s"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda c: F.sum(F.col(c) * F.ln(c))
    one = cells.agg(F.sum("n").alias("t"), pairs("n").alias("tp"), entropy("n").alias("hc"))
    left = a.agg(pairs("s").alias("pa"), entropy("s").alias("ha"), F.count(F.lit(1)).alias("ka"))
    right = b.agg(pairs("s").alias("pb"), entropy("s").alias("hb"), F.count(F.lit(1)).alias("kb"))
    all_sums = one.crossJoin(left).crossJoin(right)  # one row each
    t = F.col("t")
    every = t * (t - 1) / 2
    expected = F.col("pa") * F.col("pb") / every
    middle = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(middle == expected, F.lit(1.0)).otherwise((F.col("tp") - expected) / (middle - expected))
    ha, hb = F.ln(t) - F.col("ha") / t, F.ln(t) - F.col("hb") / t
    info = F.ln(t) + F.col("hc") / t - F.col("ha") / t - F.col("hb") / t
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(1.0)).otherwise(F.when(ha + hb > 0, 2 * F.greatest(info, F.lit(0.0)) / (ha + hb)).otherwise(F.lit(0.0)))
    fms = F.when(F.col("pa") * F.col("pb") > 0, F.col("tp") / F.sqrt(F.col("pa") * F.col("pb"))).otherwise(F.lit(0.0))
    return all_sums.select(ari.alias("ari"), nmi.alias("nmi"), fms.alias("fms"))


def refine(labels: DataFrame, coords: DataFrame, k: int = 6, key: str = "spot_id", label: str = "pred") -> DataFrame:
    """(spot_id, pred, pred_refined, votes): a label with more than (k + 1) // 2 of the votes of a spot and its k nearest
    places replaces the spot's own; all votes are of the old labels."""
    near = neighbours.grid_neighbours(coords, k + 1, include_self=True, key=key)
    return vote(labels, near.select("i", "j"), k, key, label)


def vote(labels: DataFrame, near: DataFrame, k: int = 6, key: str = "spot_id", label: str = "pred") -> DataFrame:
    named = labels.select(F.col(key).alias("j"), F.col(label).alias("_l"))
    counts = near.join(named, "j").groupBy("i", "_l").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min_by("_l", F.struct(F.negative("n").alias("less"), F.col("_l"))).alias("_top"), F.max("n").alias("votes"))
    joined = labels.select(F.col(key), F.col(label)).join(best.withColumnRenamed("i", key), key)
    return joined.select(key, label, F.when(F.col("votes") > (k + 1) // 2, F.col("_top")).otherwise(F.col(label)).alias(f"{label}_refined"), "votes")


def mixing(feats: DataFrame, k: int = 30, key: str = "spot_id", vector: str = "feat", batch: str = "batch") -> DataFrame:
    """(i, ilisi): the inverse Simpson index of the batches among the k nearest, the spot itself among them."""
    near = pivots.pivot_neighbours(feats, feats, k, include_self=True, key=key, vector=vector)
    batches = feats.select(F.col(key).cast("long").alias("j"), F.col(batch).alias("b"))
    counts = near.join(batches, "j").groupBy("i", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return counts.groupBy("i").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("ilisi"))


def silhouette_of_all(rows: DataFrame, key: str = "spot_id", vector: str = "feat", label: str = "pred", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (silhouette): the mean over all rows, by Euclidean distance to all others.

    Rows are dealt to blocks by hash, and each pair of blocks is one group; what a row adds up for each label is merged by aggregation. A row is sent
    twice for each block, so there are ``FEW_BLOCKS`` of more than ``block_rows`` rows until these reach ``MOST_ROWS``. A group is compared by tiles.
    """
    import numpy as np
    import pandas as pd

    n = rows.count()
    blocks = max(1, min(-(-n // block_rows), FEW_BLOCKS), -(-n // MOST_ROWS))
    copies = W.partitionBy(key).orderBy(F.col(label).cast("string"), vector)  # rows with the same key are rows of their own
    numbered = rows.select(key, F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"), F.row_number().over(copies).alias("copy"))
    dealt = numbered.select(F.struct(F.col(key).alias("k"), "copy").alias("r"), "l", "v", F.pmod(F.xxhash64(key, "copy"), F.lit(blocks)).cast("int").alias("own")).select(F.to_json("r").alias("r"), "l", "v", "own")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("r", "l", "v", F.col("own").alias("q"), every.alias("p"))
    right = dealt.select("r", "l", "v", F.col("own").alias("p"), every.alias("q"))

    def add_up(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            names, codes = np.unique(b["l"].fillna("None").to_numpy().astype(str), return_inverse=True)
            x, y = np.array(a["v"].tolist()), np.array(b["v"].tolist())
            middle = y.mean(axis=0)  # so that far-off points lose no digits
            x, y = x - middle, y - middle
            member, size = (codes[:, None] == np.arange(len(names))).astype(float), np.sum(y**2, axis=1)
            same = pd.Index(b["r"]).get_indexer(a["r"])  # where a row meets itself
            for at in range(0, len(a), 500):
                part, sums = x[at : at + 500], 0.0
                for to in range(0, len(b), BLOCK_ROWS):
                    d = np.sqrt(np.maximum(np.sum(part**2, axis=1)[:, None] + size[to : to + BLOCK_ROWS] - 2 * part @ y[to : to + BLOCK_ROWS].T, 0.0))
                    own = same[at : at + 500] - to
                    met = np.flatnonzero((own >= 0) & (own < d.shape[1]))
                    d[met, own[met]] = 0.0
                    sums = sums + d @ member[to : to + BLOCK_ROWS]
                out.append(pd.DataFrame({"r": np.repeat(a["r"].to_numpy()[at : at + 500], len(names)), "l": np.repeat(a["l"].fillna("None").to_numpy()[at : at + 500], len(names)), "other": np.tile(names, len(part)), "s": sums.ravel(), "n": np.tile(member.sum(axis=0), len(part))}))
        return pd.concat(out) if out else pd.DataFrame({"r": [], "l": [], "other": [], "s": [], "n": []})

    parts = left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInPandas(add_up, "r string, l string, other string, s double, n double")
    sums = parts.groupBy("r", "l", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    a = F.max(F.when((F.col("l") == F.col("other")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    b = F.min(F.when(F.col("l") != F.col("other"), F.col("s") / F.col("n")))
    each = sums.groupBy("r").agg(a.alias("a"), b.alias("b"))
    most = F.greatest("a", "b")
    width = F.when(F.col("a").isNull() | F.col("b").isNull() | (most <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / most)
    return each.agg(F.avg(width).alias("silhouette"))


def silhouette(rows: DataFrame, sample: int | None = 5000, seed: int = 0, key: str = "spot_id", vector: str = "feat", label: str = "pred") -> DataFrame:
    """One row (silhouette): the mean over a sample of at most ``sample`` rows, by Euclidean distance within it; None: all rows.

    The sample is the reference side too, as the measure is defined; it has ``sample`` rows at most and is broadcast.
    """
    import numpy as np
    import pyarrow as pa

    if sample is None:
        return silhouette_of_all(rows, key, vector, label)
    picked = rows.select(F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key, F.lit(seed)).alias("h"), key).orderBy("h", key).limit(sample).select("l", "v").cache()
    held = rows.sparkSession.sparkContext.broadcast(picked.toPandas())  # sample rows

    def widths(batches):
        ref = held.value
        names, codes = np.unique(ref["l"].to_numpy().astype(str), return_inverse=True)
        points = np.array(ref["v"].tolist())
        sizes = np.bincount(codes)
        for batch in batches:
            out = []
            for l, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = np.sqrt(np.sum((points - np.array(v)) ** 2, axis=1))
                sums = np.bincount(codes, weights=d, minlength=len(names))
                own = int(np.searchsorted(names, l))
                if sizes[own] == 1 or len(names) < 2:
                    out.append(0.0)
                    continue
                a = sums[own] / (sizes[own] - 1)
                b = min(sums[k] / sizes[k] for k in range(len(names)) if k != own)
                out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["s"])

    return picked.mapInArrow(widths, "s double").agg(F.avg("s").alias("silhouette"))


def summary(runs: DataFrame, *by: str) -> DataFrame:
    """Per method, and ``by`` (such as ``donor`` or ``slice``): medians of the slices' means, means over runs, and the
    population deviation."""
    keys = ["method", *by]
    per_slice = runs.groupBy(*dict.fromkeys([*keys, "slice"])).agg(F.avg("ARI").alias("a"), F.avg("NMI").alias("n"), F.avg("FMS").alias("f"))
    medians = per_slice.groupBy(*keys).agg(F.median("a").alias("median_ari"), F.median("n").alias("median_nmi"), F.median("f").alias("median_fms"))
    means = runs.groupBy(*keys).agg(F.avg("ARI").alias("mean_ari"), F.stddev_pop("ARI").alias("std_ari"), F.avg("time").alias("mean_time"), F.count(F.lit(1)).alias("n_runs"))
    return medians.join(means, keys)


def ranks_with_ties(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``rows`` with ``rank``: the average rank of equal values, among the rows alike in ``by`` or among all.

    Places come from range partitions, so neither the table nor a group meets in one task. How many stand before a value and
    how many have it is a row for each value.
    """
    own = rows.select(*rows.columns, F.struct(*by, F.col(value)).alias("_tie"))
    found = places.placed(own, list(by), [value])
    salt = F.pmod(F.col("_place"), F.lit(TIE_SALTS))
    part = found.groupBy("_tie", salt.alias("_salt")).agg(F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_n"))
    ties = part.groupBy("_tie").agg(F.min("_low").alias("_low"), F.sum("_n").alias("_n"))
    known = shared.written(part.select("_tie", "_salt").join(ties, "_tie"))
    joined = found.withColumn("_salt", salt).join(known.withColumnsRenamed({"_tie": "_t", "_salt": "_s"}), (F.col("_salt") == F.col("_s")) & F.col("_tie").eqNullSafe(F.col("_t")))
    return joined.select(*rows.columns, (F.col("_low") + (F.col("_n") + 1) / 2.0).alias("rank"))


def null_share(twice: list[int], plus: int) -> float:
    """The exact two-sided p of a sum ``plus`` of some of the (doubled) ranks ``twice``, each in the sum or not by a coin.

    The chances of all sums are built up rank by rank.
    """
    import numpy as np

    chance = np.ones(1)
    for r in twice:
        grown = np.zeros(len(chance) + r)
        grown[: len(chance)] = chance / 2
        grown[r:] += chance / 2
        chance = grown
    return min(1.0, 2 * min(float(chance[: plus + 1].sum()), float(chance[plus:].sum())))


def signed_ranks(pairs: DataFrame, difference: str, *by: str) -> DataFrame:
    """(``by``, n, w_plus, w_minus, p): Wilcoxon's signed-rank test of the paired differences alike in ``by``, or of all.

    Differences that are null, NaN or zero don't count; equal sizes share their average rank. p is exact up to ``EXACT_PAIRS`` pairs,
    beyond by the normal law with the ranks' own variance.
    """
    import math

    import pandas as pd

    d = F.col(difference).cast("double")
    known = pairs.where(d.isNotNull() & ~F.isnan(d) & (d != 0)).select(*by, F.abs(d).alias("_far"), (d > 0).alias("_up"))
    ranked = shared.written(ranks_with_ties(known, "_far", *by).select(*by, F.round(F.col("rank") * 2).cast("long").alias("_twice"), "_up"))
    keys = [F.col(b).alias(f"_b{k}") for k, b in enumerate(by)]
    names = [f"_b{k}" for k in range(len(by))]
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_up"), F.col("_twice")).otherwise(0)).alias("plus"), F.sum("_twice").alias("every"), F.sum(F.col("_twice").cast("double") * F.col("_twice")).alias("squares"))
    sums = shared.written(sums.where("n > 0"))
    few = sums.where(F.col("n") <= EXACT_PAIRS).select(*names)
    alike = F.lit(True)
    for b, name in zip(by, names, strict=True):
        alike &= F.col(b).eqNullSafe(F.col(name))
    lists = ranked.join(few, alike).groupBy(*names).agg(F.collect_list("_twice").alias("ranks"))
    same = F.lit(True)
    for name in names:
        same &= F.col(name).eqNullSafe(F.col(f"_x{name}"))
    both = sums.join(lists.withColumnsRenamed({n: f"_x{n}" for n in names}), same, "left").select(*sums.columns, "ranks")

    def test(batches):
        for part in batches:
            out = []
            for n, plus, every, squares, ranks in zip(part["n"], part["plus"], part["every"], part["squares"], part["ranks"], strict=True):
                out.append(null_share([int(r) for r in ranks], int(plus)) if n <= EXACT_PAIRS else math.erfc(abs(plus - every / 2) / math.sqrt(squares / 4) / math.sqrt(2)))
            yield pd.DataFrame({**{k: part[k] for k in names}, "n": part["n"], "w_plus": part["plus"] / 2, "w_minus": (part["every"] - part["plus"]) / 2, "p": out})

    schema = ", ".join([*(f"{k} {both.schema[k].dataType.simpleString()}" for k in names), "n long, w_plus double, w_minus double, p double"])
    return both.mapInPandas(test, schema).withColumnsRenamed(dict(zip(names, by, strict=True)))
