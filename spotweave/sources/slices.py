"""Slices as tables that a model takes: one, or several for a joint analysis.

A root folder holds ``counts`` (the long table, partitioned by slice or not) and ``<slice>/metadata.tsv`` for each slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.operators import preprocess
from spotweave.sources import shared, tables


@dataclass(frozen=True)
class Slice:
    """``spots``: ``spot_id``, ``feat``, ``x``, ``y``, ``label`` (null where there is none), ``batch``, ``name``; the slices
    that are in it, and the number of domains to look for."""

    spots: DataFrame
    slices: tuple[str, ...]
    n_clusters: int

    def n(self) -> int:
        return self.spots.count()


def read_slice(spark: SparkSession, root: str, slice_id: str) -> tuple[DataFrame, DataFrame]:
    """The counts of a slice (slice, spot_id, gene, cnt), and its spots with places and labels. A spot with counts that has no
    metadata raises an error when it is computed."""
    counts = tables.read_counts(spark, f"{root}/counts").where(F.col("slice") == slice_id)
    meta = tables.read_metadata(spark, f"{root}/{slice_id}/metadata.tsv")
    spots = tables.strict_lookup(counts.select("spot_id").distinct(), meta, "spot_id")
    return counts, spots.withColumn("slice", F.lit(slice_id))


def clusters_of(slice_id: str) -> int:
    """The domains that the slice has, by its donor."""
    return next(tables.DOMAINS[d] for d, names in tables.DONORS.items() if slice_id in names)


def load_slice(spark: SparkSession, root: str, slice_id: str, n_pcs: int = 200, n_top: int = 2000) -> Slice:
    """One slice, preprocessed."""
    counts, spots = read_slice(spark, root, slice_id)
    feats = preprocess.preprocess(counts, spots, n_top, n_pcs)
    out = spots.select("spot_id", "x", "y", F.col("ground_truth").alias("label"), F.lit(0).cast("long").alias("batch"), F.col("spot_id").alias("name"))
    return Slice(shared.written(out.join(feats, "spot_id")), (slice_id,), clusters_of(slice_id))


def load_joint(spark: SparkSession, root: str, slice_ids: list[str], n_pcs: int = 200, n_top: int = 2000, offset: float | None = None) -> Slice:
    """Several slices over the genes that all have, preprocessed together; batches are numbered in the given order, and each
    is moved along x so that no neighbours are of two slices."""
    parts = [read_slice(spark, root, s) for s in slice_ids]
    name = F.concat_ws("-", "spot_id", "slice")
    counts, spots = parts[0]
    for more_counts, more_spots in parts[1:]:
        counts, spots = counts.unionByName(more_counts), spots.unionByName(more_spots)
    counts, spots = (t.withColumn("spot_id", name) for t in (counts, spots))
    feats = preprocess.preprocess(preprocess.shared_genes(counts), spots, n_top, n_pcs)
    placed = tables.shifted(tables.batch_codes(spots, slice_ids), offset)
    out = placed.select("spot_id", "x", "y", F.col("ground_truth").alias("label"), "batch", F.col("spot_id").alias("name"))
    return Slice(shared.written(out.join(feats, "spot_id")), tuple(slice_ids), clusters_of(slice_ids[0]))
