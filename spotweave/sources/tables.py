"""Readers and sinks: long count tables, spot metadata, run records, and the slice cache.

Counts are a long table (one row for each count that isn't zero), spots are a table with their vectors as arrays. A
count matrix that comes as HDF5 has to be turned into the long table before; the library reads Parquet, TSV and JSON lines.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COUNTS = "slice string, spot_id string, gene string, cnt double"
METADATA = "barcode string, layer_guess_reordered string, row int, col int, imagecol double, imagerow double"
RUNS = "method string, slice string, seed int, time double, ARI double, NMI double, FMS double, ARI_refined double, NMI_refined double, FMS_refined double"
RUN_FIELDS = [field.split()[0] for field in RUNS.split(", ")]

#: Slices by donor, and the number of domains of each slice.
DONORS = {1: ["151507", "151508", "151509", "151510"], 2: ["151669", "151670", "151671", "151672"], 3: ["151673", "151674", "151675", "151676"]}
DOMAINS = {1: 7, 2: 5, 3: 7}


def slices(spark: SparkSession) -> DataFrame:
    """The slice catalog: ``slice``, ``donor``, ``n_clusters``."""
    return spark.createDataFrame([(s, d, DOMAINS[d]) for d, names in DONORS.items() for s in names], "slice string, donor int, n_clusters int")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A long count table; partition it by slice, and filters on slices reach the scan."""
    return spark.read.schema(COUNTS).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Spot metadata as TSV: label (null where there is none), array place, and coordinates (x, y)."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=METADATA, nullValue="NA")
    return raw.select(F.col("barcode").alias("spot_id"), F.col("imagecol").alias("x"), F.col("imagerow").alias("y"), F.col("row").alias("array_row"), F.col("col").alias("array_col"), F.col("layer_guess_reordered").alias("ground_truth"))


def unique_names(genes: DataFrame, name: str = "gene", place: str = "pos") -> DataFrame:
    """``genes`` with repeated names made unique: the second and later ones get ``-1``, ``-2`` and so on."""
    before = F.row_number().over(W.partitionBy(name).orderBy(place)) - 1
    return genes.withColumn("_n", before).withColumn(name, F.when(F.col("_n") > 0, F.concat_ws("-", name, F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def batch_codes(spots: DataFrame, order: list[str], slice_col: str = "slice") -> DataFrame:
    """``spots`` with ``batch``: the place of the slice in the given order, from 0. Slices that aren't in it have -1."""
    return spots.withColumn("batch", (F.array_position(F.array(*[F.lit(s) for s in order]), F.col(slice_col)) - 1).cast("long"))


def shifted(spots: DataFrame, offset: float | None = None) -> DataFrame:
    """``spots`` with each batch moved along x by one and a half times the span of all x, or ``offset``, so that places of
    two slices are never near."""
    if offset is not None:
        return spots.withColumn("x", F.col("x") + F.col("batch") * F.lit(float(offset) * 1.5))
    span = spots.agg((F.max("x") - F.min("x")).alias("_span"))
    return spots.crossJoin(F.broadcast(span)).withColumn("x", F.col("x") + F.col("batch") * F.col("_span") * F.lit(1.5)).drop("_span")  # one row is broadcast


def strict_lookup(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``meta``; a key without metadata raises an error when it is computed."""
    marked = rows.join(meta.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no metadata for "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return marked.withColumn(key, checked).drop("_found")


def write_cache(frame: DataFrame, path: str, n_pcs: int, seed: int) -> None:
    """The slice cache, keyed by slice, number of components and seed, so no entry is stale."""
    frame.withColumns({"n_pcs": F.lit(n_pcs), "seed": F.lit(seed)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("n_pcs", "seed", "slice").parquet(path)


def read_cache(spark: SparkSession, path: str, n_pcs: int, seed: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("n_pcs") == n_pcs) & (F.col("seed") == seed)).withColumn("slice", F.col("slice").cast("string"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Finished runs as JSON lines, one for each run."""
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records with their schema: slice names are digits, but strings."""
    return spark.read.schema(RUNS).json(path)


def write_run(spark: SparkSession, record: dict, path: str) -> bool:
    """A finished run (with ``options``, a digest of them) as a file of its own; False if there is one already.

    The file is written under a hidden name and renamed, so a reader sees whole records only, and its name follows from the run, so
    a run that is done twice has one record. A crash leaves at most a hidden file.
    """
    fields = {k: record.get(k) for k in [*RUN_FIELDS, "options"]}
    name = hashlib.md5("|".join(str(fields[k]) for k in ("method", "slice", "seed", "options")).encode()).hexdigest()
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    target, making = to_path(path, f"{name}.json"), to_path(path, f".{name}-{uuid.uuid4().hex}.json")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(making, True)
    out.write(bytearray((json.dumps(fields) + "\n").encode()))
    out.close()
    if files.exists(target) or not files.rename(making, target):
        files.delete(making, False)
        return False
    return True


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``read_runs`` with ``options``: null in records of other tools."""
    return spark.read.schema(f"{RUNS}, options string").json(path)
