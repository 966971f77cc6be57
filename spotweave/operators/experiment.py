"""The experiment grid: jobs, variants, and what is still to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["method", "slice", "seed"]
#: Options that a method takes.
OPTIONS = ["expr_graph", "refine_graph", "adaptive_hops", "local_global", "fusion", "auto_balance", "batch_decoder"]


def job_grid(methods: DataFrame, slices: DataFrame, seeds: DataFrame) -> DataFrame:
    """All jobs; the lists are short. Each has a model: variants named after the baseline run it."""
    grid = seeds.crossJoin(slices).crossJoin(methods)
    return grid.withColumn("model", F.when(F.col("method").startswith("baseline"), "baseline").otherwise("adaptive"))


def pending(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """The jobs that have no record. Where both have ``options``, a record of others doesn't count, but one without does."""
    if "options" in jobs.columns and "options" in runs.columns:
        done = runs.select(*[F.col(k).alias(f"_{k}") for k in [*KEYS, "options"]])
        same = F.coalesce(F.col("_options"), F.col("options")) == F.col("options")
        for k in KEYS:
            same &= F.col(k) == F.col(f"_{k}")
        return jobs.join(done, same, "left_anti")
    return jobs.join(runs.select(*KEYS), KEYS, "left_anti")


def parse_variants(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, options) and what to ``keep``: ``NAME=JSON`` split at the first sign; the options are a map of texts."""
    parts = F.split(column, "=", 2)
    return lines.select(*keep, parts[0].alias("name"), F.from_json(parts[1], "map<string,string>").alias("options"))


def unknown_options(variants: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, unknown) and what to ``keep``: the options that no method takes."""
    return variants.select(*keep, "name", F.array_sort(F.array_except(F.map_keys("options"), F.array(*[F.lit(o) for o in OPTIONS]))).alias("unknown"))


def config_key(variants: DataFrame) -> DataFrame:
    """(name, key): a digest of the options, so that a record of other options under one name is not taken for it."""
    ordered = F.array_sort(F.transform(F.map_entries("options"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return variants.select("name", F.md5(F.array_join(ordered, ";").cast("binary")).alias("key"))
