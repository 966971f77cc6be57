"""Runs of models over slices: what is still to run, one run, and the command line.

``python -m spotweave.runner --data ROOT --out RUNS --methods adaptive baseline --seeds 0 1`` loads each slice once, runs each
(method, slice, seed) that has no record with its options yet, and adds its record as it ends, so it can be stopped and started again.
``--config NAME={"option": value}`` adds a variant. A run is a chain of Spark jobs; ``--workers`` of them are in flight at once, each in a
pool of its own, so that under fair scheduling none waits for another's long stage.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.operators import baseline, experiment, hierarchical, metrics, mixture, sampling
from spotweave.sources import shared, slices, tables

SCORES = ("ari", "nmi", "fms")
N_PCS, SEED = 200, 0


def configs_of(lines: Iterable[str]) -> dict[str, dict]:
    """Options by method: the methods that are always there, and ``NAME=JSON`` variants."""
    known = {"adaptive": {}, "baseline": {}, "baseline_deterministic": {"deterministic_eval": True}}
    for line in lines:
        name, options = line.split("=", 1)
        known[name] = json.loads(options)
    return known


def scores(spots: DataFrame, pred: DataFrame, refined: DataFrame) -> dict[str, float]:
    """Agreement of the labels with the clusters, and with those of the neighbourhood's vote."""
    out = {}
    for name, labels, column in (("", pred, "pred"), ("_refined", refined, "pred_refined")):
        rows = spots.select("spot_id", F.col("label").alias("truth")).join(labels.select("spot_id", F.col(column).alias("pred")), "spot_id")
        found = metrics.agreement(rows).first()
        out |= {f"{k.upper()}{name}": found[k] for k in SCORES}
    return out


def run_one(data: slices.Slice, method: str, options: dict, seed: int) -> dict:
    """The record of a run: fit, embed, cluster, evaluate, refine, evaluate. Unknown options raise an error."""
    names = data.spots.select("spot_id", "feat", "x", "y", "label", "batch")
    spots = shared.written(sampling.numbered(names, 0).drop("spot_id").withColumnRenamed("at", "spot_id"))
    began = time.time()
    if method.startswith("baseline"):
        model = baseline.Model(spots.drop("batch"), baseline.Config(n_clusters=data.n_clusters, seed=seed, **options)).fit()
    else:
        model = hierarchical.Model(spots, hierarchical.Config(seed=seed, **options)).fit()
    z = shared.written(model.embed())
    took = time.time() - began
    pred = shared.written(mixture.cluster(z, data.n_clusters, vector="z"))
    return {"method": method, "slice": "-".join(data.slices), "seed": seed, "time": took} | scores(spots, pred, metrics.refine(pred, spots))


def cached(spark: SparkSession, root: str, cache: str, slice_id: str) -> slices.Slice:
    """A slice from the cache, which it is put into before if it isn't there."""
    try:
        held = tables.read_cache(spark, cache, N_PCS, SEED).where(F.col("slice") == slice_id)
        missing = held.isEmpty()
    except Exception as error:  # no cache yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        missing = True
    if missing:
        data = slices.load_slice(spark, root, slice_id, N_PCS)
        tables.write_cache(data.spots.withColumn("slice", F.lit(slice_id)), cache, N_PCS, SEED)
        held = tables.read_cache(spark, cache, N_PCS, SEED).where(F.col("slice") == slice_id)
    return slices.Slice(held.drop("n_pcs", "seed", "slice"), (slice_id,), slices.clusters_of(slice_id))


def options_key(options: dict) -> str:
    """A digest of a method's options."""
    return hashlib.md5(json.dumps(options, sort_keys=True).encode()).hexdigest()


def jobs_left(spark: SparkSession, out: str, methods: list[str], slice_ids: list[str], seeds: list[int], configs: dict[str, dict]) -> list[tuple[str, str, int]]:
    """(method, slice, seed) of the jobs without a record with their options, seed by seed."""
    lists = [spark.createDataFrame([(v,) for v in values], f"{name} {kind}") for name, kind, values in (("method", "string", methods), ("slice", "string", slice_ids), ("seed", "int", seeds))]
    keys = spark.createDataFrame([(m, options_key(configs.get(m, {}))) for m in methods], "method string, options string")
    jobs = experiment.job_grid(*lists).join(F.broadcast(keys), "method")  # a row for each method
    try:
        jobs = experiment.pending(jobs, tables.read_records(spark, out))
    except Exception as error:  # no run yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    return [(r.method, r.slice, r.seed) for r in jobs.orderBy("seed", "slice", "method").collect()]  # a short list


def run_all(spark: SparkSession, root: str, out: str, cache: str, methods: list[str], slice_ids: list[str], seeds: list[int], configs: dict[str, dict], workers: int = 1) -> int:
    """Run what has no record; how many runs that were. A method without options known raises an error."""
    left = jobs_left(spark, out, methods, slice_ids, seeds, configs)
    if unknown := sorted({m for m, _, _ in left} - set(configs)):
        raise KeyError(f"unknown methods: {unknown}")
    data = {s: cached(spark, root, cache, s) for s in slice_ids}
    print(f"{len(left)} of {len(methods) * len(slice_ids) * len(seeds)} runs have no record yet", flush=True)

    def run(at: int, method: str, slice_id: str, seed: int) -> dict:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{at % workers}")
        spark.sparkContext.setJobGroup(f"{method}-{slice_id}-{seed}", f"{method} on {slice_id}, seed {seed}")
        record = run_one(data[slice_id], method, configs[method], seed)
        tables.write_run(spark, record | {"options": options_key(configs[method])}, out)
        return record

    with ThreadPoolExecutor(workers) as pool:
        for done in as_completed([pool.submit(inheritable_thread_target(spark)(run), at, *job) for at, job in enumerate(left)]):
            print(" ".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in done.result().items()), flush=True)
    return len(left)


def main(args: list[str] | None = None) -> None:
    every = [s for names in tables.DONORS.values() for s in names]
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True, help="folder with counts and metadata")
    parser.add_argument("--out", required=True, help="folder of the run records")
    parser.add_argument("--cache", help="folder of loaded slices; beside the records if not given")
    parser.add_argument("--slices", nargs="+", default=every)
    parser.add_argument("--seeds", nargs="+", type=int, default=[0, 1, 2])
    parser.add_argument("--methods", nargs="*", default=["baseline", "adaptive"])
    parser.add_argument("--config", nargs="*", default=[], help="NAME=JSON: a variant and its options")
    parser.add_argument("--workers", type=int, default=4)
    given = parser.parse_args(args)
    methods = list(dict.fromkeys([*given.methods, *(c.split("=", 1)[0] for c in given.config)]))
    spark = SparkSession.builder.appName("spotweave").config("spark.scheduler.mode", "FAIR").getOrCreate()
    run_all(spark, given.data, given.out, given.cache or f"{given.out.rstrip('/')}-cache", methods, given.slices, given.seeds, configs_of(given.config), given.workers)


if __name__ == "__main__":
    main()
