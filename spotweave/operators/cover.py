"""Exact k nearest neighbours by a cover of space with packs of rows, with ties to the smaller id.

A cover says which pack a place belongs to and, from what is known of each pack's places, which packs can hold something as
near to a query as a bound. ``pivots.Cells`` covers vectors of any length, ``tiles.Tiles`` the plane. The search is the same:

1. Equal vectors of a group are one place with its k + 1 smallest ids; equal queries are one query. A vector that a third of all
   rows share makes no pairs within itself.
2. First pass: each query looks into the nearest packs with k + 1 ids. Its (k + 1)-th distance there is a bound.
3. Second pass: it looks into all other packs that the cover can't rule out by the bound.
4. A pack's queries and places are dealt to blocks of ``BLOCK_ROWS``; each pair of blocks is a group, compared in one product.
5. Vectors without much structure look into nearly all packs. Where the cover has areas of neighbouring packs, a query goes in the second pass to
   each area once, with its bound and a bit for each pack that it looks into, and comes back with no more than the k + 1 nearest within the bound. There
   are few areas and few blocks of queries (``blocks_of``), so what is sent follows the rows until a block would have more than ``MOST_ROWS``.

That is some fifteen jobs whatever the rows look like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.sources import shared

#: Rows of a pack's block, rows of a block compared at once, tasks that a hot place's rows are dealt to.
BLOCK_ROWS, AT_ONCE, SALTS = 4000, 500, 32
#: In the second pass by areas: blocks up to which they stay that small, and rows that a block grows to before there are more.
FEW_BLOCKS, MOST_ROWS = 8, 100_000


def blocks_of(n: int) -> int:
    return max(1, min(-(-n // BLOCK_ROWS), FEW_BLOCKS), -(-n // MOST_ROWS))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest_in(a: pd.DataFrame, b: pd.DataFrame, g: int, k: int, include_self: bool) -> pd.DataFrame:
    x, y = np.array(a["v"].tolist(), float), np.array(b["v"].tolist(), float)
    middle = y.mean(axis=0)
    u, v = x - middle, y - middle  # far-off points lose no digits
    size_u, size_v = np.sum(u * u, axis=1), np.sum(v * v, axis=1)
    far = size_u[:, None] + size_v - 2 * u @ v.T
    mine, other = a["i"].to_numpy(), b["i"].to_numpy()
    if not include_self:
        far[mine[:, None] == other] = np.inf
    limit = np.partition(far, k - 1, axis=1)[:, k - 1] if len(other) > k else np.full(len(mine), np.inf)
    slack = 1e-9 * (size_u + size_v.max())  # rounding of the product
    rows, cols = np.nonzero((far <= (limit + slack)[:, None]) & np.isfinite(far))
    d2 = np.sum((y[cols] - x[rows]) ** 2, axis=1)  # as it is defined, so equal distances are equal numbers
    order = np.lexsort((other[cols], d2, rows))
    rows, cols, d2 = rows[order], cols[order], d2[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = rank < k
    return pd.DataFrame({"i": mine[rows[top]], "g": np.full(int(top.sum()), g), "j": other[cols[top]], "d2": d2[top]})



def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def _in_packs(places: DataFrame, cover) -> DataFrame:
    """The places with their ``pack`` and what the cover notes of each (``note``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, cover.value.at_once):
                batch = whole.slice(start, cover.value.at_once)
                pack, cell, r = cover.value.place(matrix(batch.column(1)))
                more = [pa.array(pack.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(r)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "pack", "cell", "r"])

    return shared.written(places.select("j", "v", "g", "ids").mapInArrow(run, f"j long, v {_kind(places)}, g long, ids array<long>, pack int, cell int, r double"))


def visits(asked: DataFrame, cover, enough: int, other: bool) -> DataFrame:
    """(p, v, g, pack): the packs of group ``g`` that each query looks into; with a column ``bounds`` (by group) of ``asked`` (p, v, own), in the second pass."""
    second = "bounds" in asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cover.value
        for whole in batches:
            for start in range(0, whole.num_rows, known.at_once):
                batch = whole.slice(start, known.at_once)
                x, own = matrix(batch.column(1)), batch.column(2).to_numpy()
                bounds = [dict(b) for b in batch.column(3).to_pylist()] if second else None
                for g in known.groups:
                    asking = np.flatnonzero(own != g) if other else np.arange(len(x))
                    if not len(asking):
                        continue
                    bound = np.array([bounds[k].get(g, np.inf) for k in asking]) if second else None
                    for rows, packs in known.looks(x[asking], g, enough, bound):
                        for k in range(0, len(rows), 10_000):
                            part = pa.array(asking[rows[k : k + 10_000]])
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), pa.array(np.full(len(part), g, np.int64)), pa.array(packs[k : k + 10_000].astype(np.int32))], names=["p", "v", "g", "pack"])

    return asked.select("p", "v", "own", *(["bounds"] if second else [])).mapInArrow(run, f"p long, v {_kind(asked)}, g long, pack int")


def _search(visiting: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(p, g, j, d2): the ``k`` nearest ids that each query meets in each pack that it looks into."""
    visiting = shared.written(visiting)
    sizes = places.groupBy("g", "pack").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("np"))
    blocks = visiting.groupBy("g", "pack").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nq"))
    blocks = F.broadcast(blocks.join(sizes, ["g", "pack"]))  # a row for each group and pack
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")  # noqa: E731  (the type of ``every``: unlike types go to unlike partitions and never meet)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visiting.join(blocks, ["g", "pack"]).select("p", "v", "g", "pack", own("p", "nq").alias("q"), every("np").alias("b"))
    right = places.join(blocks, ["g", "pack"]).select("j", "v", "ids", "g", "pack", own("j", "np").alias("b"), every("nq").alias("q"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            ids = b.set_index("j")["ids"]
            for at in range(0, len(a), AT_ONCE):
                part = a.iloc[at : at + AT_ONCE].rename(columns={"p": "i"})
                top = nearest_in(part, b.rename(columns={"j": "i"}), int(b["g"].iloc[0]), k, True)
                found.append(pd.DataFrame({"p": top["i"], "g": top["g"], "ids": ids.loc[top["j"]].to_numpy(), "d2": top["d2"]}))
        none = pd.DataFrame({"p": np.empty(0, np.int64), "g": np.empty(0, np.int64), "ids": np.empty(0, object), "d2": np.empty(0)})  # lists must be objects for Arrow
        return pd.concat(found) if found else none

    by = ["g", "pack", "q", "b"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, "p long, g long, ids array<long>, d2 double")
    return met.select("p", "g", F.explode("ids").alias("j"), "d2")


def _closer(best: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``best`` (query, d2, id, place, by these) with the places ``at`` of ``y`` that are among the ``k`` nearest of the queries ``rows`` of ``x``, ``limit`` lowered to the k-th."""
    middle = y[at].mean(axis=0)
    v = y[at] - middle  # far-off points lose no digits
    size_v = np.sum(v * v, axis=1)
    found = [best]
    for start in range(0, len(rows), AT_ONCE):
        own = rows[start : start + AT_ONCE]
        u = x[own] - middle
        size_u = np.sum(u * u, axis=1)
        far = size_u[:, None] + size_v - 2 * u @ v.T
        slack = 1e-9 * (size_u + size_v.max())  # rounding of the product
        near = far <= (limit[own] + slack)[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k)
        if len(many):
            kth = np.partition(far[many], k - 1, axis=1)[:, k - 1]
            near[many] &= far[many] <= (kth + 2 * slack[many])[:, None]
        q, c = np.nonzero(near)
        if len(q):
            c = at[c]
            found.append((own[q], np.sum((y[c] - x[own[q]]) ** 2, axis=1), ids[c], c))  # as it is defined, so equal distances are equal numbers
    if len(found) == 1:
        return best
    query, d2, low, place = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.lexsort((low, d2, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    order, query, rank = order[rank < k], query[rank < k], rank[rank < k]
    last = rank == k - 1
    limit[query[last]] = np.minimum(limit[query[last]], d2[order[last]])
    return query, d2[order], low[order], place[order]


def _in_area(a: pa.Table, b: pa.Table, first: int, k: int) -> pa.Table | None:
    """(p, g, d2s, js): for each query of ``a`` (p, v, bound, packs) the ``k`` nearest ids in an area's places ``b`` (j, v, ids, pack), no farther than its bound."""
    a, b = a.combine_chunks(), b.combine_chunks()
    x, y = (matrix(t["v"].chunk(0)) for t in (a, b))
    looks = np.unpackbits(np.frombuffer(b"".join(a["packs"].to_pylist()), np.uint8).reshape(len(x), -1), axis=1)
    pack, ids = b["pack"].to_numpy() - first, b["j"].to_numpy()
    limit = np.minimum(a["bound"].to_numpy() ** 2, np.finfo(float).max)  # nothing is infinitely far
    best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
    by_pack = np.argsort(pack, kind="stable")
    for at in np.split(by_pack, np.flatnonzero(np.diff(pack[by_pack])) + 1):
        rows = np.flatnonzero(looks[:, pack[at[0]]])
        if len(rows):
            best = _closer(best, x, y, at, ids, rows, limit, k)
    query, d2, _, place = best
    if not len(query):
        return None
    lists = b["ids"].chunk(0)
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    n = np.diff(starts)[place]  # a place's ids are all as near
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    query, d2, j = np.repeat(query, n), np.repeat(d2, n), flat[np.repeat(starts[place], n) + within]
    order = np.lexsort((j, d2, query))
    query, d2, j = query[order], d2[order], j[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    query, d2, j = query[top], d2[top], j[top]
    cuts = np.flatnonzero(np.diff(query, prepend=-1))
    ends = pa.array(np.append(cuts, len(query)).astype(np.int32))
    group = pa.array(np.full(len(cuts), a["g"][0].as_py(), np.int64))
    return pa.table([a["p"].chunk(0).take(pa.array(query[cuts])), group, pa.ListArray.from_arrays(ends, pa.array(d2)), pa.ListArray.from_arrays(ends, pa.array(j))], names=["p", "g", "d2s", "js"])


def _search_areas(asked: DataFrame, places: DataFrame, cover, k: int, other: bool, blocks: int) -> DataFrame:
    """(p, g, d2s, js): the ``k`` nearest ids, no farther than ``bounds`` of ``asked`` (p, v, own, bounds), that each query meets in each area of other packs than in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cover.value
        for whole in batches:
            for start in range(0, whole.num_rows, known.at_once):
                batch = whole.slice(start, known.at_once)
                x, own, bounds = matrix(batch.column(1)), batch.column(2).to_numpy(), [dict(b) for b in batch.column(3).to_pylist()]
                for g in known.groups:
                    asking = np.flatnonzero(own != g) if other else np.arange(len(x))
                    if not len(asking):
                        continue
                    bound = np.array([bounds[n].get(g, np.inf) for n in asking])
                    go = known.goes(x[asking], g, k, bound)
                    for area, (first, end) in enumerate(known.areas[g]):
                        rows = np.flatnonzero(go[:, first:end].any(axis=1))
                        if len(rows):
                            bits = pa.array([r.tobytes() for r in np.packbits(go[rows, first:end], axis=1)], pa.binary())
                            part = pa.array(asking[rows])
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), pa.array(bound[rows]), pa.array(np.full(len(rows), g, np.int64)), pa.array(np.full(len(rows), area, np.int32)), bits], names=["p", "v", "bound", "g", "area", "packs"])

    rows = [(g, pack, area) for g, areas in cover.value.areas.items() for area, (first, end) in enumerate(areas) for pack in range(first, end)]
    areas = F.broadcast(places.sparkSession.createDataFrame(rows, "g long, pack int, area int"))  # a row for each group and pack
    visiting = asked.select("p", "v", "own", "bounds").mapInArrow(run, f"p long, v {_kind(asked)}, bound double, g long, area int, packs binary")
    left = visiting.withColumn("q", F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int"))
    right = places.join(areas, ["g", "pack"]).select("j", "v", "ids", "g", "pack", "area", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))

    def near(key, a: pa.Table, b: pa.Table) -> pa.Table:
        found = _in_area(a, b, cover.value.areas[key[0].as_py()][key[1].as_py()][0], k) if len(a) and len(b) else None
        return found if found is not None else pa.table({"p": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "d2s": pa.array([], pa.list_(pa.float64())), "js": pa.array([], pa.list_(pa.int64()))})

    by = ["g", "area", "q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(near, "p long, g long, d2s array<double>, js array<long>")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("p", "g").orderBy("d2", "j"))).where(F.col("rank") <= k).drop("rank")


def neighbours(queries: DataFrame, points: DataFrame, k: int, include_self: bool, other: bool, start: Callable[[DataFrame, int], object], long: bool = False) -> DataFrame:
    """(i, g, j, rank, d2) for ``queries`` and ``points`` (i, v, g): the ``k`` nearest in the same group, or with ``other`` in each other group.

    ``start`` makes the cover from the places (j, v, g, ids) and their number. Rows with nulls take no part. ``long`` vectors are sent in single precision if all
    of them are numbers of it, and rows find their place by the vector's hash if no two places have the same.
    """
    spark = queries.sparkSession
    with shared.passing(spark):
        whole = "i is not null and v is not null and g is not null"
        asked = shared.written(queries.where(whole))
        refs = asked if points is queries else shared.written(points.where(whole))
        single = long and all(side.where(F.exists("v", lambda x: x != x.cast("float").cast("double"))).isEmpty() for side in ([asked] if refs is asked else [asked, refs]))
        if single:
            asked, refs = (side.withColumn("v", F.col("v").cast("array<float>")) for side in (asked, refs))
        ranked = refs.groupBy("v", "g", F.pmod(F.xxhash64("i"), F.lit(SALTS)).alias("s")).agg(F.array_sort(F.collect_set("i")).alias("ids"))
        few = ranked.select("v", "g", F.slice("ids", 1, k + 1).alias("ids")).groupBy("v", "g").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
        held = shared.written(few.select(F.col("ids")[0].alias("j"), "v", "g", "ids"))
        n = held.count()
        if not n or asked.isEmpty():
            return shared.written(asked.select("i", "g", F.col("i").alias("j"), F.lit(1).alias("rank"), F.lit(0.0).alias("d2")).limit(0), keep=True)
        cover = start(held, n)
        held = _in_packs(held, spark.sparkContext.broadcast(cover))
        notes = held.groupBy("g", "cell").agg(F.sum(F.size("ids")).alias("n"), *cover.notes()).limit(shared.SMALL + 1).toPandas()
        if len(notes) > shared.SMALL:
            raise ValueError(f"more than {shared.SMALL} cells of groups: give fewer groups")
        cover.learn(notes)
        known = spark.sparkContext.broadcast(cover)
        # equal queries of a group are one, with the smallest id; their rows are looked up by salted keys
        by = "v"
        if long and points is queries and held.groupBy("g", F.xxhash64("v")).count().where("count > 1").isEmpty():
            asked, by = asked.select("i", F.xxhash64("v").alias("h"), "g"), "h"
        salted = asked.groupBy(by, "g", F.pmod(F.xxhash64("i"), F.lit(SALTS)).alias("s")).agg(F.min("i").alias("low"))
        once = salted.groupBy(by, "g").agg(F.min("low").alias("p"))
        parts = shared.written(salted.join(once, [by, "g"]).select(by, "g", "s", "p"))
        ends = held.select(F.col("j").alias("p"), "v", F.col("g").alias("own")) if by == "h" else parts.select("p", "v", F.col("g").alias("own"))
        places = shared.written(ends.dropDuplicates(["p", "own"]))
        first = shared.written(_best(_search(visits(places, known, k + 1, other), held, k + 1), k + 1))
        bound = first.groupBy("p", "g").agg(F.count(F.lit(1)).alias("c"), F.sqrt(F.max("d2")).alias("u")).where(F.col("c") > k)
        bounds = bound.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("g", "u"))).alias("bounds"))
        empty_map = F.create_map().cast("map<bigint,double>")
        again = places.join(bounds, "p", "left").select("p", "v", "own", F.coalesce("bounds", empty_map).alias("bounds"))
        if cover.areas:
            second = _search_areas(again, held, known, k + 1, other, blocks_of(places.count()))
            both = first.select("p", "g", F.array("d2").alias("d2s"), F.array("j").alias("js")).unionByName(second).groupBy("p", "g")
            lists = both.agg(F.flatten(F.collect_list("d2s")).alias("d2"), F.flatten(F.collect_list("js")).alias("j")).select("p", "g", F.slice(F.sort_array(F.arrays_zip("d2", "j")), 1, k + 1).alias("near"))
        else:
            second = _search(visits(again, known, k + 1, other), held, k + 1)
            lists = _best(first.unionByName(second), k + 1).groupBy("p", "g").agg(F.array_sort(F.collect_list(F.struct("d2", "j"))).alias("near"))
        keyed = parts.select("p", "s").distinct().join(lists.withColumnRenamed("g", "to"), "p")
        rows = asked.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(SALTS))).join(parts, [by, "g", "s"]).select("i", "p", "s").join(keyed, ["p", "s"])
        near = F.col("near") if include_self else F.filter("near", lambda x: x["j"] != F.col("i"))
        out = rows.select("i", F.col("to").alias("g"), F.posexplode(F.slice(near, 1, k)).alias("at", "x"))
        return shared.written(out.select("i", "g", F.col("x.j").alias("j"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.d2").alias("d2")), keep=True)
