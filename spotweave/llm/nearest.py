"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

1. Rows whose vectors have one direction (unit vectors equal to 12 digits) are one node (its id: the smallest row id), so a
   common vector is one node and no group of copies is looked at pair by pair.
2. The start: nodes are dealt by hash into buckets of about ``BUCKET``, twice, and take near ones of their buckets.
3. NN-descent: each round joins every node with its neighbours and those that have it as a neighbour (``NEIGHBOURS`` of
   them at most, a hashed sample, as the method has it); the members of such a list are neighbours of neighbours of each
   other. They are compared in one product where one of the two came to the list in the last round, and pairs better
   than the worst neighbour that either has so far are merged into the graph. The graph is a written table of (u, w, s)
   each round. Rounds end when few edges change, or after ``ROUNDS``.
4. Greedy search: a query starts at its own node. Each hop expands the best ``EXPAND`` nodes of its
   best ``BEAM`` that it has not expanded, and scores all their neighbours. It ends when all of every query's best ``BEAM``
   are expanded.
5. The best ``RESCORED`` are scored again in double precision on the original vectors; nodes are replaced by their rows. Scores that
   are equal to 12 digits are ties, here and in the result, as parallel vectors of other lengths differ in the last digit.

All rows are indexed; nothing is fitted on a sample. Where the nodes' vectors take ``SHARED_BYTES`` at most they are
broadcast, else they are joined to the lists.

Components may be as small or as large as doubles are. Rows whose vector is null, empty, zero or holds a null or a component that isn't finite take no part, nor do
rows without an id; vectors of another length than most (ties: the longest) take no part. Of rows that repeat an id, the
one whose vector sorts first counts. Ties go to the smaller id. With fewer candidates than asked for, all reached are returned. A table
without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotweave.llm import common

#: Neighbours in the graph, nodes in a starting bucket, most rounds, the share of changed edges to end at, and the
#: pairs that a list may offer each of its members in a round.
NEIGHBOURS, BUCKET, ROUNDS, CHANGED, OFFERED = 32, 256, 8, 0.02, 6
#: Of the search: nodes kept in view, nodes expanded in a hop, nodes scored again.
BEAM, EXPAND, RESCORED = 128, 32, 24
#: Bytes of vectors that may be broadcast.
SHARED_BYTES = 64 << 20


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    kept = rows.where(good).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sizes = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).select("size")
    return kept.join(F.broadcast(sizes), F.size("vector") == F.col("size")).drop("size")


def unit(vector: Column) -> Column:
    """The unit vector. Components are divided by the largest first, so that no square is zero or infinite that shouldn't be."""
    even = _bound(F.array_max(F.transform(vector, F.abs)), lambda most: F.transform(vector, lambda x: x / most))
    return _bound(even, lambda v: _bound(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), lambda length: F.transform(v, lambda x: x / length)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once for a row and not for each component that reads it."""
    return F.transform(F.array(value), body)[0]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with that of ``b``, in double precision. Rows are multiplied by powers of two first, which changes no digit
    of the result, but for products that would be zero or infinite."""
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None]) for v in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Vectors:
    """Unit vectors of the nodes: broadcast where they are small, else joined."""

    def __init__(self, nodes: DataFrame, shared_bytes: int):
        spark = nodes.sparkSession
        self.size = nodes.count()
        first = nodes.select(F.size("vector").alias("n")).limit(1).collect()
        self.dims = first[0]["n"] if first else 0
        self.units = nodes.select("id", F.transform(unit(F.col("vector")), lambda x: x.cast("float")).alias("unit"))
        self.shared = None
        if self.size * self.dims * 4 <= shared_bytes:
            found = self.units.toArrow()  # shared_bytes at most
            ids = found["id"].to_numpy()
            units = pa.concat_arrays(found["unit"].chunks).flatten().to_numpy().reshape(-1, max(1, self.dims)) if len(ids) else np.zeros((0, 1), np.float32)
            order = np.argsort(ids)
            self.shared = spark.sparkContext.broadcast((ids[order], units[order]))

    def attach(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with the unit vector of ``node`` as ``name`` if vectors are joined; a null column if they are broadcast."""
        if self.shared is not None:
            return rows.withColumn(name, F.lit(None).cast("array<float>"))
        return rows.join(self.units.select(F.col("id").alias(node), F.col("unit").alias(name)), node)

    def reader(self) -> Callable[[np.ndarray, pa.Array], np.ndarray]:
        """The function that gives a task the vectors of the ids, from the broadcast or from the column."""
        shared, dims = self.shared, self.dims

        def read(ids: np.ndarray, column: pa.Array) -> np.ndarray:
            if shared is None:
                return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            known, units = shared.value
            return units[np.searchsorted(known, ids)]

        return read


def _offers(lists: DataFrame, read: Callable, offered: int) -> DataFrame:
    """(u, w, s) of the best pairs in each list (``members``: structs of ``m``, ``worst``, ``new`` and ``unit``) with a new member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            members = column.flatten()
            ids = members.field("m").to_numpy(zero_copy_only=False)
            worst = members.field("worst").to_numpy(zero_copy_only=False)
            new = members.field("new").to_numpy(zero_copy_only=False) > 0
            units = read(ids, members.field("unit"))
            us, ws, ss = [], [], []
            for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
                if b - a < 2:
                    continue
                near = units[a:b] @ units[a:b].T
                np.fill_diagonal(near, -9.0)
                near[~(new[a:b, None] | new[None, a:b])] = -9.0
                n = min(offered, b - a - 1)
                at = np.argpartition(-near, n - 1, axis=1)[:, :n]
                s = np.take_along_axis(near, at, 1)
                good = s > worst[a:b, None]
                us.append(np.repeat(ids[a:b], good.sum(1)))
                ws.append(ids[a:b][at][good])
                ss.append(s[good])
            none = np.empty(0)
            found = [np.concatenate(x) if x else none for x in (us, ws, ss)]
            yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(found[2].astype(np.float32))], names=["u", "w", "s"])

    return lists.select("members").mapInArrow(run, "u long, w long, s float")


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` edges of each node; ``fresh`` of an edge is 0 if it was in the graph before."""
    dealt = edges.repartition("u")
    once = dealt.groupBy("u", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "w")))
    return common.written(ranked.where(F.col("rank") <= k).drop("rank"))


def _member(node: str = "m") -> Column:
    return F.struct(F.col(node).alias("m"), "worst", "new", "unit")


def build_graph(vectors: Vectors, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """The graph: (u, w, s) for the neighbours w of each node u."""
    read = vectors.reader()
    buckets = max(1, -(-vectors.size // BUCKET))
    start = None
    for seed in (1, 2):
        dealt = vectors.attach(vectors.units.select(F.col("id").alias("m")), "m", "unit").withColumns({"worst": F.lit(-9.0).cast("float"), "new": F.lit(1)})
        lists = dealt.groupBy(F.pmod(F.xxhash64("m", F.lit(seed)), F.lit(buckets)).alias("v")).agg(F.collect_list(_member()).alias("members"))
        offers = _offers(lists, read, max(1, neighbours // 2))
        start = offers if start is None else start.unionByName(offers)
    graph = _nearest(start.withColumn("fresh", F.lit(1)), neighbours)
    for turn in range(rounds):
        ends = graph.select(F.col("u").alias("v"), F.col("w").alias("m"), F.col("fresh").alias("new"))
        sample = W.partitionBy("v").orderBy(F.xxhash64("m", F.lit(turn)), "m")
        back = graph.select(F.col("w").alias("v"), F.col("u").alias("m"), F.col("fresh").alias("new")).withColumn("rank", F.row_number().over(sample)).where(F.col("rank") <= neighbours).drop("rank")
        worst = graph.groupBy(F.col("u").alias("m")).agg(F.when(F.count(F.lit(1)) >= neighbours, F.min("s")).otherwise(F.lit(-9.0)).cast("float").alias("worst"))
        once = ends.union(back).groupBy("v", "m").agg(F.max("new").alias("new"))
        members = vectors.attach(once.join(worst, "m"), "m", "unit")
        lists = members.groupBy("v").agg(F.collect_list(_member()).alias("members"), F.max("new").alias("_new")).where("_new = 1")
        offers = _offers(lists, read, OFFERED).withColumn("fresh", F.lit(1))
        graph = _nearest(graph.withColumn("fresh", F.lit(0)).unionByName(offers), neighbours)
        counts = graph.agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("all")).first()
        if (counts["fresh"] or 0) <= CHANGED * counts["all"]:
            break
    return graph.select("u", "w", "s")


def search_graph(graph: DataFrame, vectors: Vectors, starts: DataFrame) -> DataFrame:
    """(q, w, s): nodes seen from each query node in ``starts`` (column ``q``), best ``BEAM`` of each."""
    read = vectors.reader()
    sample = W.partitionBy("x").orderBy(F.desc("s"), "y")
    back = graph.select(F.col("w").alias("x"), F.col("u").alias("y"), "s").withColumn("rank", F.row_number().over(sample)).where(F.col("rank") <= NEIGHBOURS)
    ways = common.written(graph.select(F.col("u").alias("x"), F.col("w").alias("y")).union(back.select("x", "y")).distinct())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            s = np.einsum("ij,ij->i", read(q, batch.column(2)), read(w, batch.column(3))) if len(q) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))], names=["q", "w", "s"])

    def scored(pairs: DataFrame) -> DataFrame:
        both = vectors.attach(vectors.attach(pairs, "q", "a"), "w", "b")
        return both.select("q", "w", "a", "b").mapInArrow(score, "q long, w long, s float").withColumn("done", F.lit(False))

    best, turn = W.partitionBy("q").orderBy(F.desc("s"), "w"), W.partitionBy("q").orderBy("done", F.desc("s"), "w")
    beam = common.written(starts.select("q", F.col("q").alias("w"), F.lit(1.0).cast("float").alias("s"), F.lit(False).alias("done")))
    seen = beam.select("q", "w")  # all nodes scored so far: each hop adds a table of its own
    while True:
        opened = common.written(beam.withColumn("turn", F.row_number().over(turn)).where((F.col("turn") <= EXPAND) & ~F.col("done")).select("q", F.col("w").alias("x")))
        if opened.isEmpty():
            break
        reached = opened.join(ways, "x").select("q", F.col("y").alias("w")).distinct().join(seen, ["q", "w"], "left_anti")
        fresh = common.written(scored(reached))
        seen = seen.union(fresh.select("q", "w"))
        marked = beam.join(opened.select("q", F.col("x").alias("w"), F.lit(True).alias("now")), ["q", "w"], "left").select("q", "w", "s", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        # what a hop leaves out is worse than BEAM others for good
        beam = common.written(marked.unionByName(fresh).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= BEAM).drop("rank"))
    return beam.withColumn("rank", F.row_number().over(best)).select("q", "w", "s", "rank")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found for each row where ``is_query`` (over ``id``) holds."""
    common.small_batches(rows.sparkSession)
    once = usable(rows, key, vector).groupBy("id").agg(F.min("vector").alias("vector"))
    once = common.written(once.withColumn("even", unit(F.col("vector"))))
    direction = F.to_json(F.transform("even", lambda x: F.round(x, 12) + F.lit(0.0)))
    taking = common.written(once.select("id", "vector", F.xxhash64(direction).alias("d1"), F.xxhash64(F.lit(7), direction).alias("d2")))
    # a direction's node; a common direction sends one row from each task and is joined by salted keys
    salt = F.xxhash64("id")
    lows = common.salted_min(taking, ["d1", "d2"], "id", "node", salt)
    members = common.written(taking.withColumn("_salt", F.pmod(salt, F.lit(64))).join(lows, ["d1", "d2", "_salt"]).select("id", "node", "vector"))
    nodes = members.where("id = node").select("id", "vector")
    vectors = Vectors(nodes, shared_bytes)
    graph = build_graph(vectors)
    queries = common.written(members.where(is_query).select(F.col("id").alias("query_id"), F.col("node").alias("q")))
    found = search_graph(graph, vectors, queries.select("q").distinct())
    top = found.where(F.col("rank") <= RESCORED).select("q", "w")

    def scored(pairs: DataFrame, *names: str) -> DataFrame:
        """``names`` and the exact ``score`` of the vectors ``a`` and ``b``."""

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1)) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosines(a, b), pa.float64())], names=[*names, "score"])

        return pairs.select(*names, "a", "b").mapInArrow(exact, f"{names[0]} long, {names[1]} long, score double")

    both = top.join(nodes.select(F.col("id").alias("q"), F.col("vector").alias("a")), "q").join(nodes.select(F.col("id").alias("w"), F.col("vector").alias("b")), "w")
    # k + 1 rows of a node are enough: one of them may be the query itself
    low = W.partitionBy("node").orderBy("id")
    few = members.select("id", "node").withColumn("rank", F.row_number().over(low)).where(F.col("rank") <= k + 1).select(F.col("node").alias("w"), F.col("id").alias("vec_id"))
    order = W.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "vec_id")
    listed = common.written(scored(both, "q", "w").join(few, "w").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).select("q", "vec_id"))
    # the rows' own vectors, which may be longer or shorter than their node's
    ends = common.written(members.join(common.sized(common.written(listed.select(F.col("vec_id").alias("id")).distinct())), "id", "left_semi").select(F.col("id").alias("vec_id"), F.col("vector").alias("b")))
    asked = queries.join(members.select(F.col("id").alias("query_id"), F.col("vector").alias("a")), "query_id")
    near = scored(asked.join(listed, "q").where("vec_id <> query_id").join(ends, "vec_id"), "query_id", "vec_id")
    own = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return near.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
