"""What the training-data operators share: Arrow column building, hashing of words, shared folders, components.

Batches: every function that runs in a task sees a slice of at most ``SLICE_BYTES`` of text at a time, and one
text at least, so the memory of a Python worker follows the longest text and not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spotweave.sources.shared import SMALL, passing, shared_folder, sized, written

__all__ = ["SMALL", "passing", "shared_folder", "sized", "written"]

#: Rows and bytes in an Arrow batch from the JVM (one row at least), and bytes of text that a function sees at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
SLICE_BYTES = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Let the JVM send Arrow batches of few rows and bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What a worker process keeps between tasks: one thing at most.
_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept in the worker process for its later tasks with the same ``key``. What was kept before goes."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """A task of another operator begins: its worker may come from one that kept much. What is free goes back to the machine."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


# --- columns from Arrow functions ---------------------------------------------------------------------------


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that would have the name of a result column (upper and lower case are one)."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes in column ``at``, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(_lengths(batch.column(at)), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text."""
    return column.cast(pa.binary()).to_pylist()


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], start: Callable[[], Callable[[pa.RecordBatch, int], list]]) -> DataFrame:
    """``df`` with the columns ``fields``, which an Arrow function makes from column ``text``.

    ``start`` is called once in each task and returns the function: it takes a slice of a batch and the place of
    the text column, and returns one list, NumPy or Arrow array for each field. All other columns pass through;
    those named like a field are replaced.
    """
    small_batches(df.sparkSession)
    kept = drop_clashing(df, [f.name for f in fields]).columns
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    at, keep = df.columns.index(text), [df.columns.index(c) for c in kept]
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for part in slices(batch, at):
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(make(part, at), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *made], names=names)

    return df.mapInArrow(run, schema)


# --- words and hashes ----------------------------------------------------------------------------------------

#: Words of letters A-Z (lower-cased), digits and every byte above 0x7F: all other bytes become blanks.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.translate(ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits, so that all bits of a hash depend on all words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes: their sum with an odd factor for each place, mixed."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * factors[k]
    return mix(total)


# --- groups that may be hot ---------------------------------------------------------------------------------


def salted_min(df: DataFrame, keys: list[str], value: str, out: str, salt: Column, salts: int = 64) -> DataFrame:
    """``keys``, ``_salt``, the smallest ``value`` of the keys as ``out``, and their rows as ``_n``.

    A join on the keys and ``_salt`` (``pmod(salt, salts)``) then deals a hot key to ``salts`` tasks. The
    smallest value is found from one row for each key and salt, so no task sees all rows of a key.
    """
    part = df.groupBy(*keys, F.pmod(salt, F.lit(salts)).alias("_salt")).agg(F.min(value).alias("_low"), F.count(F.lit(1)).alias("_rows"))
    every = part.groupBy(*keys).agg(F.min("_low").alias(out), F.sum("_rows").alias("_n"))
    return part.select(*keys, "_salt").join(every, keys)


#: A key with more than one of so many rows is hot.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` (a written table) left-joined with ``known`` (a written table, a row for each ``key``).

    ``known`` is broadcast where it is small. Else the keys that hold more than a thousandth of the rows, a thousand at most, are
    looked up by broadcast and the others by a join, so no task gets a hot key's rows.
    """
    if known.count() <= SMALL:
        return rows.join(F.broadcast(known), key, "left")
    hot = written(rows.groupBy(key).count().where(F.col("count") > rows.count() / HOT_SHARE).select(key))
    few = written(known.join(F.broadcast(hot), key, "left_semi"))  # HOT_SHARE rows at most
    other = rows.join(F.broadcast(hot), key, "left_anti").join(known, key, "left")
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, "left").unionByName(other)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` for each node of ``edges`` (columns ``a`` and ``b``, a < b): the smallest node reachable.

    Each round, a node takes the smallest label among its own and its neighbours', and then its label's label. The
    tables of labels are written; the rounds follow the logarithm of the longest path. A hub's edges and the nodes of a large
    component are looked up without meeting in one task.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = looked_up(both, written(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")))
        heads = step.select("label").distinct()
        up = written(heads.join(step.select("node", F.col("label").alias("top")), F.col("node") == heads["label"]).select(heads["label"], "top"))
        after = written(looked_up(step, up, "label").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        changed = not after.where(F.col("label") != F.col("old")).isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels


def more_links(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """``labels`` after more ``edges`` (``a``, ``b``): only those between different components are looked at."""
    if labels is None:
        return None if edges.isEmpty() else components(edges)
    ends = written(edges.select("a", "b"))
    for side in "ab":
        known = written(labels.select(F.col("node").alias(side), F.col("label").alias("_label")))
        ends = written(looked_up(ends, known, side).withColumn(side, F.coalesce("_label", side)).drop("_label"))
    ends = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if ends.isEmpty():
        return labels
    up = written(components(ends).select(F.col("node").alias("label"), F.col("label").alias("top")))
    moved = looked_up(labels, up, "label").select("node", F.coalesce("top", "label").alias("label"))
    new = up.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels.select("node"), "node", "left_anti")
    return written(moved.unionByName(new))


def component_ids(rows: DataFrame, labels: DataFrame | None, salts: int = 64) -> DataFrame:
    """``rows`` (``id``, ``node`` and others) with ``label`` (of the node's component) and ``component_id``, the smallest id of its rows.

    A node without a label is a component of its own; a row whose node is null is alone, with its own id. Rows of a hot node,
    and nodes of a hot component, are dealt to ``salts`` tasks.
    """
    salt = F.coalesce(F.xxhash64("id"), F.lit(0))
    lows = salted_min(rows.where(F.col("node").isNotNull()), ["node"], "id", "low", salt, salts).drop("_n").withColumnRenamed("_salt", "_row_salt")
    if labels is None:
        first = lows.select("node", "_row_salt", F.col("node").alias("label"), F.col("low").alias("component_id"))
    else:
        known = written(lows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        turn = F.xxhash64("node", "_row_salt")
        lowest = salted_min(known, ["label"], "low", "component_id", turn, salts).drop("_n")
        first = known.withColumn("_salt", F.pmod(turn, F.lit(salts))).join(lowest, ["label", "_salt"]).select("node", "_row_salt", "label", "component_id")
    out = rows.withColumn("_row_salt", F.pmod(salt, F.lit(salts))).join(written(first), ["node", "_row_salt"], "left")
    return out.select(*rows.columns, "label", F.coalesce("component_id", "id").alias("component_id"))
