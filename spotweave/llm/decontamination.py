"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, and windows of each text against it.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. A window is ``n`` consecutive words of
an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is
hit. Each hit of a 64-bit hash is verified against the window's words before it counts.

The windows of all items are counted first. A broadcast holds ``BLOCK_WINDOWS`` of them at most; where there are more,
they are dealt by hash to several blocks, and each block is one more pass of the rows through an Arrow function,
without a shuffle. Documents are scanned whole.

Null and empty texts and texts without words have no words, no hits, and are not contaminated; an item without
words has no window. Repeated documents are each judged; repeated items count once. Null item ids are left out. Columns
of the input that are named like a result are replaced. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm import common

N = 10
#: Windows in one broadcast: about 100 bytes each on the driver and in a worker.
BLOCK_WINDOWS = 500_000

_WINDOWS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("block_key", T.LongType())])
_STATE = [T.StructField("_n_words", T.LongType()), T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.LongType()))]


def item_windows(benchmark: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct window of each item: ``item_id``, its words, their number, and a key to deal it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, 1)):
            ids, sizes, words, keys = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1)), strict=True):
                w = common.alnum_words(t)
                size = min(n, len(w))
                for joined in {b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} if w else ():
                    ids.append(i)
                    sizes.append(size)
                    words.append(joined)
                    keys.append(xxhash.xxh3_64_intdigest(joined, i & 0xFFFFFFFFFFFFFFFF) >> 1)  # items that share a window are dealt apart
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(words, pa.binary()), pa.array(keys, pa.int64())], names=_WINDOWS.names)

    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _WINDOWS).distinct()


class WindowSet:
    """Windows by their number of words and hash; a table of bits says quickly that a hash is not there."""

    def __init__(self, rows: list):
        self.sizes: dict[int, tuple[np.ndarray, dict]] = {}
        by_size: dict[int, dict[int, dict[bytes, list[int]]]] = {}
        for item, size, words, _ in rows:
            words = bytes(words)
            key = int(common.windows(common.hash_words(words.split(b" ")), size)[0])
            by_size.setdefault(size, {}).setdefault(key, {}).setdefault(words, []).append(item)
        for size, found in by_size.items():
            bits = max(10, math.ceil(math.log2(len(found) * 16)))
            table = np.zeros(1 << bits, bool)
            table[np.fromiter(found, np.uint64, len(found)) & np.uint64((1 << bits) - 1)] = True
            self.sizes[size] = (table, found)

    def scan(self, words: list[bytes], hashes: np.ndarray, hit: np.ndarray, items: set[int]) -> None:
        """Mark the words inside occurrences in ``hit`` and add the items to ``items``."""
        for size, (table, found) in self.sizes.items():
            keys = common.windows(hashes, size)
            for at in np.flatnonzero(table[keys & np.uint64(len(table) - 1)]).tolist():
                if same := found.get(int(keys[at])):
                    if ids := same.get(b" ".join(words[at : at + size])):
                        hit[at : at + size] = True
                        items.update(ids)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", item: str = "item_id", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (one byte a word: 1 where it is hit; null without hits) and ``items`` (sorted ids)."""
    sc = docs.sparkSession.sparkContext
    grams = common.written(item_windows(benchmark, n, item))
    blocks = max(1, math.ceil(grams.count() / block_windows))
    out = docs
    for k in range(blocks):
        block = grams if blocks == 1 else grams.where(F.pmod("block_key", F.lit(blocks)) == k)
        shared = sc.broadcast([tuple(r) for r in block.collect()])  # at most about block_windows rows
        out = _pass(out, shared, text, first=k == 0)
    kept = common.drop_clashing(out, ["n_words", "hit_words", "items"])
    return kept.withColumnsRenamed({"_n_words": "n_words", "_hits": "hit_words", "_items": "items"})


def _pass(docs: DataFrame, shared, text: str, first: bool) -> DataFrame:
    before = None if first else (docs.columns.index("_hits"), docs.columns.index("_items"))

    def start():
        common.let_go()
        windows = WindowSet(shared.value)

        def make(part: pa.RecordBatch, at: int) -> list:
            counts, marks, items = [], [], []
            old = [[None] * part.num_rows] * 2 if before is None else [part.column(i).to_pylist() for i in before]
            for t, was_hit, had in zip(common.texts_of(part.column(at)), *old, strict=True):
                words = common.alnum_words(t)
                hit = np.frombuffer(was_hit, np.uint8).copy() if was_hit else np.zeros(len(words), np.uint8)
                found = set(had or ())
                windows.scan(words, common.hash_words(words), hit, found)
                counts.append(len(words))
                marks.append(hit.tobytes() if found else None)
                items.append(sorted(found))
            return [counts, marks, items]

        return make

    return common.add_columns(docs, text, _STATE, start)


def spans(hit_words: bytes | None) -> list[tuple[int, int]]:
    """The runs of hit words, as (first, after the last)."""
    if not hit_words:
        return []
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + hit_words + b"\0", np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", mode: str = "spans", item: str = "item_id") -> DataFrame:
    """``docs`` without what the benchmark holds.

    ``mode="documents"`` leaves out each document with a hit; ``mode="spans"`` keeps all documents and takes the runs of
    hit words out of their texts, from the first byte of a run's first word to the last byte of its last one.
    """
    found = find_hits(docs.select(*[F.col(c).alias(f"_own{i}") for i, c in enumerate(docs.columns)]), benchmark, n, f"_own{docs.columns.index(text)}", item)
    own = [F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)]
    if mode == "documents":
        return found.where(F.col("hit_words").isNull()).select(*own)
    at = found.columns.index("hit_words")

    def start():
        def make(part: pa.RecordBatch, column: int) -> list:
            out = []
            for t, marks in zip(common.texts_of(part.column(column)), part.column(at).to_pylist(), strict=True):
                out.append(t.decode() if t is not None and not marks else None if t is None else cut(t, marks).decode())
            return [out]

        return make

    cleaned = common.add_columns(found, f"_own{docs.columns.index(text)}", [T.StructField("_clean", T.StringType())], start)
    return cleaned.select(*[F.col("_clean").alias(c) if c == text else o for c, o in zip(docs.columns, own, strict=True)])


def cut(text: bytes, marks: bytes) -> bytes:
    """``text`` without its runs of hit words."""
    import re

    places = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.translate(common.ALNUM))]
    kept, at = [], 0
    for a, b in spans(marks):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def sha256_of_items(items: list[int]) -> str:
    """The digest of the ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
