"""SimHash near duplicates: fingerprints of 64 bits that differ in ``MOST_BITS`` places or fewer link.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; shingles are ``words`` words in a row, repeats included, joined by
blanks (with fewer words, the whole sequence). A bit of the fingerprint is set if it is in over half of the shingles'
XXH64. Without words or text the fingerprint is zero, and links as any other.

1. Fingerprints come from one pass over the texts. Equal ones are one node from here on.
2. Embedding: a fingerprint is cut into 32 segments of two bits, and each becomes its count of set bits. The Manhattan
   distance of two such vectors is never more than the number of bits that differ. Counts are kept as 00, 01, 11, so a
   vector is one long, and a distance the set bits of an exclusive or.
3. Grid: the segments are cut into ``MOST_BITS + r`` runs. Vectors within Manhattan distance ``MOST_BITS`` have r runs at least
   at distance 0, so they are in one cell of one of the grids that each choice of r runs spans: that grid's cell is the counts of its
   runs. r is the least for which a cell of evenly spread fingerprints holds ``CROWD`` at most; any r gives the same links.
4. Range join: within a cell, fingerprints at Manhattan distance ``MOST_BITS`` or less are compared bit by bit. A search from
   fingerprint to fingerprint looks only at those not yet reached, and only the links it went by are returned, fewer than the cell
   has members, so a dense group makes no list of its pairs. A cell over ``CELL_MOST`` is dealt to blocks, and each pair of
   blocks is searched.
5. Links make components (``common.components``); their smallest id goes back to all rows by salted joins.

Texts are read whole. Repeated rows and copies have equal fingerprints. Ties don't matter to links. Null ids are in no
result as the smallest id; a component of null ids only has a null id. Other columns don't matter. A table without rows
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm import common

#: Bits that may differ, XXH64's seed, segments of a fingerprint (two bits each).
MOST_BITS, SEED, SEGMENTS = 4, 42, 32
#: Fingerprints that an average cell may hold, those searched at once, cells whose pairs are compared by shifts.
CROWD, CELL_MOST, FEW = 64, 1 << 16, 8
#: Shingles hashed at once.
AT_ONCE = 1 << 16
#: The first bit of each segment.
_FIRST = 0x5555555555555555


def fingerprint(text: bytes | None, words: int) -> int:
    """The fingerprint as a signed number."""
    own = common.blank_words(text)
    if not own:
        return 0
    flat = b" ".join(own)
    starts = np.cumsum([0, *(len(w) + 1 for w in own)])
    size = min(words, len(own))
    n = len(own) - size + 1
    first, last = starts[:n].tolist(), (starts[size : size + n] - 1).tolist()
    digest, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE], strict=True)), np.uint64)
        held += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * held > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` with ``node``, the fingerprint."""

    def start():
        return lambda part, at: [[fingerprint(t, words) for t in common.texts_of(part.column(at))]]

    return common.add_columns(docs, text, [T.StructField("node", T.LongType())], start)


# --- the embedding and its grids -----------------------------------------------------------------------------


def counts_of(node: Column) -> Column:
    """The segments' counts, 00, 01 or 11 in each segment."""
    high = F.shiftrightunsigned(node, 1)
    first = F.lit(_FIRST)
    return high.bitwiseOR(node).bitwiseAND(first).bitwiseOR(F.shiftleft(high.bitwiseAND(node).bitwiseAND(first), 1))


def counts_in(nodes: np.ndarray) -> np.ndarray:
    """``counts_of`` for an array of unsigned numbers."""
    high, first = nodes >> np.uint64(1), np.uint64(_FIRST)
    return ((high | nodes) & first) | ((high & nodes & first) << np.uint64(1))


def grids(n: int, most: int = MOST_BITS, crowd: int = CROWD) -> list[int]:
    """The bits that each grid's cells are made of (as signed numbers), for ``n`` fingerprints."""
    for same in range(1, SEGMENTS - most + 1):
        runs = most + same
        # two even bits have the same count in 3 of 8 cases
        if n * (3 / 8) ** (SEGMENTS * same / runs) <= crowd:
            break
    cuts = [2 * (SEGMENTS * k // runs) for k in range(runs + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [int(np.uint64(sum(chosen)).astype(np.int64)) for chosen in combinations(masks, same)]


def _links_in(batch: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """The links of the cells in column ``members``: all of small cells, those that join a component of others."""
    column = batch.column(0)
    offsets = column.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    nodes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    counts = counts_in(nodes)
    sizes = np.diff(offsets)
    cell = np.repeat(np.where(sizes <= FEW, np.arange(len(sizes)), -1), sizes)
    found_a, found_b = [], []
    for d in range(1, FEW):
        at = np.flatnonzero((cell[:-d] == cell[d:]) & (cell[d:] >= 0))
        at = at[np.bitwise_count(counts[at] ^ counts[at + d]) <= most]
        at = at[np.bitwise_count(nodes[at] ^ nodes[at + d]) <= most]
        found_a.append(nodes[at])
        found_b.append(nodes[at + d])
    for k in np.flatnonzero(sizes > FEW):
        own = slice(offsets[k], offsets[k + 1])
        for a, b in _searched(nodes[own], counts[own], most):
            found_a.append(np.full(len(b), a))
            found_b.append(b)
    a, b = (np.concatenate(x).view(np.int64) for x in (found_a, found_b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _searched(nodes: np.ndarray, counts: np.ndarray, most: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """A node and those first reached from it, for a search through all nodes of a cell."""
    left = np.arange(len(nodes))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        near = np.flatnonzero(np.bitwise_count(counts[left] ^ counts[at]) <= most)
        near = near[np.bitwise_count(nodes[left[near]] ^ nodes[at]) <= most]
        if len(near):
            todo.extend(left[near].tolist())
            yield nodes[at], nodes[left[near]]
            left = np.delete(left, near)


def links(nodes: DataFrame, n: int, most: int = MOST_BITS, crowd: int = CROWD, cell_most: int = CELL_MOST) -> DataFrame:
    """Links (``a``, ``b``) between the ``n`` distinct fingerprints of ``nodes`` that join all that can be reached from each other."""
    keys = F.array(*[F.struct(F.lit(g).alias("grid"), F.col("counts").bitwiseAND(F.lit(mask)).alias("cell")) for g, mask in enumerate(grids(n, most, crowd))])
    cells = nodes.select("node", counts_of(F.col("node")).alias("counts")).select("node", F.explode(keys).alias("k")).select("k.grid", "k.cell", "node")
    by = ["grid", "cell"]
    if n > cell_most:
        large = common.written(cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_most).select(*by, F.ceil(F.col("n") * 2 / cell_most).cast("int").alias("blocks")))
        if not large.isEmpty():
            own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
            other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
            dealt = cells.join(common.sized(large), by, "left").withColumn("x", F.coalesce(own, F.lit(0))).withColumn("y", other)
            cells = dealt.select(*by, F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"), "node")
            by = [*by, "low", "high"]
    met = cells.groupBy(*by).agg(F.collect_list("node").alias("members")).where(F.size("members") > 1).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _links_in(batch, most)

    return common.written(met.mapInArrow(run, "a long, b long"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, most: int = MOST_BITS, cell_most: int = CELL_MOST) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id of all documents reachable by links) of each row."""
    with common.passing(docs.sparkSession):
        own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
        rows = common.written(fingerprints(own, "text", words).select("id", "node"))
        nodes = common.written(rows.select("node").distinct())
        found = links(nodes, nodes.count(), most, cell_most=cell_most)
        labels = None if found.isEmpty() else common.components(found)
        done = common.component_ids(rows, labels)
        return common.written(done.select("id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"), keep=True)
