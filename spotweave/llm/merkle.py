"""Merkle manifest of a dataset: a tree of SHA-256 nodes for each source, one over the sources, and proofs of each row.

A row's leaf is H of its fields one after another, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value. H is
SHA-256 as lowercase hex, and a parent is H of its up to ``ARITY`` children's hex. Leaves of a source ascend by id (nulls first, then by leaf);
what remains of each source is its subroot, and the subroots by source (null first, bytewise) make the root.

* Places of the leaves within their sources come from range partitions (``places.placed``), so a source with a third of
  all rows is dealt to as many tasks as its rows need.
* ``HEIGHT`` levels are climbed at once: ``ARITY ** HEIGHT`` nodes in a row are one block, a group of bounded size, and the blocks'
  tops are the nodes of the next climb. Ten thousand million leaves take five climbs, each over 243 times fewer rows.
* Midstates: a parent keeps a copy of its hash state before each child's slot. To fold another leaf in, the state before
  the leaf's slot is resumed with the replacement and the siblings to its right only. Above a block, the states of
  the block's own ancestors are made once and resumed for each of its leaves.
* The way up from a block's top (siblings to the left and to the right, level by level) is handed down from climb to climb by a join
  on the block; a block is one row.

Rows that repeat are leaves of their own. A null id stands first in its source and is never tampered with. A table without
rows gives none. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spotweave.llm import common
from spotweave.operators import places

#: Children of a node, and levels that a block holds.
ARITY, HEIGHT = 3, 5
BLOCK = ARITY**HEIGHT

WAY = "lefts array<string>, rights array<string>"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


# --- a block: HEIGHT levels over neighbours of one tree ------------------------------------------------------


def levels_of(size: int) -> int:
    """Levels that a block has if its climb has ``size`` nodes of the tree: all that are left, HEIGHT at most."""
    levels = 0
    while size > 1 and levels < HEIGHT:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def climbed(nodes: list[str], levels: int) -> list[list[str]]:
    """The block's nodes at each level, from ``nodes`` up."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha(*below[k : k + ARITY]) for k in range(0, len(below), ARITY)])
    return out


class Midstates:
    """The hash states of a block's parents before each child's slot."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = climbed(nodes, levels)
        self.states: list[list] = []
        for below in self.levels[:-1]:
            states = []
            for k, child in enumerate(below):
                state = states[-1].copy() if k % ARITY else hashlib.sha256()
                if k % ARITY:
                    state.update(below[k - 1].encode())
                states.append(state)
            self.states.append(states)

    def fold(self, at: int, value: str) -> str:
        """The block's top with ``value`` in place ``at``."""
        for below, states in zip(self.levels[:-1], self.states, strict=True):
            value = resumed(states[at], value, "".join(below[at + 1 : at - at % ARITY + ARITY]))
            at //= ARITY
        return value

    def way(self, at: int) -> tuple[list[str], list[str]]:
        """The siblings to the left and to the right of place ``at``, level by level."""
        lefts, rights = [], []
        for below in self.levels[:-1]:
            first = at - at % ARITY
            lefts.append("".join(below[first:at]))
            rights.append("".join(below[at + 1 : first + ARITY]))
            at //= ARITY
        return lefts, rights


def resumed(state, value: str, right: str) -> str:
    """The parent whose state before a slot is ``state``, with ``value`` in the slot and ``right`` after it."""
    state = state.copy()
    state.update(value.encode())
    state.update(right.encode())
    return state.hexdigest()


# --- climbs and ways in Spark --------------------------------------------------------------------------------


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes (``tree``, ``place``, ``size``, ``digest``) in blocks: a row for each, its items by place."""
    items = F.array_sort(F.collect_list(F.struct("place", "digest", *more))).alias("items")
    return common.written(nodes.groupBy("tree", "size", F.expr(f"place div {BLOCK}").alias("block")).agg(items))


def climb(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each climb, and the top (``tree``, ``digest``) of each tree."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, items = batch.column("size").to_pylist(), batch.column("items")
            top = [climbed([x["digest"] for x in own.as_py()], levels_of(n))[-1][0] for n, own in zip(sizes, items, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("size"), batch.column("block"), pa.array(top, pa.string())], names=["tree", "size", "place", "digest"])

    climbs, found = [], []
    while True:
        climbs.append(_blocks(nodes, *(more if not climbs else ())))
        up = common.written(climbs[-1].select("tree", "size", "block", F.transform("items", lambda x: F.struct(x["digest"].alias("digest"))).alias("items")).mapInArrow(tops, "tree long, size long, place long, digest string"))
        found.append(up.where(F.col("size") <= BLOCK).select("tree", "digest"))
        nodes = up.where(F.col("size") > BLOCK).withColumn("size", F.expr(f"(size + {BLOCK - 1}) div {BLOCK}"))
        if nodes.isEmpty():
            return climbs, common.written(_all(found))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def ways_of_nodes(blocks: DataFrame) -> DataFrame:
    """``tree``, ``place`` and the way of each node of the blocks, which have the ways from their tops."""
    schema = to_arrow_schema(blocks.select("tree", F.lit(0).cast("long").alias("place"), "lefts", "rights").schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block = Midstates([x["digest"] for x in r["items"]], levels_of(r["size"]))
                for k, x in enumerate(r["items"]):
                    lefts, rights = block.way(k)
                    rows.append({"tree": r["tree"], "place": x["place"], "lefts": lefts + r["lefts"], "rights": rights + r["rights"]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return common.written(blocks.mapInArrow(each, f"tree long, place long, {WAY}"))


def ways_down(climbs: list[DataFrame], ways: DataFrame) -> DataFrame:
    """The blocks of the first climb with the way from each block's top: ``ways`` has that of each tree's top (``tree``)."""
    above = None
    for blocks in reversed(climbs):
        found = blocks.where(F.col("size") <= BLOCK).join(ways, "tree")
        if above is not None:
            found = found.unionByName(blocks.where(F.col("size") > BLOCK).join(above.withColumnRenamed("place", "block"), ["tree", "block"]))
        if blocks is not climbs[0]:
            above = ways_of_nodes(found)
    return found


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """A row for each of ``docs``: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (H of the siblings on the way to the root), and
    ``folded_root`` with ``verified``.

    ``folded_root`` is made from the leaf of the row as it is at hand and the siblings as the manifest has them. ``changed``
    says what fields at hand are not as they were, for the rows ``where`` is true.
    """
    own = [F.col(f) for f in fields]
    now = leaf_of(*[(changed or {}).get(f, F.col(f)) for f in fields])
    at_hand = F.when(F.coalesce(where if where is not None else F.lit(bool(changed)), F.lit(False)), now)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), leaf_of(*own).alias("digest"), at_hand.alias("fake"))
    common.small_batches(docs.sparkSession)
    with common.passing(docs.sparkSession):
        leaves = places.placed(common.written(rows), ["source"], ["id", "digest"])  # ranges are sampled from it, not from the texts
        sources = common.written(places.placed(leaves.select("source").distinct(), [], ["source"]).select("source", F.col("_place").alias("tree"), F.col("_size").alias("count")))
        numbered = leaves.join(common.sized(sources).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        nodes = numbered.select("tree", F.col("_place").alias("place"), F.col("_size").alias("size"), "digest", "fake", "id")
        climbs, subroots = climb(nodes, "fake", "id")
        upper = subroots.join(sources, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("count").alias("size"), "digest")
        upper_climbs, roots = climb(upper)
        one = roots.first()  # the root, or no row
        root = F.lit(one["digest"] if one else None).cast("string")
        none = F.array().cast("array<string>")
        ways = ways_of_nodes(ways_down(upper_climbs, roots.select("tree", none.alias("lefts"), none.alias("rights"))))
        ways = ways.select(F.col("place").alias("tree"), "lefts", "rights")
        known = subroots.select("tree", F.col("digest").alias("subroot"), root.alias("root"))
        blocks = ways_down(climbs, ways).join(common.sized(common.written(known)), "tree")
        return common.written(_proofs(blocks, docs.schema[doc_id].dataType.simpleString()), keep=True)


def _proofs(blocks: DataFrame, kind: str) -> DataFrame:
    """The rows of the blocks' leaves."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            rest = batch.drop_columns(["items"]).to_pylist()
            for k, r in enumerate(rest):
                own = items[k].values
                leaves, fakes = own.field("digest").to_pylist(), own.field("fake").to_pylist()
                block = Midstates(leaves, levels_of(r["size"]))
                above = [hashlib.sha256(left.encode()) for left in r["lefts"]]
                siblings = "".join(a + b for a, b in zip(r["lefts"], r["rights"], strict=True)).encode()
                proofs, roots = [], []
                for at, (leaf, fake) in enumerate(zip(leaves, fakes, strict=True)):
                    lefts, rights = block.way(at)
                    proof = hashlib.sha256("".join(a + b for a, b in zip(lefts, rights, strict=True)).encode())
                    proof.update(siblings)
                    proofs.append(proof.hexdigest())
                    value = block.fold(at, leaf if fake is None else fake)
                    for state, right in zip(above, r["rights"], strict=True):
                        value = resumed(state, value, right)
                    roots.append(value)
                n = len(leaves)
                columns = [own.field("id"), pa.array(leaves, pa.string()), pa.array([r["subroot"]] * n, pa.string()), pa.array([r["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array([x == r["root"] for x in roots], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(each, out)
