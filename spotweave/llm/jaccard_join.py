"""N-gram Jaccard join with adaptive multi-match prefixes, and the components that its links make.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A document's set holds its distinct shingles of ``words``
words; with fewer words, the whole sequence as one shingle. Two documents link where the Jaccard similarity of their
sets is ``num / den`` or more. Sets are compared as 64-bit hashes of shingles.

1. One pass over the texts: an id (``node``) for each set, and counts of all shingles in ``BUCKETS`` hash buckets. Equal
   sets are one node from here on, so a group of copies costs as much as one document.
2. The order of shingles is by bucket count, then hash: rare ones first. Any partner of a document shares a shingle of
   its shortest prefix, and ``l`` shingles of a prefix longer by ``l - 1``. The shortest prefixes are listed by shingle, with what each
   document has left after it; shingles on one list only go.
3. Each document's own ``l`` is the cheapest by the lengths of its lists: a shingle more is carried for each match, and the
   candidates that reach ``l`` matches, at most those it meets over ``l``, cost a verification each. It is no more than any partner must share.
4. Two documents of a list are candidates if this can be the first shingle that they share: then they share no
   more than it and what either has left. A near copy with too many shingles of its own before thus meets nobody on the
   long lists of its group. Of each set, the parities of its shingles in ``PARITIES`` buckets are known; candidates of which
   too many differ can't be similar enough. The others must share the smaller ``l`` of the two in the prefixes that
   long, and those that do are verified on the whole sets.
5. Star rounds over lists of ``LONG_LIST`` documents or more: all meet one member (the first round takes the one with the
   most left after it). Those that link are one component, and no pair inside a component is looked at again. A
   group of near copies thus costs a few times its size. Rounds end when they link little. They only save work: what
   they don't link, the next step looks at.
6. The rest: all candidates of a list with different components.

Texts are read whole. Documents without words or text have empty sets and link with nothing. Repeated rows and copies
have equal sets and link. Ties don't matter to links. Null ids are in no result as the smallest id; a component of null
ids only has a null id. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spotweave.llm import common

#: Hash buckets that shingles are counted in; the largest number of matches that a prefix is lengthened for.
BUCKETS, MOST_MATCHES = 1 << 17, 12
#: Buckets whose parities are kept of each set.
PARITIES = 1024
#: Numbers of 64 parities that the parities are folded to where a row is carried for each list.
FOLDED = 4
#: What a verification costs, in shingles carried. Documents on a list for star rounds, rounds at most, and the share of
#: the best round's links that a round must make for another one.
VERIFY_COST, LONG_LIST, STARS, LINKING = 16.0, 8, 6, 0.2
SALTS = 64


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    own = common.blank_words(text)
    if not own:
        return np.empty(0, np.uint64)
    found = np.sort(common.windows(common.hash_words(own), min(words, len(own))))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def _node(found: np.ndarray, seed: int) -> tuple[int | None, int | None]:
    """Two 64-bit ids of a set, as signed numbers."""
    if not len(found):
        return None, None
    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes(), seed), np.int64)
    return int(both[0]), int(both[1])


def scan(docs: DataFrame, doc_id: str, text: str, words: int, seed: int) -> DataFrame:
    """A row (``id``, ``n``, ``node``, ``twin``) for each document, and rows (``bucket``, ``shingles``) with counts for each task."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("twin", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("shingles", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(batch, 1):
                sets = [shingle_set(t, words) for t in common.texts_of(part.column(1))]
                total += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                nodes, twins = zip(*(_node(s, seed) for s in sets), strict=True)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], kinds[1]), pa.array(nodes, kinds[2]), pa.array(twins, kinds[3]), none.cast(kinds[4]), none.cast(kinds[5])], names=schema.names)
        at = np.flatnonzero(total)
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays([*(none.cast(k) for k in kinds[:4]), pa.array(at, kinds[4]), pa.array(total[at], kinds[5])], names=schema.names)

    return common.written(docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema))


def bucket_counts(scanned: DataFrame) -> np.ndarray:
    """The shingles of all documents in each bucket."""
    found = scanned.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("shingles").alias("shingles")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["shingles"].to_numpy()
    return out


def shortest_prefix(n: int, num: int, den: int) -> int:
    """Shingles of a set of ``n``, one of which any partner must have."""
    return n - (-(-num * n // den)) + 1


def longest_prefix(found: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix for MOST_MATCHES, rarest first."""
    seen = counts[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
    return found[np.lexsort((found, seen))[: shortest_prefix(len(found), num, den) + MOST_MATCHES - 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """For each of PARITIES buckets whether it holds an odd number of the shingles, 64 to a number."""
    held = np.bincount((found >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES)
    return np.packbits((held & 1).astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, text: str, words: int, seed: int, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """``node``, ``n``, ``prefix`` and ``bits`` (the parities) of each set with shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 0):
                rows: dict[int, tuple] = {}
                for t in common.texts_of(part.column(0)):
                    found = shingle_set(t, words)
                    node, _ = _node(found, seed)
                    if node is not None and node not in rows:
                        rows[node] = (len(found), longest_prefix(found, shared.value, num, den).view(np.int64), parities(found))
                firsts = [r[1] for r in rows.values()]
                offsets = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*firsts, np.empty(0, np.int64)]), pa.int64()))
                ends = np.arange(len(rows) + 1, dtype=np.int32) * (PARITIES // 64)
                bits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*(r[2] for r in rows.values()), np.empty(0, np.int64)]), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([r[0] for r in rows.values()], pa.int32()), lists, bits], names=["node", "n", "prefix", "bits"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "node long, n int, prefix array<long>, bits array<long>")
    return common.written(found.dropDuplicates(["node"]))


def _shortest(n: str, num: int, den: int) -> Column:
    """``shortest_prefix`` of a column."""
    return F.expr(f"cast({n} - ({num}L * {n} + {den - 1}) div {den} + 1 as int)")


def listed(firsts: DataFrame, num: int, den: int) -> DataFrame:
    """``token``, ``node``, ``n``, ``after`` (shingles of the set after this one) and ``lists`` (nodes on the list) of the
    shingles that are in the shortest prefixes of several nodes."""
    each = firsts.select("node", "n", F.posexplode(F.slice("prefix", F.lit(1), _shortest("n", num, den))).alias("at", "token"))
    shared = common.written(each.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("lists")).where("lists > 1"))
    return common.written(each.join(shared, "token").select("token", "node", "n", (F.col("n") - F.col("at") - 1).alias("after"), "lists"))


def cheapest(lists: DataFrame, ends: DataFrame, num: int, den: int) -> DataFrame:
    """``node`` and the ``matches`` that are asked of those in ``ends``: l + VERIFY_COST * met / l is smallest at the root. No more
    than a partner must share: a short set has no more to match."""
    met = lists.join(common.sized(ends), "node", "left_semi").groupBy("node", "n").agg(F.sum(F.col("lists") - 1).alias("met"))
    must = F.col("n") - _shortest("n", num, den) + 1
    best = F.greatest(F.lit(1), F.round(F.sqrt(VERIFY_COST * F.col("met"))))
    return common.written(met.select("node", F.least(F.lit(MOST_MATCHES), must, best).cast("int").alias("matches")))


def _fits(x: str, y: str, num: int, den: int) -> str:
    """Whether a shingle may be the first that two members of a list share, in SQL: what they share at most, if it
    is, against what they must."""
    return f"{num + den}L * (1 + least({x}after, {y}after)) >= {num}L * ({x}n + {y}n)"


def _ends(pairs: DataFrame) -> DataFrame:
    return common.written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())


def alike(pairs: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may be similar enough by their parities."""
    known = common.written(firsts.join(common.sized(_ends(pairs)), "node", "left_semi").select("node", F.struct("n", "bits").alias("own")))
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return common.written(both.where(_alike("x.", "y.", num, den)).select("a", "b"))


def matched(pairs: DataFrame, firsts: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that share as many shingles of their lengthened prefixes as is asked of both."""
    ends = _ends(pairs)
    known = common.written(firsts.join(common.sized(ends), "node", "left_semi").join(cheapest(lists, ends, num, den), "node").select("node", F.struct("n", "prefix", "matches").alias("own")))
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    both = both.withColumn("least", F.least("x.matches", "y.matches"))
    cut = [F.slice(f"{side}.prefix", F.lit(1), _shortest(f"{side}.n", num, den) + F.col("least") - 1) for side in "xy"]
    return common.written(both.where(F.size(F.array_intersect(*cut)) >= F.col("least")).select("a", "b"))


def sets_of(docs: DataFrame, named: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int, seed: int) -> DataFrame:
    """``node`` and ``hashes`` (8 bytes each) of the sets in ``nodes`` (and of others of their ids), from the document that ``named`` has for each."""
    ids = common.written(named.join(common.sized(nodes), "node", "left_semi").select("id"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).alias("d")
    picked = own.join(common.sized(ids).alias("i"), F.col("d.id").eqNullSafe(F.col("i.id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 0):
                rows = {}
                for t in common.texts_of(part.column(0)):
                    found = shingle_set(t, words)
                    rows[_node(found, seed)[0]] = found.tobytes()
                rows.pop(None, None)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["node", "hashes"])

    return common.written(picked.select("text").mapInArrow(run, "node long, hashes binary"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if den * len(x) < num * len(y):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int(np.count_nonzero(y[at] == x))
                keep.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.written(both.mapInArrow(run, "a long, b long").distinct())  # an id on several texts gives a set several times


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``lists`` with the component of each node so far."""
    if labels is None:
        return common.written(lists.withColumn("label", F.col("node")))
    known = labels.select("node", F.col("label").alias("_label"))
    return common.written(lists.join(known, "node", "left").withColumn("label", F.coalesce("_label", "node")).drop("_label"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _star(lists: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Members of each list with its centre, where their components differ and they may be partners."""
    order = -F.col("after") / F.col("n") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
    centre = F.min(F.struct(order.alias("order"), "node", "n", "after", "label")).alias("c")
    centres = lists.groupBy("token").agg(centre, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token", "c")
    near = lists.join(common.written(centres), "token").where(f"label <> c.label and {_fits('', 'c.', num, den)}")
    return common.written(near.select(*_pair(F.col("node"), F.col("c.node"))).distinct())


def _apart(x: str, y: str) -> str:
    """In SQL, the buckets whose parities differ."""
    return f"aggregate(zip_with({x}bits, {y}bits, (u, v) -> bit_count(u ^ v)), 0, (s, c) -> s + c)"


def _alike(x: str, y: str, num: int, den: int) -> str:
    """Whether two sets may be similar enough by their parities, in SQL: each bucket that differs holds a shingle of one set only."""
    return f"{num + den}L * ({x}n + {y}n - {_apart(x, y)}) >= {2 * num}L * ({x}n + {y}n)"


def _rest(lists: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of different components that may be partners, also by their parities.

    Short lists are gathered; in a long list, members of the largest component meet the others only. Only lists of several
    components get the parities, folded to FOLDED numbers, and only pairs that pass by them leave the join.
    """
    columns = ["node", "n", "label", "after", "bits"]
    fold = F.expr("array(" + ", ".join(" ^ ".join(f"bits[{at}]" for at in range(k, PARITIES // 64, FOLDED)) for k in range(FOLDED)) + ")")
    mixed = common.written(lists.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("token"))
    held = common.written(lists.join(mixed, "token", "left_semi").join(firsts.select("node", fold.alias("bits")), "node"))
    fits = f"x.label <> y.label and {_fits('x.', 'y.', num, den)} and {_alike('x.', 'y.', num, den)}"
    short = held.where(F.col("lists") < LONG_LIST).groupBy("token").agg(F.collect_list(F.struct(*columns)).alias("all"))
    inside = F.expr(f"flatten(transform(all, x -> transform(filter(all, y -> x.node < y.node and {fits}), y -> struct(x.node as a, y.node as b))))")
    short = short.select(F.explode(inside).alias("p")).select("p.a", "p.b")
    long = held.where(F.col("lists") >= LONG_LIST)
    mains = long.groupBy("token", "label").agg(F.count(F.lit(1)).alias("members")).groupBy("token").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
    x = common.written(long.join(common.written(mains), "token").where("label <> main").select("token", "main", F.struct(*columns).alias("x")))
    y = long.select("token", F.struct(*columns).alias("y"))
    met = x.join(y, "token").where(f"{fits} and (y.label = main or x.node < y.node)")
    return common.written(short.unionByName(met.select(*_pair(F.col("x.node"), F.col("y.node")))).distinct())


def links(docs: DataFrame, scanned: DataFrame, named: DataFrame, doc_id: str, text: str, words: int, seed: int, num: int, den: int) -> DataFrame | None:
    """``node`` and ``label`` of the nodes that link with another one; None if there are none."""
    firsts = prefixes(docs, text, words, seed, bucket_counts(scanned), num, den)
    lists = listed(firsts, num, den)
    long = common.written(lists.where(F.col("lists") >= LONG_LIST))
    labels: DataFrame | None = None

    def verify(pairs: DataFrame) -> int:
        """Add the links among ``pairs``; how many there are."""
        nonlocal labels
        if pairs.isEmpty():
            return 0
        pairs = matched(pairs, firsts, lists, num, den)
        if pairs.isEmpty():
            return 0
        more = verified(pairs, sets_of(docs, named, _ends(pairs), doc_id, text, words, seed), num, den)
        labels = common.more_links(labels, more)
        return more.count()

    most = 0
    for turn in range(0 if long.isEmpty() else STARS):
        linked = verify(alike(_star(_labelled(long, labels), turn, num, den), firsts, num, den))
        if linked <= LINKING * most:
            break
        most = max(most, linked)
    verify(alike(_rest(_labelled(lists, labels), firsts, num, den), firsts, num, den))
    return labels


def _groups(docs: DataFrame, doc_id: str, text: str, words: int, num: int, den: int) -> tuple[DataFrame, int]:
    """``id``, ``n``, ``node`` (null for an empty set), ``label`` (of the component) and ``component_id`` of each row, and the
    seed of the nodes."""
    spark = docs.sparkSession
    common.small_batches(spark)
    with common.passing(spark):
        for seed in range(4):
            scanned = scan(docs, doc_id, text, words, seed)
            rows = scanned.where(F.col("bucket").isNull())
            named = common.written(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.min("twin").alias("low"), F.max("twin").alias("high")))
            if named.where("low <> high").isEmpty():
                break
        else:
            raise RuntimeError("different sets share a 64-bit id under four seeds")
        labels = links(docs, scanned, named, doc_id, text, words, seed, num, den)
        out = common.component_ids(rows.select("id", "n", "node"), labels, SALTS)
        return common.written(out.select("id", "n", "node", "label", "component_id"), keep=True), seed


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (the smallest id of all documents reachable by links) of each row."""
    return _groups(docs, doc_id, text, words, num, den)[0].select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows without an id, and rows with empty
    sets, stay. Of rows that repeat an id, those of a group that has a smaller one go, and one stays of those that are alike."""
    groups, seed = _groups(docs, doc_id, text, words, num, den)
    known = groups.where(F.col("id").isNotNull())
    repeated = common.written(known.groupBy("id").count().where("count > 1").select(F.col("id").alias(doc_id)))
    gone = common.written(known.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(doc_id)).distinct())
    if repeated.isEmpty():
        return docs.join(common.sized(gone), doc_id, "left_anti").select(*docs.columns)
    # an id on several texts: each row by its set
    once = docs.join(common.sized(repeated), doc_id, "left_anti").join(common.sized(gone), doc_id, "left_anti").select(*docs.columns)
    names = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    several = docs.join(common.sized(repeated), doc_id, "left_semi").select(*[F.col(c).alias(x) for c, x in names.items()])

    def start():
        return lambda part, at: [[_node(shingle_set(t, words), seed)[0] for t in common.texts_of(part.column(at))]]

    several = common.add_columns(several.withColumn("_text", F.col(names[text]).cast("string")), "_text", [T.StructField("_node", T.LongType())], start)
    firsts = known.where(F.col("node").isNotNull() & (F.col("id") == F.col("component_id"))).select(F.col("id").alias(names[doc_id]), F.col("node").alias("_node"), F.col("label").alias("_label")).distinct()
    stay = several.where(F.col("_node").isNotNull()).join(firsts, [names[doc_id], "_node"]).groupBy(names[doc_id], "_label")
    one = stay.agg(F.min_by(F.struct(*names.values()), F.xxhash64("_text")).alias("_row")).select("_row.*")
    kept = one.unionByName(several.where(F.col("_node").isNull()).select(*names.values()))
    return once.unionByName(kept.select(*[F.col(x).alias(c) for c, x in names.items()]))
