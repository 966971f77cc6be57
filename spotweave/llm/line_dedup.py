"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and are removed everywhere.

1. One HyperLogLog sketch of sites for each line hash. Sketches merge in the aggregation, before and after the
   exchange, so a line that stands in a third of all rows sends one sketch from each task.
2. Lines whose estimate is clearly above the threshold are boilerplate. Those within ``BAND`` of it get an exact
   distinct count of their sites, so the sketches' error changes no decision.
3. For each text that holds such lines, a set of their hashes is joined back, and the lines are taken out. The set is
   keyed by the text's hash: copies share it. It is a written table, so Spark can send it to all tasks where it is
   small, and can split a hot text's rows where it is not.

With ``copies_apart`` a line that is on many sites only because a document was copied there stays, and the copies are
left to a later stage. Among the lines of step 2 each differing text counts for one of its sites, picked by hash, and
only texts that keep ``OWN`` of their characters count: of a group of near copies on many sites nearly all lines are
on many sites, while a page with boilerplate has lines of its own.

Lines are what ``\\n`` separates; equal lines are equal byte for byte. All hashes have 128 bits. Empty lines are never
boilerplate and stay. A null site is no site; a null text stays null and has no lines; a text that loses all its lines
becomes empty, and its row stays. Repeated rows count as one site and are all cleaned. A table without rows gives none.
Columns of the input that are named like a result (``n_lines``, ``n_removed``) are replaced; all others pass through. No Python runs on rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm import common

#: Sites from which a line is boilerplate; log2 of a sketch's registers; share of the threshold that counts as near it.
MIN_SITES, LG_K, BAND = 10, 12, 0.1
#: Share of the characters of a text's differing lines that must be on lines on fewer sites, where copies are told apart.
OWN = 0.5


def _hash(x: Column) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit(7), x)]


def _pair(x: Column, name: str) -> Column:
    a, b = _hash(x)
    return F.struct(a.alias("a"), b.alias("b")).alias(name)


def line_hashes(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """``columns`` and the hash of the line (``a``, ``b``), for each line that isn't empty."""
    lines = docs.select(*columns, F.explode(F.split(text, "\n", -1)).alias("_line")).where("_line <> ''")
    names = [c for c in lines.columns if c != "_line"]
    a, b = _hash(F.col("_line"))
    return lines.select(*names, a.alias("a"), b.alias("b"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes (``a``, ``b``) of the lines that stand on ``min_sites`` distinct sites or more."""
    lines = line_hashes(docs.where(F.col(site).isNotNull() & F.col(text).isNotNull()), text, F.col(site).cast("string").alias("site"))
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    low, high = math.floor(min_sites * (1 - BAND)), math.ceil(min_sites * (1 + BAND)) + 1
    spread = common.written(sketches.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    near = spread.where(F.col("sites") < high).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return common.written(spread.where(F.col("sites") >= high).select("a", "b").unionByName(exact.select("a", "b")))


def without_copies(docs: DataFrame, lines: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Those of ``lines`` (``a``, ``b``) that stand on ``min_sites`` sites or more by one site of each text with enough lines of its own."""
    known = docs.where(F.col(site).isNotNull() & F.col(text).isNotNull()).select(F.col(site).cast("string").alias("site"), _pair(F.col(text), "key"), F.array_distinct(F.split(text, "\n", -1)).alias("parts"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    each = known.select("site", "key", size.alias("size"), F.explode("parts").alias("_line")).where("_line <> ''")
    a, b = _hash(F.col("_line"))
    at = each.select("site", "key", "size", F.length("_line").alias("own"), a.alias("a"), b.alias("b")).join(lines, ["a", "b"], "left_semi")
    picked = F.min(F.struct(F.xxhash64("site", "key"), "site"))
    of_text = common.written(at.groupBy("key", "a", "b").agg(picked["site"].alias("site"), F.first("own").alias("own"), F.first("size").alias("size")))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("a", "b")

    taken = of_text.join(common.written(spread(of_text)), ["a", "b"], "left_semi").groupBy("key").agg(F.sum("own").alias("taken"), F.first("size").alias("size"))
    hosts = common.written(taken.where(F.col("size") - F.col("taken") >= OWN * F.col("size")).select("key"))
    return common.written(spread(of_text.join(hosts, "key", "left_semi")))


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, copies_apart: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` (not empty) and ``n_removed``."""
    lines = boilerplate(docs, text, site, min_sites)
    if copies_apart:
        lines = without_copies(docs, lines, text, site, min_sites)
    hits = line_hashes(docs.where(F.col(text).isNotNull()), text, _pair(F.col(text), "key")).join(lines, ["a", "b"], "left_semi")
    of_text = common.written(hits.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("bad")).select(F.col("key.a").alias("_ka"), F.col("key.b").alias("_kb"), F.col("bad").alias("_bad")))

    kept = common.drop_clashing(docs, ["n_lines", "n_removed"]).columns
    ka, kb = _hash(F.coalesce(F.col(text), F.lit("")))
    others = [F.col(c) for c in kept if c != text] or [F.lit(None).alias("none")]
    joined = docs.select(F.struct(*others).alias("_own"), F.col(text).alias("_text"), ka.alias("_ka"), kb.alias("_kb")).join(of_text, ["_ka", "_kb"], "left")
    parts = F.split("_text", "\n", -1)
    clean = F.filter(parts, lambda line: ~F.array_contains("_bad", F.struct(*[h.alias(n) for h, n in zip(_hash(line), "ab", strict=True)])))
    n_lines = F.coalesce(F.size(F.filter(parts, lambda line: line != "")), F.lit(0))
    hit = F.col("_bad").isNotNull() & F.col("_text").isNotNull()
    n_removed = F.when(hit, F.size(parts) - F.size(clean)).otherwise(F.lit(0))
    cleaned = F.when(hit, F.array_join(clean, "\n")).otherwise(F.col("_text"))
    n_lines = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(n_lines)
    made = joined.select(F.col("_own").alias("o"), F.struct(cleaned.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed")).alias("m"))
    return made.select(*[F.col("m")["text"].alias(c) if c == text else F.col("o")[c].alias(c) for c in kept], F.col("m")["n_lines"].alias("n_lines"), F.col("m")["n_removed"].alias("n_removed"))
