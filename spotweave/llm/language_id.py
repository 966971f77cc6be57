"""Language identification by nearest centroid.

A text is lower-cased, all that is no letter becomes a blank, and the byte n-grams (``ORDERS``) of what is left are
hashed to ``BUCKETS`` counts. Counts are damped (log), weighted by inverse document frequency and normalised, and the
vector is compared by cosine with several centroids of each language, found by spherical k-means over a sample of
labelled rows. The nearest centroid gives the language and the cosine the score. A text is rejected where the distance
to it is larger than that centroid's radius: what ``SLACK`` leaves of the cosine that all but ``LOW`` of the sample's
texts of about the same length reach, of those that fell to the centroid if they are ``FEW`` or more, else of those of
its language; where these are fewer too, the radius is wider.

Bounds: ``PER_LANGUAGE`` texts of each language, those with the smallest hashes, make the centroids;
document frequencies come from all labelled rows that may be learnt from. The model has one float for each bucket and
centroid.

Null texts and texts without a letter get ``und`` with score 0 and are rejected. Rows without a language teach nothing.
Repeated rows get equal results. Ties go to the language and centroid that sort first. A text of any length is read
whole. Without labelled rows every text gets ``und``. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm import common

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 13
#: Texts whose vectors a worker holds at once.
AT_ONCE = 100
#: Labelled rows of a language that make its centroids, centroids of a language, rounds of k-means.
PER_LANGUAGE, CENTROIDS, ROUNDS = 800, 4, 12
#: Share of a radius' cosine that a text may fall to, and upper ends of the length classes (n-grams of the first order).
SLACK, LENGTHS = 0.85, (32, 128, 512, 2048)
#: Share of the sample's texts that may be farther away, texts that a radius of its own needs, and what is left of the
#: cosine of a class with fewer texts, or of the next longer one's for a class without texts: shorter texts are farther away.
LOW, FEW, SHORTER = 0.01, 20, 0.5
UNKNOWN = "und"

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("has_letter", T.BooleanType())]

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def letters(text: str) -> bytes:
    """The text in lower case, with one blank for each run of other than letters, and one at each end."""
    low = text.lower()
    data = low.encode("utf-8", "replace")
    if len(data) == len(low):  # ASCII: a table does
        return b" " + b" ".join(data.translate(_ASCII).split()) + b" "
    return b" " + _OTHER.sub(" ", low).strip().encode("utf-8", "replace") + b" "


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without a letter."""
    if not text or not _LETTER.search(text):
        return None
    data = np.frombuffer(letters(text), np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    key = np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(data) - order + 1
        if n <= 0:
            break
        key = key[:n] * np.uint32(257) + data[order - 1 :]
        if order in ORDERS:
            total += np.bincount((key * _FACTORS[order - 1] ^ (key >> np.uint32(15)) * _FACTORS[-1]) >> shift, minlength=BUCKETS)
    return total


def vector(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = (np.log1p(total) * idf).astype(np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-12)


def length_class(total: np.ndarray) -> int:
    return int(np.searchsorted(LENGTHS, total.sum() / len(ORDERS)))


def by_length(known: list[float | None]) -> list[float]:
    """The cosine of each length class from those of the classes that have texts: no class is held to more than a longer one."""
    last = next((x for x in reversed(known) if x is not None), 0.0)  # classes longer than all texts
    out, longer = [], False
    for x in reversed(known):
        if x is not None:
            last, longer = min(last, x), True
        elif longer:
            last *= SHORTER
        out.append(last)
    return out[::-1]


def document_frequency(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket the documents of ``labelled`` (column ``text``) that hold it, and all documents with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in common.slices(batch, 0):
                for c in map(counts, part.column(0).to_pylist()):
                    if c is not None:
                        total += c > 0
                        n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "docs"])

    out, n = np.zeros(BUCKETS, np.int64), 0
    for bucket, docs in labelled.select("text").mapInArrow(run, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs")).collect():  # BUCKETS rows
        if bucket < 0:
            n = docs
        else:
            out[bucket] = docs
    return out, n


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, text) with the text's counts instead: BUCKETS numbers at most, however long it is; none without a letter."""
    for batch in batches:
        for part in common.slices(batch, 2):
            at, n = [], []  # never the dense counts of all texts
            for c in map(counts, part.column(2).to_pylist()):
                at.append(np.empty(0, np.int32) if c is None else np.flatnonzero(c).astype(np.int32))
                n.append(np.empty(0, np.int64) if c is None else c[at[-1]])
            lists = [pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["lang", "order", "buckets", "n"])


def _dense(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    out[at] = n
    return out


def _cluster(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by spherical k-means from spread-out starts, and the centroid of each row."""
    k = min(CENTROIDS, len(vectors))
    centres = [vectors.mean(0)]
    for _ in range(1, k):
        near = np.max(vectors @ np.array(centres).T, axis=1)
        centres.append(vectors[int(np.argmin(near))])
    centres = np.array(centres)
    own = np.zeros(len(vectors), int)
    for _ in range(ROUNDS):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([vectors[own == j].mean(0) if np.any(own == j) else centres[j] for j in range(k)])
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, np.argmax(vectors @ centres.T, axis=1)


class Model:
    """Centroids of all languages with their radii, and the weights of the buckets."""

    def __init__(self, names: list[str], centroids: np.ndarray, radii: np.ndarray, idf: np.ndarray):
        self.names, self.centroids, self.radii, self.idf = names, centroids, radii, idf

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, bool]]:
        return [x for k in range(0, len(texts), AT_ONCE) for x in self._predict(texts[k : k + AT_ONCE])]

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, bool]]:
        found = [counts(t) for t in texts]
        out = [(UNKNOWN, 0.0, True, False)] * len(texts)
        rows = [i for i, c in enumerate(found) if c is not None]
        if rows and not self.names:
            return [(UNKNOWN, 0.0, True, c is not None) for c in found]
        if rows:
            near = np.array([vector(found[i], self.idf) for i in rows]) @ self.centroids.T
            for i, cosines in zip(rows, near, strict=True):
                j = int(np.argmax(cosines))
                score = float(np.clip(cosines[j], 0.0, 1.0))
                out[i] = (self.names[j], score, score < self.radii[j, length_class(found[i])], True)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model from all rows of ``docs`` with a language; leave held-out rows out before."""
    common.small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text)).alias("order"))
    df, n = document_frequency(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    # about twice PER_LANGUAGE texts of a language pass the hash, a text once, and only they are dealt by language
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("order", 0.02).alias("rows"))
    share = F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = labelled.join(F.broadcast(sizes), "lang").where(share * F.col("rows") <= 2.0 * PER_LANGUAGE)  # one row for each language
    grams = few.select("lang", "order", "text").mapInArrow(_sparse, "lang string, order long, buckets array<int>, n array<long>").dropDuplicates(["lang", "order"])
    sample = grams.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order"))).where((F.col("rank") <= PER_LANGUAGE) & (F.size("n") > 0)).select("lang", "buckets", "n")

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"lang": [], "at": [], "centroid": [], "radii": []})
        vectors, classes = np.empty((len(part), BUCKETS), np.float32), np.empty(len(part), int)
        for i, (at, n) in enumerate(zip(part["buckets"], part["n"], strict=True)):
            total = _dense(at, n)
            vectors[i], classes[i] = vector(total, idf), length_class(total)
        centres, own = _cluster(vectors)
        cosines = np.einsum("ij,ij->i", vectors, centres[own])
        radii = []
        for j in range(len(centres)):
            known = []
            for c in range(len(LENGTHS) + 1):
                every, mine = cosines[classes == c], cosines[(own == j) & (classes == c)]
                rows = mine if len(mine) >= FEW else every
                known.append(float(np.quantile(rows, LOW)) * (1.0 if len(rows) >= FEW else SHORTER) if len(rows) else None)
            radii.append([SLACK * max(0.0, x) for x in by_length(known)])
        return pd.DataFrame({"lang": part["lang"].iloc[0], "at": range(len(centres)), "centroid": [c.astype(np.float32).tobytes() for c in centres], "radii": radii})

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, at int, centroid binary, radii array<double>").orderBy("lang", "at").collect()
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(len(rows), BUCKETS)
    return Model([r["lang"] for r in rows], centroids, np.array([r["radii"] for r in rows]), idf)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``rejected`` and ``has_letter``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        common.let_go()
        known = shared.value

        def make(part: pa.RecordBatch, at: int) -> list:
            return [list(x) for x in zip(*known.predict(part.column(at).to_pylist()), strict=True)]

        return make

    return common.add_columns(docs, text, FIELDS, start)
