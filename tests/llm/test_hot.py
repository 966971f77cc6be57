"""Hot keys and odd numbers: vectors of any size, windows that many items share, hubs and large components, long sample texts."""

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from spotweave.llm import catalog, common, decontamination, language_id, nearest
from tests.llm.test_llm import SF


def test_nearest_of_tiny_and_huge_doubles(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6))
    sizes = np.array([10.0 ** int(e) for e in rng.integers(-300, 300, 120)])
    y = x * sizes[:, None]
    y[3] = [1e-200] * 6
    y[4] = [5e-324] * 6
    y[5] = [1.7e308] * 6
    rows = [(i, v.tolist()) for i, v in enumerate(y)] + [(500, [0.0] * 6), (501, [float("inf")] * 6)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).toPandas()
    z = y / np.abs(y).max(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for q in range(0, 120, 10):
        s = np.round(z @ z[q], 12)
        order = [i for i in np.lexsort((np.arange(120), -s)) if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == order and np.allclose(mine.score, s[order], atol=1e-11)


def test_parallel_vectors_tie(spark):
    base = np.array([0.3, -0.7, 0.11, 0.2])
    rows = [(i, (base * f).tolist()) for i, f in enumerate([1, 1 / 3, 7.7, 0.1, 1e9, 123.456, 1e-30])] + [(100, [1.0, 0.0, 0.0, 0.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=6).collect()
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5, 6]


def test_a_window_that_many_items_share(spark):
    shared = " ".join(f"w{k}" for k in range(10))
    items = [(i, f"{shared} own{i}") for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = decontamination.item_windows(bench)
    blocks = grams.groupBy(F.pmod("block_key", F.lit(8)).alias("b")).count().collect()
    assert len(blocks) == 8 and max(r["count"] for r in blocks) < 100  # its 200 rows aren't one block's
    docs = spark.createDataFrame([(1, f"before {shared} after"), (2, f"{shared} own7 x"), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_hits(docs, bench, block_windows=50).collect()}
    assert got[1]["items"] == list(range(200)) and sum(got[1].hit_words) == 10 and sum(got[2].hit_words) == 11 and got[3].hit_words is None


@pytest.mark.parametrize("small", [common.SMALL, 0])
def test_components_of_hubs(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    rng = random.Random(3)
    edges = {(0, k) for k in range(1, 1500)} | {tuple(sorted(rng.sample(range(2000, 6000), 2))) for _ in range(1500)}
    table = lambda e: spark.createDataFrame(sorted(e), "a long, b long")

    def by_force(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return {x: find(x) for x in root}

    first = common.components(table(edges))
    assert {r.node: r.label for r in first.collect()} == by_force(edges)
    more = {(7, 2500), (5, 6), (9000, 9001), (1499, 9001)} | {tuple(sorted(rng.sample(range(1, 6000), 2))) for _ in range(40)}
    assert {r.node: r.label for r in common.more_links(first, table(more)).collect()} == by_force(edges | more)
    assert common.more_links(None, table({(1, 2)})).count() == 2 and common.more_links(first, table({(5, 6)})) is first


def predicted(text, model):
    """The nearest centroid by the rule, n-gram by n-gram."""
    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0
    data = (" " + regex.sub(r"\P{L}+", " ", text.lower()).strip() + " ").encode("utf-8", "replace")
    total = np.zeros(language_id.BUCKETS)
    for n in language_id.ORDERS:
        for k in range(len(data) - n + 1):
            key = 0
            for byte in data[k : k + n]:
                key = (key * 257 + byte) % 2**32
            mixed = (key * int(language_id._FACTORS[n - 1]) % 2**32) ^ ((key >> 15) * int(language_id._FACTORS[-1]) % 2**32)
            total[mixed * language_id.BUCKETS >> 32] += 1
    v = np.log(1 + total) * model.idf
    v /= np.linalg.norm(v)
    cosines = [float(np.dot(v, c.astype(float))) for c in model.centroids]
    best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
    return model.names[best], cosines[best]


def test_op1_by_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language_id.fit(docs.where(~held))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = catalog.op1_language_id(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = predicted(texts[r.doc_id], model)
        assert r.lang_pred == lang and r.score == pytest.approx(min(max(score, 0.0), 1.0), abs=1e-5)


def test_language_sample_of_long_texts(spark):
    rng = random.Random(1)
    texts = {lang: [" ".join(rng.choices(words, k=60_000)) for _ in range(12)] for lang, words in {"aa": ["abba", "baba"], "bb": ["otto", "toto"]}.items()}
    docs = spark.createDataFrame([(t, lang) for lang, own in texts.items() for t in own] + [("12 34", "aa")], "text string, lang string")
    model = language_id.fit(docs)
    assert [p[0] for p in model.predict(["abba baba abba", "toto otto"])] == ["aa", "bb"]
