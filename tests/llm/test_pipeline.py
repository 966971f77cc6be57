"""The pipeline's stages, one after the other, each against brute force on its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from spotweave.llm import common, language_id, line_dedup
from tests.llm.test_llm import SF, groups_by_force, hits_by_force


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, SF))
        at[name] = (before.toPandas(), docs.toPandas())
        if name != "pieces":
            assert docs.columns == columns
    a, b = at["language"]
    assert len(a) - len(b) <= 0.01 * len(a)  # clean documents stay
    model = language_id.fit(spark.createDataFrame(a[["text", "lang"]]))
    assert set(b.doc_id) == {i for i, t in zip(a.doc_id, a.text, strict=True) if not model.predict([t])[0][2]}
    a, b = at["lines"]
    sites = {}
    for t, s in zip(a.text, a.source, strict=True):
        for line in filter(None, t.split("\n")):
            sites.setdefault(line, set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    assert dict(zip(b.doc_id, b.text, strict=True)) == {i: "\n".join(x for x in t.split("\n") if x not in bad) for i, t in zip(a.doc_id, a.text, strict=True)}
    a, b = at["near duplicates"]
    a = a.sort_values("doc_id")
    roots = groups_by_force(list(a.text), 5, 80, 100)[1]
    assert set(b.doc_id) == {list(a.doc_id)[r] for r in roots}
    a, b = at["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(b.doc_id) <= set(a.doc_id)
    gone = a[~a.doc_id.isin(b.doc_id)]
    assert all(hits_by_force(t, items, 10)[1] for t in gone.text) and not any(hits_by_force(t, items, 10)[1] for t in b.text)
    a, b = at["pieces"]
    assert set(a.doc_id) == set(b.doc_id) and b.round_trip.all()


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words of a text", "en", None, 21), (3, "plain words of a text", "en", None, 21), (None, "words without an id", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = common.written(stage(spark, empty, SF))
    assert empty.count() == 0


def test_copied_documents_leave_the_pipeline_once(spark):
    rng = random.Random(3)
    words = [r.text.split()[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and text <> ''").orderBy("doc_id").limit(60).collect()]
    line = lambda: " ".join(rng.choices(words, k=12)) + f" {rng.random()}"
    copied, near = [line() for _ in range(30)], [line() for _ in range(30)]
    menu = [line() for _ in range(3)]
    rows = [(i, "\n".join(copied), f"s{i % 20}") for i in range(40)]
    for i in range(40, 100):  # one line of each is changed
        rows.append((i, "\n".join(x if k != i % 30 else x + f" more{i}" for k, x in enumerate(near)), f"s{i % 20}"))
    rows += [(i, "\n".join([*menu, *[line() for _ in range(10)]]), f"s{i % 20}") for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = {i: t for i, t, _ in rows}
    cleaned = common.written(corpus_pipeline.lines(spark, docs, SF))
    for r in cleaned.collect():
        lines = texts[r.doc_id].split("\n")
        assert r.text.split("\n") == (lines if r.doc_id < 100 else lines[3:])
        assert r.n_chars == len(r.text)
    left = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, cleaned, SF).collect()}
    assert {i for i in left if i < 100} == {0, 40} and left[0] == texts[0] and left[40] == texts[40]
    assert len([i for i in left if i >= 100]) == 60
