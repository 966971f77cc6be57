"""Terms are counted in tasks that follow the texts' bytes, and are the same however the texts are dealt."""

from pyspark.sql import functions as F

from spotweave.plans import fixtures


def test_tasks_follow_the_texts(spark, tmp_path, monkeypatch):
    rows = [(i % 150, "s" if i % 2 else None, f"Alpha beta w{i % 7}x beta") for i in range(300)] + [(None, "s", "beta"), (900, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fixtures, "TEXT_BYTES", 400, raising=False)
    found = fixtures.counts(spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8  # never put together again
    want = {}
    for doc, source, text in rows:
        for gene in ["Alpha", "beta", "beta", "w", "x"] if text and len(text) > 4 else ["beta"] if text else []:
            want[doc, source, gene] = want.get((doc, source, gene), 0.0) + 1
    assert {(r.spot_id, r.slice, r.gene): r.cnt for r in found.collect()} == want
