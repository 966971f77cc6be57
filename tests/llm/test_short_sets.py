"""Sets of few shingles on long lists: no more matches may be asked of a pair than it must share."""

from spotweave.llm import jaccard_join


def test_short_sets_that_meet_many_link(spark):
    base = " ".join(f"w{i}" for i in range(11))
    texts = [base, *(f"{base} own{i}" for i in range(20)), *(f"other{i} {base}" for i in range(20))]  # 9 shingles, and 10 of which 9 are the first's
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs, words=3, num=90, den=100).collect()}
    assert got == {i: (9 if i == 0 else 10, 0) for i in range(len(texts))}
