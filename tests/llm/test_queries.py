"""The registered queries over whole tables, against the libraries and brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from spotweave.llm import catalog
from tests.llm.test_llm import SF, groups_by_force


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, query, columns, key="doc_id"):
    found = query(spark, SF)
    assert found.columns[: len(columns)] == columns
    return {r[key]: r for r in found.collect()}


def test_op1(spark, docs):
    got = rows(spark, catalog.op1_language_id, ["doc_id", "held_out", "lang_pred", "score"])
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or ""))
    held = [i for i in got if got[i].held_out and docs[i].lang]
    assert np.mean([got[i].lang_pred == docs[i].lang for i in held]) > 0.95


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    got = rows(spark, catalog.op2_token_counts, ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    for i, d in docs.items():
        n = len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)
        assert tuple(got[i])[1:4] == (len((d.text or "").encode()), n, n > 512)


def test_op4(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, catalog.op4_sentence_pieces, ["doc_id", "ids", "n_pieces"])
    for i, d in docs.items():
        assert got[i].ids == (None if d.text is None else model.encode(d.text)) and got[i].n_pieces == len(got[i].ids or [])


def test_op7(spark, docs):
    got = rows(spark, catalog.op7_jaccard_join, ["doc_id", "n_shingles", "component_id"])
    ids = sorted(docs)
    sizes, roots = groups_by_force([docs[i].text for i in ids], 3, 90, 100)
    assert [(got[i].n_shingles, got[i].component_id) for i in ids] == [(n, ids[r]) for n, r in zip(sizes, roots, strict=True)]
    assert len({*roots}) < len(ids)


def test_op8(spark, docs):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = rows(spark, catalog.op8_license_scan, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    hits = 0
    for i, d in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        places = [(k, label) for phrase, label in base.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        labels = sorted({x for _, x in places})
        starts = [k for k, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
        hits += bool(places)
    assert hits


def test_op10(spark):
    found = catalog.op10_nearest(spark, SF)
    assert found.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(table.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found.toPandas()
    want = 0
    for q in table.vec_id[table.vec_id % 50 == 0]:
        cosine = x @ x[table.vec_id == q][0]
        cosine[table.vec_id == q] = -2
        order = table.vec_id.to_numpy()[np.lexsort((table.vec_id, -np.round(cosine, 12)))][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, [cosine[table.vec_id == v][0] for v in own.vec_id], atol=1e-12)
        want += len(set(order) & set(own.vec_id))
    assert want >= 0.95 * len(got)
