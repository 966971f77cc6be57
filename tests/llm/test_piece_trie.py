"""Words searched together have the pieces of the walk and of the library, and a worker holds little for them."""

import random
import tracemalloc

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from spotweave.llm import piece_trie, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(PATH)


def test_words_together_equal_the_walk(pieces, monkeypatch):
    monkeypatch.setattr(piece_trie, "BLOCK", 700)
    monkeypatch.setattr(piece_trie, "FRESH", 500)
    rng = random.Random(5)
    letters = "abcdeinorstéß▁.#Ж\U0001f600\0"
    words = sorted({"▁" * rng.randint(0, 2) + "".join(rng.choices(letters, k=rng.randint(1, 15))) for _ in range(3000)})
    found = pieces.trie.search(words)
    pieces.encode_sorted(words)
    odd = [w for w in words if any(c not in pieces.ids for c in w)]
    assert 0 < len(odd) < len(words)
    for w, ids in zip(words, found, strict=True):
        assert (ids is None) == any(c not in pieces.ids for c in w)
        assert ids is None or memoryview(ids).cast("i").tolist() == pieces.known[w] == [pieces.ids[p] for p in pieces.merged(w)]
    pieces.known = {}


def test_texts_equal_the_library(pieces, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3000)
    monkeypatch.setattr(sentence_pieces, "AT_ONCE", 20_000)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist(), None, "", " ", "a" * 5000, "\U0001f600\0é" * 300]
    for text, ids in zip(texts, pieces.encode(texts), strict=True):
        assert (ids is None) if text is None else ids.tolist() == model.encode(text)


def test_words_and_neighbours_take_little_memory():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdeinorst", k=9)) for _ in range(1000)) for _ in range(60)]
    tracemalloc.start()
    pieces = sentence_pieces.Pieces(PATH)
    start = tracemalloc.get_traced_memory()[0]
    pieces.encode(texts)
    kept = tracemalloc.get_traced_memory()[0] - start
    tracemalloc.stop()
    assert len(pieces.packed) > 59_000
    assert kept < 15 << 20, kept
