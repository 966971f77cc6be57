"""What a worker process holds: one operator's memory at a time, and few texts' vectors."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from spotweave.llm import language_id, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


class Ran(Exception):
    pass


class Rows:
    """Runs a task's function here."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        list(run(iter([pa.record_batch({"id": [1], "text": ["a text of words"]}).select(self.columns)])))
        raise Ran


def test_another_operator_lets_the_pieces_go():
    pieces = sentence_pieces.loaded(PATH, "bpe")
    assert sentence_pieces.loaded(PATH, "bpe") is pieces  # serves all tasks of its own
    rows = Rows()
    rows.columns = ["text"]
    with pytest.raises(Ran):
        language_id.document_frequency(rows)
    assert sentence_pieces.loaded(PATH, "bpe") is not pieces


def test_predictions_hold_few_vectors():
    rng = np.random.default_rng(1)
    model = language_id.Model(["en"], rng.random((1, language_id.BUCKETS)).astype(np.float32), np.zeros((1, len(language_id.LENGTHS) + 1)), np.ones(language_id.BUCKETS))
    texts = [f"word{k} and more" for k in range(1000)]
    model.predict(texts[:2])
    tracemalloc.start()
    found = model.predict(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1000 and [f[0] for f in found] == ["en"] * 1000
    assert most < 30 << 20, most  # all at once: more than 90 MB
