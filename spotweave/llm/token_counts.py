"""Token counts: batches balanced by bytes are encoded in Arrow functions that return lengths only.

A text is split at safe boundaries: before white space that follows other than white space, and before a mark that
follows letters. No token of a byte-level BPE whose splitting pattern lets a blank only start a piece, and keeps
letters from marks, reaches over such a place, whatever stands on either side, so the counts of the parts add up to
the count of the whole text. Short parts that a task has counted before are looked up; the others go to the tokenizer
in batches of about ``BATCH_BYTES``. A long text is thus encoded in parts, but for a run without a safe place, which
the tokenizer needs whole; no text is truncated.

Null texts count as empty, which has no tokens. Repeated rows are counted each. A table without rows gives none.
Columns of the input that are named like a result are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spotweave.llm import common

#: Bytes in one call of the tokenizer, bytes of the parts that a task remembers (a part costs ``PART_BYTES`` besides its
#: letters), and letters above which a part isn't remembered.
BATCH_BYTES = 256 << 10
REMEMBERED_BYTES, PART_BYTES, LONG_PART = 96 << 20, 120, 64
#: A part: white space with the letters after it, if these end at white space or one of a few marks; else with all
#: up to the next white space.
PART = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[.,;:!?*$%&\s]|$)|\s*\S+|\s+")

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


class Counter:
    """Counts of parts under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.held = 0  # bytes

    def learn(self, parts: list[str]) -> None:
        """Encode ``parts`` in batches of about BATCH_BYTES."""
        batch, size = [], 0
        for i, part in enumerate(parts):
            batch.append(part)
            size += len(part.encode("utf-8", "surrogatepass"))
            if size >= BATCH_BYTES or i == len(parts) - 1:
                for text, found in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                    self.known[text] = len(found)
                self.held += size + PART_BYTES * len(batch)
                batch, size = [], 0

    def counts(self, texts: list[str | None]) -> list[int]:
        parts = [PART.findall(t) if t else [] for t in texts]
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        new = sorted(set().union(*parts).difference(self.known))
        self.learn(new)
        known = self.known
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for part in new:
            if len(part) > LONG_PART:
                del known[part]
                self.held -= PART_BYTES + len(part.encode("utf-8", "surrogatepass"))
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (of the UTF-8 text) and ``n_tokens`` as the tokenizer file at ``tokenizer_path`` gives them."""

    def start():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(tokenizer_path)

        def make(part: pa.RecordBatch, at: int) -> list:
            column = part.column(at)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            return [sizes, np.asarray(counter.counts(column.to_pylist()), dtype=np.int64)]

        return make

    return common.add_columns(docs, text, FIELDS, start)
