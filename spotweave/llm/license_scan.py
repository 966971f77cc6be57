"""License scans by a positional index of rare template words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. How rare a word is comes from all documents
of the input: one pass counts the documents that hold each template word. The index holds, for each word, its
postings (template, position), for each template at its ``VOTES`` rarest words and as many more as an alignment may miss. A file's words
are looked up in the index, which gives the places where templates would start, and postings of a template that agree on a
start within ``SHIFT`` words (a quarter of the template, if that is less) are one candidate. No alignment that covers enough and in which words put in or left
out move the rest by no more than that can lack ``VOTES`` of them. A candidate's window is aligned with the template by
their longest common subsequence. A template is found where that covers at least its threshold and all its mandatory
key phrases stand in the window. Its label is added to those of the
base phrases, which are found wherever their words stand consecutively.

The index is a fixed list of some hundred words; more templates are a parameter. Null texts are empty: no words, no
labels, score 0. Repeated rows are each judged; ties between alignments go to the first. Long texts are scanned whole. A
table without rows gives none. Columns of the input that are named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm import common

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, covered share that is asked for, mandatory key phrases, template.
TEMPLATES = [
    ("gpl-3.0", 0.8, ["gnu general public license", "version 3"], "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", 0.8, ["gnu general public license", "version 3"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2.0", 0.8, ["gnu general public license", "version 2"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3.0", 0.8, ["gnu general public license", "version 3"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 0.8, ["gnu general public license", "version 2"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", 0.8, ["gnu lesser general public license", "version 2 1"], "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", 0.8, ["gnu lesser general public license", "version 3"], "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", 0.8, ["gnu affero general public license", "version 3"], "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", 0.8, ["apache license", "version 2 0"], "licensed under the apache license version 2 0"),
    ("apache-2.0", 0.8, ["apache license", "except in compliance"], "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", 0.8, ["mit license"], "released under the mit license"),
    ("mit", 0.8, ["without restriction", "substantial portions of the software"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 0.8, ["without restriction", "substantial portions of the software", "the software is provided as is"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", 0.8, ["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", 0.8, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", 0.8, ["redistribution and use in source and binary forms", "endorse or promote products"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", 0.8, ["and or distribute this software", "with or without fee"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", 0.8, ["misrepresented", "altered source versions"], "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("mpl-2.0", 0.8, ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", 0.8, ["public domain"], "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc-4.0", 0.8, ["cc by nc"], "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", 0.8, ["cc by sa"], "licensed under cc by sa 4 0"),
    ("cc-by-4.0", 0.8, ["cc by 4 0"], "licensed under cc by 4 0"),
    ("cc-by-4.0", 0.8, ["creative commons attribution"], "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", 1.0, ["all rights reserved"], "all rights reserved"),
]

#: Votes of rare words that a candidate needs, words that may be put in or left out before a vote, and words around an
#: alignment that a key phrase may reach into.
VOTES, SHIFT, SLACK = 2, 8, 3

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("base_starts", T.ArrayType(T.LongType())),
    T.StructField("base_found", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("score", T.DoubleType())]))),
]


class Index:
    """Template words by number, postings of each, and the phrases as numbers."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.words: dict[bytes, int] = {}
        self.templates = [(label, need, [self.numbers(p) for p in keys], np.array(self.numbers(text))) for label, need, keys, text in templates]
        self.base = [(self.numbers(phrase), label) for phrase, label in base.items()]
        self.look = _Absent(self.words)

    def numbers(self, phrase: str) -> list[int]:
        return [self.words.setdefault(w, len(self.words)) for w in phrase.encode().split()]

    def of(self, text: bytes | None) -> np.ndarray:
        """The numbers of a text's words, -1 for those of no template or phrase."""
        words = common.alnum_words(text)
        return np.fromiter(map(self.look.__getitem__, words), np.int32, len(words))


class _Absent(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def places(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    """The places where the words of ``phrase`` stand consecutively."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    same = ids[:n] == phrase[0]
    for k, word in enumerate(phrase[1:], 1):
        same &= ids[k : k + n] == word
    return np.flatnonzero(same)


def document_counts(docs: DataFrame, index: Index, text: str = "text") -> np.ndarray:
    """For each word of the index, the documents that hold it."""
    common.small_batches(docs.sparkSession)
    size = len(index.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in common.slices(batch, 0):
                for t in common.texts_of(part.column(0)):
                    held = np.unique(index.of(t))
                    total[held[held >= 0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["word", "docs"])

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    out = np.zeros(size, np.int64)
    for word, n in counts.collect():  # one row for each word of the fixed index
        out[word] = n
    return out


def covered(template: list[int], window: list[int]) -> tuple[int, int]:
    """The words of ``template`` in its longest common subsequence with ``window``, and the place of the first word of the
    window that such an alignment needs: the last start that loses none.

    Bits of one number stand for the template's words, a step for each word of the window. Both are read backwards, so that
    one pass tells what each start reaches: the last start to reach the most is where the number last grew.
    """
    masks: dict[int, int] = {}
    for at, word in enumerate(reversed(template)):
        masks[word] = masks.get(word, 0) | 1 << at
    every = row = (1 << len(template)) - 1
    most = first = 0
    for at in range(len(window) - 1, -1, -1):
        if hit := row & masks.get(window[at], 0):
            row = (row + hit | row - hit) & every
            if (reached := len(template) - row.bit_count()) > most:
                most, first = reached, at
    return most, first


class Scanner:
    """Finds the templates in one text at a time."""

    def __init__(self, index: Index, counts: np.ndarray):
        self.index = index
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))  # rarest first
        self.missing = [math.floor(round((1 - need) * len(words), 6)) for _, need, _, words in index.templates]
        self.shift = np.array([min(SHIFT, len(words) // 4) for _, _, _, words in index.templates])
        postings: list[list[tuple[int, int]]] = [[] for _ in counts]
        self.votes = []  # that a good alignment can't lack
        for t, ((_, _, _, words), missing) in enumerate(zip(index.templates, self.missing, strict=True)):
            at = np.lexsort((np.arange(len(words)), rank[words]))[: missing + VOTES]
            self.votes.append(max(1, min(len(at) - missing, VOTES)))
            for k in at.tolist():
                postings[words[k]].append((t, k))
        self.sizes = np.array([len(p) for p in postings], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.template, self.place = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2).T
        self.keys = [{w for key in keys for w in key} for _, _, keys, _ in index.templates]

    def starts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Templates and the places where they would start, a pair for each posting of each word of the text, sorted."""
        held = np.flatnonzero(ids >= 0)
        words = ids[held]
        sizes = self.sizes[words]
        at = np.repeat(self.first[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        template, start = self.template[at], np.repeat(held, sizes) - self.place[at]
        order = np.lexsort((start, template))
        return template[order], start[order]

    def matches(self, ids: np.ndarray) -> list[tuple[str, int, float]]:
        """Label, first word and covered share of the best alignment of each template found."""
        template, start = self.starts(ids)
        found: dict[str, tuple[str, int, float]] = {}
        if not len(template):
            return []
        present = set(ids.tolist())
        cuts = np.flatnonzero((np.diff(template) != 0) | (np.diff(start) > self.shift[template[1:]])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(template)], strict=True):
            t = int(template[a])
            label, need, keys, words = self.index.templates[t]
            if b - a < self.votes[t] or not self.keys[t] <= present:
                continue
            shift = int(self.shift[t])
            best = (0.0, 0)
            for at in range(max(0, int(start[a]) - shift), max(0, int(start[b - 1])) + 1, max(1, shift)):
                window = ids[at : at + len(words) + 2 * shift]
                most, first = covered(words.tolist(), window.tolist())
                share = most / len(words)
                if share > best[0] and share >= need and all(len(places(ids[max(0, at + first - SLACK) : at + len(window) + SLACK], k)) for k in keys):
                    best = (share, at + first)
            if best[0] >= need and best[0] > found.get(label, ("", 0, 0.0))[2]:
                found[label] = (label, best[1], best[0])
        return sorted(found.values())

def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, float, list[str], str]] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words``, ``base_starts`` (all places of base phrases), ``base_found`` (their labels) and ``matches``."""
    index = Index(templates)
    counts = document_counts(docs, index, text)

    def start():
        scanner = Scanner(index, counts)

        def make(part: pa.RecordBatch, at: int) -> list:
            sizes, starts, labels, matches = [], [], [], []
            for t in common.texts_of(part.column(at)):
                ids = index.of(t)
                base = [(places(ids, phrase), label) for phrase, label in index.base]
                sizes.append(len(ids))
                starts.append(np.sort(np.concatenate([p for p, _ in base])).tolist())
                labels.append(sorted({label for p, label in base if len(p)}))
                matches.append([{"label": a, "first_word": b, "score": c} for a, b, c in scanner.matches(ids)])
            return [sizes, starts, labels, matches]

        return make

    return common.add_columns(docs, text, FIELDS, start)
