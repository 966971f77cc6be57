"""SentencePiece encoding and decoding by a Viterbi search that words with a common prefix share.

A text is normalised as the model does it (blanks become ``MARK``, one mark goes in front) and split into marked words.
The distinct words of an Arrow batch are sorted, so neighbours share prefixes, and the trie that they form is walked
depth first: each letter adds one forward state, and the next word starts from the states of the prefix that it has in
common with the word before. A forward state holds the best score of all segmentations of the prefix, with the last
piece and where it starts. Under BPE, the words of a batch take this walk together, as arrays (``piece_trie``); long words, and those
with a letter that is no piece, take it one by one.

* ``kind="unigram"``: a segmentation scores the sum of its pieces' scores.
* ``kind="bpe"`` (the model files here): the merges of BPE forbid most segmentations. A piece may follow another only if
  BPE leaves the two side by side when it encodes their concatenation. A segmentation of which all neighbours are
  allowed is the one that BPE gives, so one piece at most is allowed to end each prefix, and the search returns the ids
  of the ``sentencepiece`` library. Whether two pieces may be neighbours is worked out once and remembered.

A letter that is no piece becomes the pieces of its UTF-8 bytes. Words end where no piece can reach over: before a mark
that follows another letter, and between letters that no piece has side by side; both are worked out of the pieces when
a model is loaded.

Null texts give null, empty texts no ids. Repeated rows get equal ids. Texts are encoded whole, however long; a single
word longer than ``LONG_WORD`` letters is walked by itself and not remembered. Tables without rows give none. Columns of
the input that are named like a result are replaced. A text that holds the mark itself is decoded with blanks there.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spotweave.llm import common, piece_trie

MARK = "▁"
#: Words that a worker remembers in each of two generations, letters above which a word isn't remembered, neighbours remembered for such words,
#: letters of text (a text at least) whose words are held at once.
REMEMBERED, LONG_WORD, NEIGHBOURS, AT_ONCE = 100_000, 200, 20_000, 1 << 20
LETTERS, SIGNS, SPACES = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?*$%&\"()", "\n\t\r"
NEVER = float("-inf")

ENCODED = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
DECODED = [T.StructField("decoded", T.StringType())]


class Pieces:
    """The pieces of a model file and the search over them."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        self.text: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = model.unk_id()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text.append(piece)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} has a mark after another letter: words can't be encoded by themselves")
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else piece.encode() for i, piece in enumerate(self.text)]
        self.tails = self._tails()
        self.lengths: dict[str, list[int]] = {}
        self.word = self._splitter()
        self.neighbours: dict[tuple[str | None, str], bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}  # by the walk
        self.packed: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.trie = piece_trie.Trie([t if t in self.ids else None for t in self.text], self._may) if kind == "bpe" else None

    def _tails(self) -> dict[str, list[int]]:
        """For each last three letters, the lengths of the pieces that end with them, longest first."""
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        return {c: sorted(n, reverse=True) for c, n in lengths.items()}

    def _ending(self, tail: str) -> list[int]:
        """The lengths that pieces before the end of ``tail`` (the last three letters, or all there are) may have, longest first."""
        self.lengths[tail] = found = [*(self.tails.get(tail, ()) if len(tail) == 3 else ()), *([2] if tail[-2:] in self.scores and len(tail) > 1 else ()), 1]
        if len(self.lengths) > REMEMBERED:
            self.lengths.clear()
        return found

    def _splitter(self) -> re.Pattern:
        """The pattern of marked words. No merge reaches over their ends: they are cut where no piece has the two letters
        side by side, that is before a mark, around white space that is no piece, and between letters and those
        signs that no piece has after a letter."""
        signs = "".join(c for c in SIGNS if not any(re.search(f"[{LETTERS}]{re.escape(c)}", piece) for piece in self.ids))
        spaces = "".join(c for c in SPACES if c not in self.ids and not any(c in piece for piece in self.ids)) or "\0"
        ends = f"[{re.escape(signs)}{MARK}{spaces}]" if signs else f"[{MARK}{spaces}]"
        return re.compile(f"{MARK}*[{LETTERS}]+(?={ends}|$)|{MARK}*[^{MARK}{spaces}]+|{MARK}+|[{spaces}]+")

    # --- which pieces may be neighbours under BPE

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by BPE: the best-scored pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allowed(self, left: str | None, right: str) -> bool:
        """Whether ``right`` may follow ``left`` (None: the start, or a letter that is no piece)."""
        if self.kind == "unigram":
            return True
        found = self.neighbours.get((left, right))
        if found is None:
            if len(self.neighbours) > NEIGHBOURS:
                self.neighbours.clear()
            alone = left is None or self.allowed(None, right)
            found = alone and self.merged((left or "") + right) == ([right] if left is None else [left, right])
            self.neighbours[left, right] = found
        return found

    def _may(self, left: int, right: int) -> bool:
        """``allowed`` by ids (-1: None). Not remembered here; the trie asks once."""
        a, b = self.text[left] if left >= 0 else "", self.text[right]
        alone = self.alone.get(right)
        if alone is None:
            alone = self.alone[right] = self.merged(b) == [b]
        return alone and (not a or self.merged(a + b) == [a, b])

    # --- the search

    def encode_sorted(self, words: list[str]) -> None:
        """Remember the ids of ``words``, which are sorted: a depth-first walk of their trie."""
        states: list[tuple[float, str | None, int]] = [(0.0, None, -1)]  # of each prefix: score, last piece, its start
        before = ""
        for word in words:
            common_prefix = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common_prefix += 1
            del states[common_prefix + 1 :]
            self._extend(states, word, common_prefix)
            self.known[word] = self._trace(states, word)
            before = word

    def _extend(self, states: list, word: str, done: int) -> None:
        """Add the forward states of the letters after the first ``done``."""
        scores, neighbours, lengths, one_way = self.scores, self.neighbours, self.lengths, self.kind == "bpe"
        for end in range(done + 1, len(word) + 1):
            letter = word[end - 1]
            if letter not in scores:  # it becomes bytes
                states.append((states[end - 1][0], None, end - 1))
                continue
            best: tuple[float, str | None, int] = (NEVER, None, -1)
            tail = word[max(0, end - 3) : end]
            for n in lengths.get(tail) or self._ending(tail):
                start = end - n
                if start < 0:
                    continue
                piece = word[start:end]
                own = scores.get(piece)
                if own is None:
                    continue
                score, last, _ = states[start]
                if score == NEVER:
                    continue
                fits = neighbours.get((last, piece))
                if fits is None:
                    fits = self.allowed(last, piece)
                if fits and score + own > best[0]:
                    best = (score + own, piece, start)
                    if one_way:  # no other piece can be allowed here
                        break
            states.append(best)

    def _trace(self, states: list, word: str) -> list[int]:
        out: list[int] = []
        at = len(word)
        while at > 0:
            _, piece, start = states[at]
            if piece is None:
                data = word[start:at].encode("utf-8", "surrogatepass")
                out.extend(reversed([self.bytes.get(b, self.unknown) for b in data]))
            else:
                out.append(self.ids[piece])
            at = start
        out.reverse()
        return out

    # --- texts

    def pack(self, words: list[str]) -> None:
        """Remember the ids of ``words``, which are sorted, four bytes each."""
        short = [w for w in words if len(w) <= LONG_WORD] if self.trie else []
        found = dict(zip(short, self.trie.search(short), strict=True)) if short else {}
        self.encode_sorted([w for w in words if found.get(w) is None])
        found.update((w, np.array(ids, np.int32).tobytes()) for w, ids in self.known.items())
        self.known = {}
        self.packed.update(found)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        at = np.cumsum([len(t or "") for t in texts]) // AT_ONCE
        return [x for _, part in itertools.groupby(zip(at.tolist(), texts, strict=True), lambda p: p[0]) for x in self._encode([t for _, t in part])]

    def _encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*(s for s in split if s)).difference(self.packed)
        if len(self.packed) + len(new) > REMEMBERED:  # common words move on from the generation before
            self.before, self.packed = self.packed, {}
            new = set().union(*(s for s in split if s))
        again = new.intersection(self.before)
        self.packed.update((w, self.before[w]) for w in again)
        self.pack(sorted(new.difference(again)))
        packed = self.packed
        out = [None if words is None else np.frombuffer(b"".join(map(packed.__getitem__, words)), np.int32) for words in split]
        for w in [w for w in new if len(w) > LONG_WORD]:
            del packed[w]
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ``ids``: bytes are joined to letters, marks become blanks, the first mark goes."""
        if ids is None:
            return None
        joined = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return joined[1:] if joined[:1] == " " else joined


def loaded(path: str, kind: str) -> Pieces:
    """The pieces of a file, loaded once in a worker process: what it remembers of words serves all its tasks, until another operator's begin."""
    return common.held((path, kind), lambda: Pieces(path, kind))


def encode(docs: DataFrame, model_path: str, text: str = "text", kind: str = "bpe") -> DataFrame:
    """``docs`` with ``ids``, the pieces of ``text``."""

    def start():
        pieces = loaded(model_path, kind)

        def make(part: pa.RecordBatch, at: int) -> list:
            return [pieces.encode(part.column(at).to_pylist())]

        return make

    return common.add_columns(docs, text, ENCODED, start)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", kind: str = "bpe") -> DataFrame:
    """``docs`` with ``decoded``, the text of the pieces in column ``ids``."""
    common.small_batches(docs.sparkSession)
    kept = common.drop_clashing(docs, ["decoded"])
    schema = T.StructType([*kept.schema.fields, *DECODED])
    at, keep = docs.columns.index(ids), [docs.columns.index(c) for c in kept.columns]

    def run(batches):
        pieces = loaded(model_path, kind)
        for batch in batches:
            made = [pieces.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(made, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text", kind: str = "bpe") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` in one pass over the texts."""

    def start():
        pieces = loaded(model_path, kind)

        def make(part: pa.RecordBatch, at: int) -> list:
            ids = pieces.encode(part.column(at).to_pylist())
            return [ids, [None if x is None else pieces.decode(x.tolist()) for x in ids]]

        return make

    return common.add_columns(docs, text, [*ENCODED, *DECODED], start)
