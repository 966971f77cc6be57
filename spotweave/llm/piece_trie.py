"""The forward states of many sorted words at once, as arrays: what ``sentence_pieces`` does letter by letter, for BPE models.

The pieces are a trie whose nodes also know where to go on when a letter doesn't fit (Aho and Corasick), so a letter takes a word from
one node to the next, and a node knows the longest piece that ends there. ``shorter`` leads from a piece to the next one that ends
with it. All words of a block take their next letter together; a prefix that words have in common is worked out once. Of the pieces
that end at a letter, longest first, that is taken which may follow the last piece where it starts.

Which pieces may be neighbours is asked of ``may`` once and then kept as sorted numbers, nine bytes a pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words of a block, new pairs kept apart until they are sorted in, pairs kept.
BLOCK, FRESH, MOST_PAIRS = 8192, 20_000, 1_000_000


class Trie:
    """``pieces``: texts by id (None: can't be chosen). ``may(left, right)``: whether ``right`` may follow ``left`` (-1: the start or a letter that is no piece)."""

    def __init__(self, pieces: list[str | None], may: Callable[[int, int], bool]):
        self.may, self.size = may, np.array([len(p) if p else 1 for p in pieces], np.int32)
        ids = np.array(sorted((i for i, p in enumerate(pieces) if p), key=lambda i: pieces[i]), np.int32)
        texts = [pieces[i] for i in ids.tolist()]
        letters, sizes = _letters(texts)
        self.alphabet = np.unique(letters[np.arange(letters.shape[1]) < sizes[:, None]])
        self.single = np.zeros(len(self.alphabet) + 1, bool)  # the last: all other letters
        code, common = self._codes(letters), _common(letters, sizes)
        del letters
        at, count, keys, levels = np.zeros(len(ids), np.int32), 1, [], []
        for d in range(1, code.shape[1] + 1):  # a node for each prefix
            rows = np.flatnonzero(sizes >= d)
            first = common[rows] < d
            new, letter = rows[first], code[rows[first], d - 1]
            keys.append(at[new].astype(np.int64) * len(self.single) + letter)
            levels.append((at[new].copy(), letter, np.arange(count, count + len(new), dtype=np.int32)))
            at[rows] = count + np.cumsum(first) - 1
            count += len(new)
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.child = np.concatenate(keys)[order], np.concatenate([x[2] for x in levels])[order]
        own = np.full(count, -1, np.int32)
        own[at] = ids
        self.single[code[sizes == 1, 0]] = True
        self.fail, self.longest, self.shorter = np.zeros(count, np.int32), own.copy(), np.full(len(pieces), -1, np.int32)
        for d, (parent, letter, node) in enumerate(levels):
            self.fail[node] = self._step(self.fail[parent], letter) if d else 0
            below = self.longest[self.fail[node]]
            ends = own[node] >= 0
            self.shorter[own[node[ends]]] = below[ends]
            self.longest[node[~ends]] = below[~ends]
        self.pairs, self.fits, self.fresh = np.empty(0, np.int64), np.empty(0, bool), {}

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, len(self.alphabet)).astype(np.int32)

    def _step(self, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that ``letter`` leads to."""
        out, at, todo = np.zeros(len(at), np.int32), at.copy(), np.arange(len(at))
        while len(todo):
            key = at[todo].astype(np.int64) * len(self.single) + letter[todo]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            out[todo[hit]] = self.child[k[hit]]
            todo = todo[~hit]
            todo = todo[at[todo] > 0]
            at[todo] = self.fail[at[todo]]
        return out

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) + 1) * len(self.size) + right
        out, missing = np.zeros(len(key), bool), np.ones(len(key), bool)
        if len(self.pairs):
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            missing = self.pairs[k] != key
            out[~missing] = self.fits[k[~missing]]
        if missing.any():
            asked, back = np.unique(key[missing], return_inverse=True)
            found = []
            for pair in asked.tolist():
                fits = self.fresh.get(pair)
                if fits is None:
                    fits = self.fresh[pair] = self.may(pair // len(self.size) - 1, pair % len(self.size))
                found.append(fits)
            out[missing] = np.array(found, bool)[back]
            if len(self.fresh) > FRESH:
                self._sort_in()
        return out

    def _sort_in(self) -> None:
        if len(self.pairs) > MOST_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        pairs = np.concatenate([self.pairs, np.fromiter(self.fresh, np.int64, len(self.fresh))])
        fits = np.concatenate([self.fits, np.fromiter(self.fresh.values(), bool, len(self.fresh))])
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.fits, self.fresh = pairs[order], fits[order], {}

    def search(self, words: list[str]) -> list[bytes | None]:
        """The ids of each of the sorted ``words``, four bytes each; None for a word with a letter that is no piece."""
        return [x for k in range(0, len(words), BLOCK) for x in self._search(words[k : k + BLOCK])]

    def _search(self, words: list[str]) -> list[bytes | None]:
        letters, sizes = _letters(words)
        code, common = self._codes(letters), _common(letters, sizes)
        del letters
        last, node = np.full((len(words), code.shape[1] + 1), -1, np.int32), np.zeros(len(words), np.int32)
        for d in range(1, code.shape[1] + 1):
            rows = np.flatnonzero(sizes >= d)
            first = common[rows] < d
            new = rows[first]
            node[new] = to = self._step(node[new], code[new, d - 1])
            piece = np.where(self.single[code[new, d - 1]], self.longest[to], -1)
            todo = np.flatnonzero(piece >= 0)
            while len(todo):
                right = piece[todo]
                todo = todo[~self._allowed(last[new[todo], d - self.size[right]], right)]
                piece[todo] = self.shorter[piece[todo]]
                todo = todo[piece[todo] >= 0]
            last[new, d] = piece
            same = new[np.cumsum(first) - 1]  # the first word with the prefix
            node[rows], last[rows, d] = node[same], last[same, d]
        return self._traced(last, sizes, ~self.single[code])

    def _traced(self, last: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> list[bytes | None]:
        bad = (odd & (np.arange(odd.shape[1]) < sizes[:, None])).any(axis=1)
        at, steps = np.where(bad, 0, sizes), []
        rows = np.flatnonzero(at)
        while len(rows):
            piece = last[rows, at[rows]]
            if (piece < 0).any():
                raise ValueError("a prefix without pieces")
            steps.append((rows, piece))
            at[rows] -= self.size[piece]
            rows = rows[at[rows] > 0]
        n = np.zeros(len(sizes), np.int64)
        for rows, _ in steps:
            n[rows] += 1
        ends = np.cumsum(n)
        flat = np.empty(int(ends[-1]), np.int32)
        for k, (rows, piece) in enumerate(steps):
            flat[ends[rows] - 1 - k] = piece
        data, ends = flat.tobytes(), (ends * 4).tolist()
        return [None if b else data[x:y] for x, y, b in zip([0, *ends], ends, bad.tolist(), strict=False)]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of each word, a row each, and how many there are."""
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    wide = max(1, int(sizes.max()))
    return np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide), sizes


def _common(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many first letters each word has in common with the word before."""
    same = np.logical_and.accumulate(letters[1:] == letters[:-1], axis=1).sum(axis=1)
    return np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))]).astype(np.int32)
