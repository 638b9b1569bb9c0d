"""An Aho-Corasick automaton over word numbers, in a few flat arrays.

Patterns are windows of words. Words are numbered by their 64-bit hashes, and a state is a node of the trie of
windows; nodes are numbered level by level in the order of (parent, word), so the sorted keys of all nodes are the goto function, and
a node takes about 18 bytes. Failure and output links are filled level by level.

Documents are scanned once, all stretches of a slice in lockstep. No pattern is longer than ``size`` words, so
the state after a word depends on at most the ``size`` words up to it: each stretch starts that far ahead in the
root, and is then in the state of a scan from the text's first word. Hits are proved on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import WORD_BYTES, row_words

#: Words of a stretch.
STRETCH = 64


class Found(NamedTuple):
    """What a text holds: its number of words, merged ranges of hit words (both ends included), sorted item ids."""

    words: int
    ranges: list[tuple[int, int]]
    items: list[str]


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, first[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    return list(zip(first[at].tolist(), last[np.append(at[1:], len(last)) - 1].tolist(), strict=True))


class Automaton:
    """The automaton of all windows of ``size`` words of (item id, text) pairs; shorter items are one window."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.size, self.ids = size, sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        hashed = [(w, c) for _, _, w, c in row_words(pa.array([t for _, t in items], pa.string()))]
        all_words = np.concatenate([w for w, _ in hashed]) if hashed else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in hashed]) if hashed else np.zeros(0, np.int64)
        #: the items' normalised texts, and where each word begins in them: hits are proved on these
        self.text = b"".join(w + b" " for _, t in items for w in words(t))
        self.begins = np.append(0, np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) + 1)
        self.vocabulary, which = np.unique(all_words, return_inverse=True)
        self.base = np.int64(len(self.vocabulary) + 1)
        which = which.astype(np.int64) + 1
        n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
        owner = np.repeat(np.arange(len(counts)), n)
        at = (np.cumsum(counts) - counts)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        take = np.minimum(counts, size)[owner]
        node, total, levels = np.zeros(len(at), np.int64), 1, []
        for d in range(size):
            live = np.flatnonzero(take > d)
            if not len(live):
                break
            keys, place = np.unique(node[live] * self.base + which[at[live] + d], return_inverse=True)
            node[live] = total + place
            levels.append((total, keys))
            total += len(keys)
        self.keys = np.concatenate([k for _, k in levels]) if levels else np.zeros(0, np.int64)
        self.first = np.zeros(self.base, np.int32)
        if levels:
            self.first[levels[0][1]] = np.arange(1, 1 + len(levels[0][1]))
        self.depth, self.sample = np.zeros(total, np.int8), np.zeros(total, np.int64)
        ends = np.zeros(total, bool)
        ends[node] = len(node) > 0
        ends[0] = False
        self.sample[node] = at
        pairs = np.unique(np.stack([node, np.array([number[i] for i, _ in items], np.int64)[owner]], 1), axis=0) if len(node) else np.zeros((0, 2), np.int64)
        self.pair_node, self.pair_item = pairs[:, 0], pairs[:, 1]
        self.ends, self.fail, self.link = ends, np.zeros(total, np.int32), np.zeros(total, np.int32)
        for d, (begin, keys) in enumerate(levels):
            nodes = np.arange(begin, begin + len(keys))
            self.depth[nodes] = d + 1
            if d:
                self.fail[nodes] = self._go(self.fail[keys // self.base], keys % self.base)
            to = self.fail[nodes]
            self.link[nodes] = np.where(ends[to], to, self.link[to])
        self.hit = ends | (self.link > 0)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + len(self.text)

    def _go(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states that follow: by goto, else by goto from the failure states."""
        out = self.first[word]
        left = np.flatnonzero((state > 0) & (word > 0))
        now, by = state[left].astype(np.int64), word[left]
        while len(left):
            key = now * self.base + by
            place = np.searchsorted(self.keys, key)
            good = self.keys[np.minimum(place, len(self.keys) - 1)] == key
            out[left[good]] = place[good] + 1
            now = self.fail[now].astype(np.int64)
            on = ~good & (now > 0)
            left, now, by = left[on], now[on], by[on]
        return out

    def states(self, numbers: np.ndarray) -> np.ndarray:
        """The state after each word of one line of word numbers (0: no pattern has the word)."""
        ahead, n = self.size - 1, len(numbers)
        lanes = max(1, -(-n // STRETCH))
        line = np.concatenate([np.zeros(ahead, numbers.dtype), numbers, np.zeros(lanes * STRETCH - n, numbers.dtype)])
        steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(line, STRETCH + ahead)[::STRETCH].T)
        out = np.zeros((STRETCH, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t, word in enumerate(steps):
            state = self._go(state, word)
            if t >= ahead:
                out[t - ahead] = state
        return out.T.ravel()[:n]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)

    def scan(self, texts: pa.Array) -> Iterator[Found]:
        """What each text of a column holds."""
        for row, end, hashes, counts in row_words(texts):
            # a word of no pattern between texts: no state goes on
            line = np.zeros(len(hashes) + len(counts), np.int64)
            begin = np.cumsum(counts + 1) - counts - 1
            text_of = np.repeat(np.arange(len(counts)), counts)
            line[np.arange(len(hashes)) + text_of] = self.numbers(hashes)
            state = self.states(line)
            at = np.flatnonzero(self.hit[state])
            found: dict[int, list[tuple[int, int]]] = {}
            if len(at):
                rows = np.searchsorted(begin, at, "right") - 1
                now, last = state[at].astype(np.int64), at - begin[rows]
                while len(now):
                    own = self.ends[now]
                    for r, p, w in zip(rows[own].tolist(), now[own].tolist(), last[own].tolist(), strict=True):
                        found.setdefault(r, []).append((p, w))
                    now = self.link[now].astype(np.int64)
                    on = now > 0
                    now, rows, last = now[on], rows[on], last[on]
            for r, n in enumerate(counts.tolist()):
                yield self._proved(n, texts[row + r].as_py(), found[r]) if r in found else Found(n, [], [])

    def _proved(self, n: int, text: str, hits: list[tuple[int, int]]) -> Found:
        mine = words(text)
        ranges, nodes = [], set()
        for node, last in hits:
            size, begin = int(self.depth[node]), self.sample[node]
            if b" ".join(mine[last + 1 - size : last + 1]) == self.text[self.begins[begin] : self.begins[begin + size] - 1]:
                ranges.append((last + 1 - size, last))
                nodes.add(node)
        if not ranges:
            return Found(n, [], [])
        items = {self.pair_item[i] for p in nodes for i in range(np.searchsorted(self.pair_node, p), np.searchsorted(self.pair_node, p, "right"))}
        first, last = np.array(ranges).T
        return Found(n, _merged(first, last), [self.ids[i] for i in sorted(items)])
