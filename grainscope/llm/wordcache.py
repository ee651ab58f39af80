"""Encode texts word by word with a bounded memory of words already encoded.

A text is cut where no token can cross the cut. Most words repeat, so each task encodes only the words
it has not seen; ids of a batch are then gathered with array operations. The memory never changes a result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from grainscope.llm.batches import gather_runs, offsets_of


class WordCache:
    """Ids of words in one flat array. Subclasses say how texts are cut and how new words are encoded."""

    def __init__(self, max_words: int = 600_000):
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.flags = np.zeros(1 << 14, bool)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word."""
        raise NotImplementedError

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The words of each text."""
        raise NotImplementedError

    def unsafe(self, word: str) -> bool:
        """Is a text with this word to be cut by ``cut_exactly`` instead?"""
        return False

    def cut_exactly(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, words: list[str]) -> None:
        flat, lengths = self.encode_words(words)
        n, size = len(self.rows), len(self.rows) + len(words)
        if size > len(self.starts):
            room = max(size, 2 * len(self.starts)) - n
            self.starts = np.concatenate([self.starts[:n], np.zeros(room, np.int64)])
            self.lengths = np.concatenate([self.lengths[:n], np.zeros(room, np.int64)])
            self.flags = np.concatenate([self.flags[:n], np.zeros(room, bool)])
        if self.used + len(flat) > len(self.flat):
            room = max(self.used + len(flat), 2 * len(self.flat)) - self.used
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(room, np.int32)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[n:size] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:size] = lengths
        self.flags[n:size] = np.fromiter(map(self.unsafe, words), bool, len(words))
        self.rows.update(zip(words, range(n, size)))
        self.used += len(flat)

    def rows_of(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.rows))
        if new:
            self.learn(new)
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text (NULL: none)."""
        if len(self.rows) > self.max_words:
            self.clear()
        texts = [t or "" for t in texts]
        parts = self.cut(texts)
        rows = self.rows_of(list(chain.from_iterable(parts)))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flagged = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(self.flags[rows], out=flagged[1:])
        ends = np.cumsum(counts)
        again = np.flatnonzero(flagged[ends] > flagged[ends - counts])
        if len(again):
            for i in again.tolist():
                parts[i] = self.cut_exactly(texts[i])
            rows = self.rows_of(list(chain.from_iterable(parts)))
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(counts)
        lengths = self.lengths[rows]
        sums = offsets_of(lengths)
        return self.flat[gather_runs(self.starts[rows], lengths)], sums[ends] - sums[ends - counts]
