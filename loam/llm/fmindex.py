"""A compressed FM-index over a sequence of numbers: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks))]).astype(np.int32)
        self.zeros = int(len(bits) - self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each place i."""
        block = i >> 6
        low = self.blocks[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of text, of which any two differ within the first `longest` entries (prefix doubling)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        step *= 2
        if step >= longest or step >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Index of several sequences of words (dense numbers from 0), none of which runs over into the next."""

    def __init__(self, pieces: list[np.ndarray], words: int):
        size = np.array([len(x) for x in pieces])
        n = int(size.sum()) + len(pieces)
        end = np.cumsum(size + 1) - 1
        # Each piece ends in a number of its own, below all words, so all suffixes differ.
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[end] = False
        text[inside] = np.concatenate(pieces) + len(pieces)
        text[end] = np.arange(len(pieces))
        order = suffix_array(text, int(size.max(initial=0)) + 2)
        shown = np.zeros(n, np.int64)  # 0 for every end, words from 1
        shown[inside] = text[inside] - len(pieces) + 1
        last = shown[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(shown, minlength=words + 1))])
        self.levels: list[Bits] = []
        self.depth = max(1, int(words).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bits = (last >> level) & 1 == 1
            self.levels.append(Bits(bits))
            last = np.concatenate([last[~bits], last[bits]])
        self.size = n

    def rank(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Number of `word`s (from 1) before the places i of the transform."""
        low = np.zeros(len(i), np.int64)
        high = i.astype(np.int64)
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = (word >> level) & 1 == 1
            a, b = bits.ones(low), bits.ones(high)
            low = np.where(one, bits.zeros + a, low - a)
            high = np.where(one, bits.zeros + b, high - b)
        return high - low

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffixes that begin with word and go on as those from low to high do."""
        both = self.rank(np.concatenate([word, word]), np.concatenate([low, high]))
        base = self.first[word]
        return base + both[: len(word)], base + both[len(word) :]

    def statistics(self, text: np.ndarray, end: np.ndarray, most: int, least_places: int = 2) -> np.ndarray:
        """For each end (exclusive) in text, the longest match to the left of it, up to `most` words, that has
        least_places places in the index. Words are numbers from 0; a word that the index lacks is -1."""
        length = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64)
        for step in range(1, most + 1):
            at = end[live] - step
            live_ok = (at >= 0) & (text[at] >= 0)
            live, low, high = live[live_ok], low[live_ok], high[live_ok]
            if not len(live):
                break
            low, high = self.extend(text[end[live] - step] + 1, low, high)
            alive = high - low >= least_places
            live, low, high = live[alive], low[alive], high[alive]
            length[live] = step
        return length
