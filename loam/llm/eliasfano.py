"""Elias-Fano sequences and an n-gram trie of three levels over them, laid out in one buffer that may be memory-mapped."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

U64 = np.uint64
#: Entries that are looked up at once, each of which takes some twenty numbers of 8 bytes meanwhile.
BLOCK = 1 << 16


def in_blocks(n: int) -> Iterator[slice]:
    for i in range(0, n, BLOCK):
        yield slice(i, min(n, i + BLOCK))


def _select(blocks: np.ndarray, before: np.ndarray, k: np.ndarray, zero: bool) -> np.ndarray:
    """Place of the k-th (from 0) one, or zero, of a packed bit vector; before: ones before each block."""
    counted = 64 * np.arange(len(before), dtype=np.int64) - before if zero else before
    block = np.searchsorted(counted, k, side="right") - 1
    word = ~blocks[block] if zero else blocks[block]
    rest = k - counted[block]
    place = np.zeros(len(k), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> place.astype(U64)) & U64((1 << width) - 1)).astype(np.int64)
        over = rest >= low
        rest -= np.where(over, low, 0)
        place += np.where(over, width, 0)
    return block * 64 + place


class EliasFano:
    """A sequence that doesn't fall, of numbers below 2 ** bits: high parts in unary, low parts in whole bytes."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, blocks: np.ndarray, before: np.ndarray):
        self.n, self.low_bytes, self.low, self.blocks, self.before = n, low_bytes, low, blocks, before

    @staticmethod
    def of(values: np.ndarray, bits: int) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        low_bytes = min(7, max(0, -(-(bits - max(1, n).bit_length()) // 8)))
        shift = U64(8 * low_bytes)
        high = (values >> shift).view(np.int64)
        flags = np.zeros((n + (int(high[-1]) if n else 0) + 2 + 63) // 64 * 64, bool)
        high += np.arange(n)
        flags[high] = True
        del high
        blocks = np.packbits(flags, bitorder="little").view(U64)
        low = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(n, 8)[:, :low_bytes]
        return EliasFano(n, low_bytes, np.ascontiguousarray(low), blocks, EliasFano._directory(blocks))

    @staticmethod
    def _directory(blocks: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), U64)
        for k in range(self.low_bytes):
            out |= self.low[i, k].astype(U64) << U64(8 * k)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.blocks, self.before, i, zero=False) - i
        return (high.astype(U64) << U64(8 * self.low_bytes)) | self._low(i)

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number not below x, between the places begin and end if they are given."""
        x = np.asarray(x, U64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> U64(8 * self.low_bytes)).astype(np.int64)
        zeros = 64 * (len(self.before) - 1) - int(self.before[-1])
        last = np.minimum(high, zeros - 1)
        to = np.minimum(_select(self.blocks, self.before, last, zero=True) - last, self.n)
        first = np.maximum(last - 1, 0)
        low = np.where(high > 0, _select(self.blocks, self.before, first, zero=True) - first, 0)
        low = np.where(high >= zeros, self.n, np.minimum(low, self.n))
        if begin is not None:
            low, to = np.maximum(low, begin), np.minimum(to, end)
        want = x & U64((1 << (8 * self.low_bytes)) - 1)
        to = np.maximum(low, to)
        while (open_ := np.flatnonzero(low < to)).size:
            mid = (low[open_] + to[open_]) // 2
            less = self._low(mid) < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            to[open_] = np.where(less, to[open_], mid)
        return low

    def dump(self) -> bytes:
        return struct.pack("<QQQ", self.n, self.low_bytes, len(self.blocks)) + self.blocks.tobytes() + self.low.tobytes() + b"\0" * (-self.low.size % 8)

    @staticmethod
    def view(buffer, at: int) -> tuple[EliasFano, int]:
        n, low_bytes, many = struct.unpack_from("<QQQ", buffer, at)
        at += 24
        blocks = np.frombuffer(buffer, U64, many, at)
        at += 8 * many
        low = np.frombuffer(buffer, np.uint8, n * low_bytes, at).reshape(n, low_bytes)
        return EliasFano(n, low_bytes, low, blocks, EliasFano._directory(blocks)), at + low.size + (-low.size % 8)


def _dump(values: np.ndarray) -> bytes:
    return struct.pack("<Q", len(values)) + values.tobytes() + b"\0" * (-values.nbytes % 8)


def _view(buffer, kind: str, at: int) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<Q", buffer, at)
    values = np.frombuffer(buffer, kind, n, at + 8)
    return values, at + 8 + values.nbytes + (-values.nbytes % 8)


#: Bits of the hashes of a word's contexts and of theirs, which need to differ only from the others under one node.
CONTEXT_BITS, FURTHER_BITS = 40, 32


class Values:
    """Numbers in 16 bits between two bounds."""

    def __init__(self, codes: np.ndarray, span: np.ndarray):
        self.codes, self.span = codes, span

    @staticmethod
    def of(values: np.ndarray) -> Values:
        span = np.array([values.min(), values.max()]) if len(values) else np.zeros(2)
        return Values(np.round((values - span[0]) / max(float(span[1] - span[0]), 1e-9) * 65535).astype(np.uint16), span)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Value at each place; nan at -1."""
        out = np.full(len(at), np.nan)
        known = at >= 0
        out[known] = self.span[0] + self.codes[at[known]] * (max(float(self.span[1] - self.span[0]), 1e-9) / 65535)
        return out

    def dump(self) -> bytes:
        return _dump(self.codes) + _dump(self.span)

    @staticmethod
    def view(buffer, at: int) -> tuple[Values, int]:
        codes, at = _view(buffer, "<u2", at)
        span, at = _view(buffer, "<f8", at)
        return Values(codes, span), at


class Level:
    """The children of each node of the level above: pointers to their places, and (parent, context) in one rising sequence,
    so that a parent's part of it is searched relative to the parent."""

    def __init__(self, bits: int, pointers: EliasFano, keys: EliasFano):
        self.bits, self.pointers, self.keys = bits, pointers, keys

    @staticmethod
    def of(parents: int, parent: np.ndarray, context: np.ndarray, bits: int) -> Level:
        """parent, context: sorted pairs of a node's number, of `parents`, and a hash of so many bits."""
        start = np.searchsorted(parent, np.arange(parents + 1))
        keys = (parent.astype(U64) << U64(bits)) | context.astype(U64)
        return Level(bits, EliasFano.of(start, max(1, len(parent)).bit_length()), EliasFano.of(keys, max(1, parents).bit_length() + bits))

    def find(self, parent: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Place of each child; -1 if there is none, or no parent (-1)."""
        out = np.full(len(parent), -1)
        for some in in_blocks(len(parent)):
            self._find(parent[some], context[some], out[some])
        return out

    def _find(self, parent: np.ndarray, context: np.ndarray, out: np.ndarray) -> None:
        known = np.flatnonzero(parent >= 0)
        if not len(known) or not self.keys.n:
            return
        node = parent[known]
        begin, end = self.pointers.get(node).astype(np.int64), self.pointers.get(node + 1).astype(np.int64)
        want = (node.astype(U64) << U64(self.bits)) | context[known].astype(U64)
        at = self.keys.successor(want, begin, end)
        inside = np.flatnonzero(at < end)
        hit = inside[self.keys.get(at[inside]) == want[inside]]
        out[known[hit]] = at[hit]

    def dump(self) -> bytes:
        return struct.pack("<Q", self.bits) + self.pointers.dump() + self.keys.dump()

    @staticmethod
    def view(buffer, at: int) -> tuple[Level, int]:
        (bits,) = struct.unpack_from("<Q", buffer, at)
        pointers, at = EliasFano.view(buffer, at + 8)
        keys, at = EliasFano.view(buffer, at)
        return Level(bits, pointers, keys), at


class Trie:
    """Words with their counts; under each the words before it, with two quantised values (with nothing before that, and
    the weight of this pair as a context); under each of those the words before that, with a value."""

    def __init__(self, words: EliasFano, counts: np.ndarray, second: Level, alone: Values, weight: Values, third: Level, value: Values):
        self.words, self.counts, self.second, self.alone, self.weight, self.third, self.value = words, counts, second, alone, weight, third, value

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each word; -1 if the trie lacks it."""
        if not self.words.n:
            return np.full(len(words), -1)
        at = np.minimum(self.words.successor(words), self.words.n - 1)
        return np.where(self.words.get(at) == words, at, -1)

    def dump(self) -> bytes:
        return b"".join(self._dumps())

    def _dumps(self) -> Iterator[bytes]:
        yield self.words.dump()
        yield _dump(self.counts)
        for x in (self.second, self.alone, self.weight, self.third, self.value):
            yield x.dump()

    def write(self, file: BinaryIO) -> None:
        """dump()'s bytes, without holding all of them."""
        for x in self._dumps():
            file.write(x)

    @staticmethod
    def view(buffer) -> Trie:
        """The trie in a buffer, without a copy of its levels."""
        words, at = EliasFano.view(buffer, 0)
        counts, at = _view(buffer, "<i8", at)
        second, at = Level.view(buffer, at)
        alone, at = Values.view(buffer, at)
        weight, at = Values.view(buffer, at)
        third, at = Level.view(buffer, at)
        value, at = Values.view(buffer, at)
        return Trie(words, counts, second, alone, weight, third, value)

    @staticmethod
    def open(path: str) -> Trie:
        """The trie in a file of dump()'s bytes, memory-mapped."""
        with open(path, "rb") as f:
            return Trie.view(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
