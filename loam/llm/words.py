"""Words of many texts at once: boundaries and 64-bit hashes, computed on byte arrays.

A word's hash is a polynomial over its bytes, taken from one running sum over the whole buffer, so there is no
Python step per word. All hashes are functions of the bytes alone: they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Grown:
    """Powers of a base, made longer when a longer buffer comes."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            self.values = _powers(self.base, max(n, CHUNK + (1 << 16)))
        return self.values[:n]


_UP, _DOWN = _Grown(_BASE), _Grown(_INVERSE)


@dataclass(frozen=True)
class Rule:
    """Which bytes end a word, and whether A-Z become a-z first."""

    separator: np.ndarray
    lowered: np.ndarray

    @staticmethod
    def of(separators: Iterable[int], lower: bool) -> Rule:
        table = np.zeros(256, bool)
        table[list(separators)] = True
        low = np.arange(256, dtype=np.uint8)
        if lower:
            low[65:91] += 32
            table[65:91] = table[97:123]
        return Rule(table, low)


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Words [^\x20\x09-\x0D]+ as they are, and with A-Z lowered.
SPACED = Rule.of(_SPACES, lower=False)
SPACED_LOWER = Rule.of(_SPACES, lower=True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with A-Z lowered.
ALNUM_LOWER = Rule.of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], lower=True)


@dataclass
class Words:
    """Words of some texts. Text i has the words first[i] to first[i + 1]; ends are exclusive."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def word(self, k: int) -> bytes:
        return self.buffer[self.start[k] : self.end[k]].tobytes()


def words(texts: list[bytes], rule: Rule) -> Words:
    """Boundaries and hashes of the words of texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    apart = rule.separator[raw]
    low = rule.lowered[raw]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    value = _TABLE[low]
    value *= _UP.upto(len(raw))
    np.cumsum(value, out=value)
    code = value[end - 1] - value[start - 1]
    code *= _DOWN.upto(len(raw))[start]
    code = mix(code)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    return Words(low, start, end, np.searchsorted(start, at + 1), code)


def rolling(code: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries of code; none if there are fewer."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    value = np.zeros(len(code) + 1, U64)
    np.cumsum(code * _UP.upto(len(code)), out=value[1:])
    out = value[k:] - value[:-k]
    out *= _DOWN.upto(len(code))[:n]
    return mix(out)


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batch: pa.RecordBatch, column: str, most_bytes: int = CHUNK, most_rows: int = 1 << 30) -> Iterator[tuple[slice, list[bytes]]]:
    """Parts of a batch of about most_bytes of text each: rows and their texts. Only one part's texts are held at once."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    begin, n = 0, len(size)
    total = np.concatenate([[0], np.cumsum(size)])
    while begin < n:
        end = int(np.searchsorted(total, total[begin] + most_bytes))
        end = min(max(end, begin + 1), begin + most_rows, n)
        yield slice(begin, end), encoded(texts.slice(begin, end - begin))
        begin = end
    give_back()


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[slice, list[bytes]]]:
    return parts(batch, column)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what they keep adds up in an executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def per_text(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
