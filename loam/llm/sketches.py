"""Counters and filters of a fixed size over all rows, merged in two steps so that no task gathers them from every task."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import U64, mix

_PART = 1 << 16
_SECOND = 0xD6E8FEB86659FD93


def _merged(parts: DataFrame, size: int, kind: str, join: Callable) -> np.ndarray:
    """parts: part int, lot int, data binary (compressed). One array of `size` entries out of the parts of all tasks."""

    def once(table: pa.Table) -> pa.Table:
        total = None
        for blob in table["data"]:
            values = np.frombuffer(zlib.decompress(blob.as_py()), kind)
            total = values.copy() if total is None else join(total, values)
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "lot": pa.array([0], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "part int, lot int, data binary"
    twice = parts.groupBy("part", "lot").applyInArrow(once, schema).groupBy("part").applyInArrow(once, schema)
    out = np.zeros(size, kind)
    for r in twice.collect():
        values = np.frombuffer(zlib.decompress(bytes(r.data)), kind)
        out[r.part * _PART : r.part * _PART + len(values)] = values
    return out


def _cut(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    lot = context.partitionId() // 64 if context else 0
    for part, begin in enumerate(range(0, len(values), _PART)):
        piece = values[begin : begin + _PART]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lot], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], ["part", "lot", "data"])


def counts(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], width: int) -> np.ndarray:
    """How often each of `width` (a power of 2) classes of hashes occurs; counts end at 65535."""
    shift = U64(64 - width.bit_length() + 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for batch in batches:
            for code in hashes(batch):
                total += np.bincount((code >> shift).astype(np.int64), minlength=width).astype(np.uint32) if len(code) > width // 8 else _few(code >> shift, width)
        yield from _cut(np.minimum(total, 65535).astype(np.uint16))

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint32) + b, 65535).astype(np.uint16)

    return _merged(rows.mapInArrow(counted, "part int, lot int, data binary"), width, "uint16", join)


def _few(bucket: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, np.uint32)
    at, n = np.unique(bucket.astype(np.int64), return_counts=True)
    out[at] = n
    return out


def rank_of(sketch: np.ndarray, code: np.ndarray) -> np.ndarray:
    return sketch[(code >> U64(64 - len(sketch).bit_length() + 1)).astype(np.int64)]


class Filter:
    """A Bloom filter of 64-bit integers with two bits each: it never denies what it holds."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(code: np.ndarray, size: int) -> list[np.ndarray]:
        code = np.asarray(code).astype(np.int64).view(U64)
        shift = U64(64 - size.bit_length() + 1)
        return [(mix(code) >> shift).astype(np.int64), (mix(code ^ U64(_SECOND)) >> shift).astype(np.int64)]

    def has(self, code: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8
        out = np.ones(len(code), bool)
        for at in self._places(code, size):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    @staticmethod
    def of(rows: DataFrame, column: str, most_bits: int = 1 << 28) -> Filter:
        """The filter of a long column: about 16 bits a row, at most most_bits (32 MB), beyond which it lets more through."""
        n = rows.count()
        size = min(most_bits, max(1 << 14, 1 << (16 * n).bit_length()))

        def set_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                code = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                for at in Filter._places(code, size):
                    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            yield from _cut(bits)

        parts = rows.select(column).mapInArrow(set_, "part int, lot int, data binary")
        return Filter(_merged(parts, size // 8, "uint8", np.bitwise_or))
