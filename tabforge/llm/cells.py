"""Counting cells and bit filters of a fixed size, filled by Spark tasks.

A hash falls into one of ``2**bits`` cells. Every task fills its own cells and
sends them on in blocks, blocks are added up by range of cells, and the driver
gets one array whose size the parameter alone decides. Such arrays only order or
thin out work; what they let through is always looked at exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SCHEMA = "block int, cells binary"
_PER_BLOCK = 1 << 13
#: Ranges of hashes that are sorted on their own, the bits within one, and the hashes a task holds back.
_RANGES, _LOW_BITS, _AT_ONCE = 1 << 10, 26, 1 << 22
#: The first bits by which hashes meet.
_MET_BITS = 10 + _LOW_BITS


def _emit(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in range(0, len(cells), _PER_BLOCK):
        part = cells[block : block + _PER_BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block // _PER_BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                ["block", "cells"],
            )


def _merged(sent: str, dtype: str, either: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(cells, dtype=sent).astype(dtype)
                if block not in sums:
                    sums[block] = part
                elif either:
                    sums[block] |= part
                else:
                    sums[block] += part
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                ["block", "cells"],
            )

    return merge


def _gather(blocks: DataFrame, size: int, sent: str, dtype: str, either: bool) -> np.ndarray:
    out = np.zeros(size, dtype=dtype)
    merged = blocks.repartition("block").mapInArrow(_merged(sent, dtype, either), _SCHEMA)
    for row in merged.collect():  # at most the size of the array
        part = np.frombuffer(row.cells, dtype=dtype)
        out[row.block * _PER_BLOCK : row.block * _PER_BLOCK + len(part)] = part
    return out


def cell_counts(
    df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int
) -> np.ndarray:
    """How many hashes fall into each cell (int64), over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            for found in hashes(batch):
                at, n = np.unique(cell_of(found, bits), return_counts=True)
                cells[at] += n.astype(np.int32)
        yield from _emit(cells)

    return _gather(df.mapInArrow(count, _SCHEMA), 1 << bits, "int32", "int64", False)


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter that knows every value of a long column (uint8, ``2**bits`` bits)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            values = np.asarray(batch.column(0), dtype=np.int64).view(np.uint64)
            cells[cell_of(values, bits)] = True
        yield from _emit(np.packbits(cells, bitorder="little"))

    return _gather(df.select(column).mapInArrow(mark, _SCHEMA), 1 << (bits - 3), "uint8", "uint8", True)


def twice_filter(
    df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int
) -> np.ndarray:
    """A filter that knows every hash found twice or more over all rows (uint8, ``2**bits`` bits).

    Hashes meet by their first ``_MET_BITS`` bits, so that among 10**10 different ones few
    seem to be held twice. They are sorted and sent on as distances of two bytes each, the
    few longer ones with what is above.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for found in chain(hashes(batches), [None]):
            if found is not None:
                held.append(found >> np.uint64(64 - _MET_BITS))
                n += len(found)
            if not n or (found is not None and n < _AT_ONCE):
                continue
            values = np.sort(np.concatenate(held))
            cuts = np.searchsorted(values, np.arange(_RANGES + 1, dtype=np.uint64) << _LOW_BITS)
            values = (values & np.uint64((1 << _LOW_BITS) - 1)).astype(np.uint32)
            parts = [np.diff(values[a:b], prepend=np.uint32(0)) for a, b in zip(cuts[:-1], cuts[1:])]
            some = [k for k, part in enumerate(parts) if len(part)]
            over = [np.flatnonzero(parts[k] >> np.uint32(16)).astype(np.uint32) for k in some]
            wide = [4 * len(o) > len(parts[k]) for k, o in zip(some, over)]
            sent = [parts[k] if w else parts[k].astype(np.uint16) for k, w in zip(some, wide)]
            above = [o[:0] if w else np.concatenate([o, parts[k][o] >> np.uint32(16)]) for k, o, w in zip(some, over, wide)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([x.dtype.itemsize for x in sent], pa.int32()),
                 pa.array([x.tobytes() for x in sent], pa.binary()), pa.array([x.tobytes() for x in above], pa.binary())],
                ["block", "bytes", "steps", "above"],
            )
            held, n = [], 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for block, *sent in zip(*(batch.column(k).to_pylist() for k in range(4))):
                parts.setdefault(block, []).append(sent)
        for block, sent in parts.items():
            values = np.sort(np.concatenate([_summed(*steps) for steps in sent]))
            cells = np.zeros(1 << (bits - 10), dtype=bool)
            cells[values[1:][values[1:] == values[:-1]] >> np.uint32(_MET_BITS - bits)] = True
            if cells.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())],
                    ["block", "cells"],
                )

    out = np.zeros((_RANGES, 1 << (bits - 13)), dtype=np.uint8)
    met = df.mapInArrow(send, "block int, bytes int, steps binary, above binary").repartition("block").mapInArrow(meet, _SCHEMA)
    for row in met.collect():  # at most the size of the array
        out[row.block] = np.frombuffer(row.cells, dtype=np.uint8)
    return out.ravel()


def _summed(n: int, steps: bytes, above: bytes) -> np.ndarray:
    """The sorted values from their distances of n bytes; ``above`` has places and higher parts of longer ones."""
    steps = np.frombuffer(steps, dtype=f"u{n}").astype(np.uint32)
    places, high = np.frombuffer(above, dtype=np.uint32).reshape(2, -1)
    steps[places] |= high << np.uint32(16)
    return np.cumsum(steps, dtype=np.uint32)


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def may_hold(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that are surely absent."""
    bits = int(len(filter_bits)).bit_length() + 2
    cell = cell_of(hashes, bits)
    return (filter_bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
