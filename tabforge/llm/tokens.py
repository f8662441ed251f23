"""Words, shingles and counting cells for whole texts, vectorised over Arrow buffers.

Nothing here knows of Spark: these are the small helpers that tasks run on one
Arrow batch at a time. Words are byte spans of the UTF-8 text, so no string is
made per word. A word is identified by a 64-bit hash of its bytes and length; two
different words of one comparison share a hash with odds of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 21
LONG_WORD = 64

_LOW = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 8)] + [2**64 - 1], dtype=np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)
_M3 = np.uint64(0xC2B2AE3D27D4EB4F)
_S32 = np.uint64(32)
_S29 = np.uint64(29)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table over the 256 bytes, true outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
VISIBLE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Texts:
    """Neighbouring texts of a column in one byte buffer; ``bounds`` cuts them apart."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.bounds = first, bounds
        self.data = np.zeros(len(data) + 8, dtype=np.uint8)
        self.data[: len(data)] = data

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def used(self) -> np.ndarray:
        return self.data[:-8]

    def lower(self) -> Texts:
        self.data = LOWER[self.data]
        return self

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the maximal runs of bytes inside the set, text by text."""
        return runs(inside[self.used], self.bounds)

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """Where each text's spans begin among all of them; one entry more than texts."""
        return np.searchsorted(starts, self.bounds)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values that no bound cuts."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cuts = bounds[(bounds > 0) & (bounds < len(inside))]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts


def texts(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Cut a string column into blocks of whole texts; a null counts as empty.

    A block holds about ``block_bytes``, or a single longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        low, high = int(offsets[first]), int(offsets[last])
        yield Texts(first, data[low:high], offsets[first : last + 1] - low)
        first = last


def span_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; ``data`` carries eight bytes of padding at its end."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    lengths = lengths.astype(np.uint64)
    out = lengths * _M1
    if not len(starts):
        return out
    at, left, state = starts, lengths, out
    index = None
    eight = np.uint64(8)
    for step in range(0, LONG_WORD, 8):
        piece = words[at + step] & _LOW[np.minimum(left, eight)]
        state = (state ^ piece) * _M2
        state ^= state >> _S32
        if index is None:
            out = state
        else:
            out[index] = state
        more = np.flatnonzero(left > eight)
        if not len(more):
            break
        index = more if index is None else index[more]
        at, left, state = at[more], left[more] - eight, out[index]
    for k in np.flatnonzero(lengths > LONG_WORD):
        span = data[starts[k] : starts[k] + int(lengths[k])]
        out[k] = xxhash.xxh64_intdigest(span.tobytes())
    return mix(out)


def mix(value: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit word (a bijection)."""
    value = (value ^ (value >> _S32)) * _M2
    value = (value ^ (value >> _S29)) * _M3
    return value ^ (value >> _S32)


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring hashes, by the place where it starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    state = hashes[:n].copy()
    for k in range(1, width):
        state = (state * _M1) ^ hashes[k : k + n]
        state ^= state >> _S29
    return mix(state * _M3 + np.uint64(width))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - counts), counts)


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def unsigned(column) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def packed(parts: list[np.ndarray]) -> pa.Array:
    """Binary column of the parts' bytes, built without a Python object per byte."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([p.nbytes for p in parts], out=offsets[1:])
    flat = np.concatenate([np.ascontiguousarray(p).view(np.uint8).ravel() for p in parts]) if parts else np.zeros(0, np.uint8)
    made = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
    )
    return made.cast(pa.binary())


def unpacked(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in one array, and where each row's values begin."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    flat = flat[offsets[0] : offsets[-1]].copy().view(dtype)
    return flat, (offsets - offsets[0]) // size
