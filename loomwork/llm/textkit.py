"""Numpy kernels over the bytes of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
_PRIME = 0x9E3779B97F4A7C15
#: The longest spans of values that a polynomial hashes.
SHORT = 64


#: What empties the caches that Python workers keep from task to task.
CACHES: list[Callable[[], None]] = []


def tidy(run, keeps: bool = False):
    """run, a function over batches of a task, that leaves no memory behind: workers serve many stages.

    Other stages' caches are emptied first (unless run keeps its own), and what was freed goes back to the system at the end.
    """

    def tidied(batches):
        if not keeps:
            for empty in CACHES:
                empty()
            given_back()
        yield from run(batches)
        given_back()

    return tidied


def given_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and bytes of text (or of one row), so that memory is bounded by the longest text."""
    column = batch.column(text)
    ends = np.cumsum(np.diff(_offsets(column)), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = min(max(first + 1, int(np.searchsorted(ends, base + most, side="right"))), first + rows)
        yield batch.slice(first, last - first)
        first = last


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)[column.offset :] if len(column) else np.zeros(1, kind)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (and the last ends); null: empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    offsets = _offsets(column).astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (a finaliser of public hash functions)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_PRIME ** i and its inverse ** i modulo 2 ** 64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes wherever they stand.

    values are 64-bit hashes. A polynomial serves spans of up to SHORT values; on longer ones it would collide
    for regular sequences of two values (some 1,024 of them), so these are hashed as trees.
    """
    p, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    out = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        n = ends[long] - starts[long]
        out[long] = _trees(values[ranges(starts[long], n)], n, n)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(_PRIME) + b)


def _trees(leaves: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of counts leaves (all runs one after the other; an empty run: that of nothing) and of its size: neighbours are joined pair by pair until one is left."""
    out = np.zeros(len(counts), dtype=np.uint64)
    todo = np.flatnonzero(counts > 0)
    n = counts[todo]
    while len(todo):
        first = np.cumsum(n) - n
        done = n == 1
        out[todo[done]] = leaves[first[done]]
        todo, n, first = todo[~done], n[~done], first[~done]
        if not len(todo):
            break
        half = (n + 1) // 2
        within = ranges(np.zeros(len(n), np.int64), half)
        left = np.repeat(first, half) + 2 * within
        pair = 2 * within + 1 < np.repeat(n, half)
        above = leaves[left]
        above[pair] = _joined(above[pair], leaves[left[pair] + 1])
        leaves, n = above, half
    return mixed(out + mixed(sizes.astype(np.uint64) + np.uint64(_PRIME)))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span of bytes: its blocks of 8 bytes, joined as a tree."""
    size = ends - starts
    blocks = (size + 7) // 8
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each byte on
    within = ranges(np.zeros(len(size), np.int64), blocks)
    values = eights[np.repeat(starts, blocks) + 8 * within]
    left = np.repeat(size, blocks) - 8 * within
    tail = left < 8
    values[tail] &= (np.uint64(1) << (8 * left[tail]).astype(np.uint64)) - np.uint64(1)
    return _trees(mixed(values + np.uint64(_PRIME)), blocks, size)


def spans(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every run of bytes that between doesn't hold, within the texts that offsets part."""
    space = between[buf]
    ink = ~space
    before, after = np.empty_like(space), np.empty_like(space)
    if len(buf):
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]
        before[inner], after[inner - 1] = True, True
    return np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buf, start, end of every word in buf, first word of each text and the number of all words)."""
    buf, offsets = raw(column)
    starts, ends = spans(buf, offsets)
    return buf, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the number of all words)."""
    buf, starts, ends, first = words(column)
    return byte_hashes(buf, starts, ends), first


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """arange(start, start + length) of all, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def runs(n: np.ndarray, width: int) -> np.ndarray:
    """The number of windows of so many among n."""
    return np.maximum(n - width + 1, 0)
