"""Vectorised word splitting and hashing of Arrow text batches, inside tasks.

Word classes are decided byte by byte: every class used here treats all bytes from 0x80
on alike, so UTF-8 needs no decoding. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LETTERS = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))  # after lower-casing
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_STEP ** i`` and its inverse modulo 2**64, for i up to ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 65536)
        _powers[:] = []
        for base in (_STEP, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers.append(np.cumprod(out, dtype=np.uint64))
    return _powers[0], _powers[1]


def forget() -> None:
    """Drop the powers."""
    _powers[:] = []


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` bytes, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the coded bytes before every place, for ``range_hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in every range; equal bytes have equal hashes in any batch."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


class Words:
    """The words of a run of texts: ``start``/``end`` in ``data``; text ``i`` owns words ``ptr[i]:ptr[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        flags = np.zeros(len(data) + 2, bool)
        flags[1:-1] = inside[self.data]
        here, before, after = flags[1:-1], flags[:-2], flags[2:]
        first, last = here & ~before, here & ~after
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        first[cuts] = here[cuts]
        cuts = offsets[1:][offsets[1:] > 0] - 1
        last[cuts] = here[cuts]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word; equal words have equal hashes in any batch."""
        return range_hashes(prefix_sums(self.data), self.start, self.end)

    def array(self) -> pa.Array:
        """The words as an Arrow array."""
        sizes = self.end - self.start
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        at = np.repeat(self.start - offsets[:-1], sizes) + np.arange(offsets[-1])
        body = self.data[at]
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number per word and the distinct words, by first occurrence."""
        if not len(self):
            return np.zeros(0, np.int32), pa.array([], pa.large_binary())
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    return Words(data, offsets, inside, lower)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start .. start + size - 1`` of every pair, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
