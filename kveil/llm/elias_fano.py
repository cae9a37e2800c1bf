"""Elias-Fano coding of monotone sequences, in arrays that can be memory-mapped."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np

SAMPLE = 4096
SPAN = 64  # blocks of SAMPLE values decoded together at most


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Low parts in whole bytes, high parts in unary, and the place of every SAMPLE-th one."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return {"low": np.zeros((0, 0), np.uint8), "high": np.zeros(0, np.uint8), "places": np.zeros(0, np.int64)}
    ratio = (int(values[-1]) + 1) // n
    width = min(7, -(-max(0, ratio.bit_length()) // 8))
    low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    place = (values >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(place[-1]) + 1, np.uint8)
    bits[place] = 1
    return {"low": low, "high": np.packbits(bits), "places": place[::SAMPLE]}


def decode(coded: dict[str, np.ndarray], begin: int, end: int) -> np.ndarray:
    """Values ``begin .. end - 1``."""
    low, high, places = coded["low"], coded["high"], coded["places"]
    if begin >= end:
        return np.zeros(0, np.uint64)
    first, last = begin // SAMPLE, -(-end // SAMPLE)
    start = int(places[first]) // 8
    stop = int(places[last]) // 8 + 1 if last < len(places) else len(high)
    ones = np.flatnonzero(np.unpackbits(np.asarray(high[start:stop]))) + start * 8
    skip = begin - first * SAMPLE + int(np.searchsorted(ones, places[first]))
    top = (ones[skip : skip + end - begin] - np.arange(begin, end)).astype(np.uint64)
    wide = np.zeros((end - begin, 8), np.uint8)
    wide[:, : low.shape[1]] = low[begin:end]
    return wide.view("<u8")[:, 0] | (top << np.uint64(8 * low.shape[1]))


def _spans(blocks: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Items i .. j - 1 of sorted block numbers, and the values a .. b - 1 that their blocks hold."""
    cuts = np.flatnonzero((np.diff(blocks) > 1) | (np.diff(blocks // SPAN) > 0)) + 1
    borders = [0, *cuts.tolist(), len(blocks)] if len(blocks) else []
    for i, j in zip(borders, borders[1:]):
        yield i, j, int(blocks[i]) * SAMPLE, min(n, (int(blocks[j - 1]) + 1) * SAMPLE)


def take(coded: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
    """Values at rising places; only their blocks are decoded."""
    out = np.zeros(len(index), np.uint64)
    for i, j, a, b in _spans(index // SAMPLE, len(coded["low"])):
        out[i:j] = decode(coded, a, b)[index[i:j] - a]
    return out


def find(coded: dict[str, np.ndarray], keys: np.ndarray, first_block: np.ndarray | None = None, last_block: np.ndarray | None = None) -> np.ndarray:
    """Place of each key in a rising sequence, searched in a range of blocks of its own; -1: not there.

    A range inside one block names it; for others the first values of the blocks are
    searched. Only blocks that a key can be in are decoded.
    """
    n, width, out = len(coded["low"]), coded["low"].shape[1], np.full(len(keys), -1)
    if not n or not len(keys):
        return out
    order = np.argsort(keys, kind="stable")
    key = keys[order].view(np.uint64)
    first = np.arange(0, n, SAMPLE)
    wide = np.zeros((len(first), 8), np.uint8)
    wide[:, :width] = coded["low"][first]
    heads = wide.view("<u8")[:, 0] | ((coded["places"] - first).astype(np.uint64) << np.uint64(8 * width))
    if first_block is None:
        block = np.maximum(np.searchsorted(heads, key, "right") - 1, 0).astype(np.int32)
    else:
        block = first_block[order]
        wider = np.flatnonzero((first_block < last_block)[order])
        block[wider] = np.clip(np.searchsorted(heads, key[wider], "right") - 1, block[wider], last_block[order[wider]])
    for i, j, a, b in _spans(block, n):
        values = decode(coded, a, b)
        at = np.minimum(np.searchsorted(values, key[i:j]), len(values) - 1)
        out[order[i:j]] = np.where(values[at] == key[i:j], a + at, -1)
    return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after the other, at multiples of 64, behind a header."""
    entries, at = [], 0
    for name, a in arrays.items():
        entries.append((name, a.dtype.str, a.shape, at))
        at += -(-a.nbytes // 64) * 64
    header = json.dumps(entries).encode()
    header = len(header).to_bytes(8, "little") + header
    parts = [header, b"\0" * (-len(header) % 64)]
    for a in arrays.values():
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 64)]
    return b"".join(parts)


def load(body: bytes) -> dict[str, np.ndarray]:
    """Map dumped arrays from a file of this task, which is unlinked at once and vanishes with the map."""
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(body)
    try:
        mapped = np.memmap(f.name, np.uint8, "r")
    finally:
        os.unlink(f.name)
    size = int.from_bytes(mapped[:8].tobytes(), "little")
    base = -(-(size + 8) // 64) * 64
    out = {}
    for name, kind, shape, at in json.loads(mapped[8 : 8 + size].tobytes()):
        count = int(np.prod(shape))
        out[name] = mapped[base + at : base + at + count * np.dtype(kind).itemsize].view(kind).reshape(shape)
    return out
