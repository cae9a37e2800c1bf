"""Periodic run detection: stretches of words that repeat with a period, found without comparing all lags at all places.

1. Recursive frequency splitting. A run of at least ``repeats`` periods holds each of its
   words that often, so a word that is rarer within its segment is in no run and splits
   the segment. The pieces are counted again until nothing changes; pieces shorter than
   ``shortest`` words go.
2. Lag scan of the segments that survive. A run of period p makes words p apart equal
   over a known least stretch, so it covers a whole aligned block of half that size. Only
   the blocks of each lag are compared, by prefix hashes; equal ones are stretched as far
   as the words agree. Blocks grow with the lag: m words take about m log m comparisons.
3. A stretch found at several lags is one run of the smallest of them. Every run is
   compared word by word; a segment in which a hash was wrong is scanned without hashes.

Rows are independent: no shuffle, and a hot key means nothing. Null and empty texts have
no words; repeated rows and ids give a row each; null ids stay null; other columns are
not read; an empty table gives an empty result. Memory follows one text or 2 MB of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import words

SHORTEST, REPEATS = 12, 2
# Splitting only saves work: what is not stable after so many rounds goes to the scan.
ROUNDS = 1000
CHECKS = 1 << 20
RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _starts(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, flags)) if len(flags) else np.zeros(1, np.int64)


def split_by_frequency(code: np.ndarray, ptr: np.ndarray, shortest: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the segments that can hold a run."""
    start, size = ptr[:-1].astype(np.int64), np.diff(ptr).astype(np.int64)
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    distinct = int(code.max()) + 1 if len(code) else 1
    for _ in range(ROUNDS):
        start, size = start[size >= shortest], size[size >= shortest]
        if not len(start):
            break
        place, owner = words.ranges(start, size), np.repeat(np.arange(len(start)), size)
        _, which, times = np.unique(owner * distinct + code[place], return_inverse=True, return_counts=True)
        common = times[which] >= repeats
        rare = np.bincount(owner, ~common, len(start)) > 0
        stable.append((start[~rare], size[~rare]))
        kept = common & rare[owner]
        place, owner = place[kept], owner[kept]
        if not len(place):
            start = size = np.zeros(0, np.int64)
            break
        cut = _starts((np.diff(place) != 1) | (np.diff(owner) != 0))
        start, size = place[cut], np.diff(np.append(cut, len(place)))
    stable.append((start, size))
    start, size = (np.concatenate(x) for x in zip(*stable))
    order = np.argsort(start)
    return start[order], size[order]


class Prefix:
    """Prefix hashes of a word sequence; equal words give equal hashes, the reverse is checked later."""

    def __init__(self, code: np.ndarray):
        self.up, _ = words.powers(len(code) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(words.mix(code.astype(np.uint64) + np.uint64(1)) * self.up[: len(code)], out=self.sums[1:])

    def same(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``at`` equal those ``lag`` later."""
        with np.errstate(over="ignore"):
            here = (self.sums[at + size] - self.sums[at]) * self.up[lag]
            return here == self.sums[at + lag + size] - self.sums[at + lag]

    def stretch(self, at: np.ndarray, lag: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``lag`` later, ``room`` at most."""
        done = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            open_ = np.flatnonzero(done + step <= room)
            begin = at[open_] - done[open_] - step if back else at[open_] + done[open_]
            done[open_[self.same(begin, lag[open_], np.full(len(open_), step))]] += step
            step >>= 1
        return done


def _lags(size: np.ndarray, shortest: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, lag, block size and number of blocks for every lag that a segment has room for."""
    many = size // repeats
    owner, lag = np.repeat(np.arange(len(size)), many), words.ranges(np.ones(len(size), np.int64), many)
    agree = np.maximum(shortest, repeats * lag) - lag
    fits = lag + agree <= size[owner]
    owner, lag = owner[fits], lag[fits]
    block = (agree[fits] + 1) // 2
    return owner, lag, block, (size[owner] - lag) // block


def scan(code: np.ndarray, start: np.ndarray, size: np.ndarray, shortest: int, repeats: int) -> np.ndarray:
    """Rows (segment, start, stop, lag) of the maximal stretches of each lag that are long enough."""
    found = [np.zeros((0, 4), np.int64)]
    if not len(start):
        return found[0]
    prefix = Prefix(code)
    owner, lag, block, count = _lags(size, shortest, repeats)
    total = np.append(0, np.cumsum(count))
    begin = 0
    while begin < len(lag):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + CHECKS, "right")) - 1)
        number = words.ranges(np.zeros(end - begin, np.int64), count[begin:end])
        mine = np.repeat(np.arange(begin, end), count[begin:end])
        at = start[owner[mine]] + number * block[mine]
        hit = prefix.same(at, lag[mine], block[mine])
        mine, number, at = mine[hit], number[hit], at[hit]
        begin = end
        if not len(mine):
            continue
        # Neighbouring blocks of one lag are parts of one stretch.
        cut = _starts((np.diff(mine) != 0) | (np.diff(number) != 1))
        last = np.append(cut[1:], len(mine)) - 1
        mine, first, stop = mine[cut], at[cut], at[last] + block[mine[last]]
        own, p = owner[mine], lag[mine]
        first = first - prefix.stretch(first, p, first - start[own], True)
        stop = stop + p + prefix.stretch(stop, p, start[own] + size[own] - stop - p, False)
        long_ = stop - first >= np.maximum(shortest, repeats * p)
        found.append(np.stack([own, first, stop, p], axis=1)[long_])
    return np.concatenate(found)


def scan_words(code: np.ndarray, start: int, size: int, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """The stretches of one segment by comparing words at every place of every lag."""
    own, out = code[start : start + size], []
    for p in range(1, size // repeats + 1):
        edge = np.diff(np.concatenate([[0], (own[:-p] == own[p:]).astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        long_ = b - a >= max(shortest, repeats * p)
        out += [(start + int(x), start + int(y), p) for x, y in zip(a[long_], b[long_])]
    return out


def _periods(code: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (segment, start, stop, smallest lag), and the segments in which a hash deceived."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1]))]
    new = _starts((np.diff(found[:, 1]) != 0) | (np.diff(found[:, 2]) != 0)) if len(found) else np.zeros(0, np.int64)
    runs = found[new]
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(found))))
    wrong = [found[found[:, 3] % runs[group, 3] != 0, 0]]
    ends = np.append(0, np.cumsum(runs[:, 2] - runs[:, 1] - runs[:, 3]))
    begin = 0
    while begin < len(runs):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CHECKS, "right")) - 1)
        part = runs[begin:end]
        many = part[:, 2] - part[:, 1] - part[:, 3]
        at, p = words.ranges(part[:, 1], many), np.repeat(part[:, 3], many)
        wrong.append(np.repeat(part[:, 0], many)[code[at] != code[at + p]])
        begin = end
    return runs, np.unique(np.concatenate(wrong))


def runs_of(code: np.ndarray, ptr: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, stop, period) of all runs in the texts ``code[ptr[i]:ptr[i + 1]]``, by start, then period."""
    start, size = split_by_frequency(code, ptr, shortest, repeats)
    runs, wrong = _periods(code, scan(code, start, size, shortest, repeats))
    if len(wrong):
        again = [(s, *r) for s in wrong.tolist() for r in scan_words(code, int(start[s]), int(size[s]), shortest, repeats)]
        again = _periods(code, np.array(again, np.int64).reshape(-1, 4))[0]
        runs = np.concatenate([runs[~np.isin(runs[:, 0], wrong)], again])
    return runs[np.lexsort((runs[:, 3], runs[:, 1])), 1:]


def _collapse(split: words.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    kept = np.append(0, np.cumsum(keep))[split.ptr]
    start, size = split.start[keep], (split.end - split.start)[keep]
    room = size + 1
    ends = kept[1:][np.diff(kept) > 0] - 1
    room[ends] -= 1  # no space behind the last word of a text
    to = np.append(0, np.cumsum(room))
    body = np.full(to[-1], 0x20, np.uint8)
    body[words.ranges(to[:-1], size)] = split.data[words.ranges(start, size)]
    offsets = to[kept].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _find(shortest: int, repeats: int):
    def part(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        split = words.split(data, offsets, lower=False)
        code, ptr = split.codes()[0].astype(np.int64), split.ptr
        runs = runs_of(code, ptr, shortest, repeats)
        edge = np.zeros(len(code) + 1, np.int32)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 1], -1)
        keep = np.cumsum(edge[:-1]) == 0
        text = np.searchsorted(ptr, runs[:, 0], "right") - 1
        each = pa.StructArray.from_arrays(
            [pa.array(runs[:, 0] - ptr[text]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"]
        )
        bounds = np.searchsorted(text, np.arange(len(ptr))).astype(np.int32)
        columns = [ids, pa.array(np.diff(ptr).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), each), _collapse(split, keep).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.flat(batch.column(1))
            for i, j in words.slices(offsets):
                yield part(batch.column(0).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    return run


def find(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without repeats of every row.

    A run is a maximal stretch of words with smallest period q and at least
    ``max(shortest, repeats * q)`` words. ``collapsed`` drops every word that a run holds
    after its first q words and joins the others by one space.
    """
    if shortest < 2 or repeats < 2:
        raise ValueError("a run needs at least two words and two periods")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_find(shortest, repeats), RESULT)


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and checksums of runs and collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    top = found.select("doc_id", "runs", "collapsed", longest.alias("top"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
