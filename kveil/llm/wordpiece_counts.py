"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. A node's failure link leads to the node that
the rest of its string reaches after the longest pieces at its front are taken off, and
the number of those pieces is stored, so a word is read once, byte by byte, and only
counts are added: no piece is ever built. All distinct words of a batch step through the
automaton together.

Words are runs without white space. A word that the vocabulary cannot cover counts as
one unknown token. Null and wordless texts have no token; null ids and repeated rows are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import words

RESULT = "doc_id long, n_words long, n_tokens long, n_unknown long"


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Arrays of the trie: sorted edges, failure links, pieces taken off, and pieces up to a word's end (-1: none)."""

    def __init__(self, pieces: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        accepts = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in child[node]:
                    child[node][byte] = len(child)
                    child.append({})
                    accepts.append(False)
                node = child[node][byte]
            accepts[node] = node != 0
        n = len(child)
        fail, taken, finish = [-1] * n, [0] * n, [-1] * n
        finish[0] = 0
        level = [(0, byte, node) for byte, node in child[0].items()]
        while level:
            below = []
            for parent, byte, node in level:
                if accepts[node]:
                    fail[node], taken[node] = 0, 1
                else:
                    at, count = fail[parent], taken[parent]
                    while at >= 0 and byte not in child[at]:
                        count += taken[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], taken[node] = child[at][byte], count
                if fail[node] >= 0 and finish[fail[node]] >= 0:
                    finish[node] = taken[node] + finish[fail[node]]
                below += [(node, b, c) for b, c in child[node].items()]
            level = below
        edges = sorted((node * 256 + byte, to) for node, out in enumerate(child) for byte, to in out.items())
        self.key = np.array([k for k, _ in edges] or [-1], np.int64)
        self.to = np.array([t for _, t in edges] or [0], np.int64)
        self.fail, self.taken, self.finish = (np.array(x, np.int64) for x in (fail, taken, finish))

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pieces of every word, -1 if it has no cover."""
        n = len(bounds) - 1
        size = np.diff(bounds)
        out, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(-size, kind="stable")
        longest = size[order]
        for step in range(int(size.max(initial=0))):
            live = order[: np.searchsorted(-longest, -step, "left")]
            live = live[state[live] >= 0]
            byte = data[bounds[live] + step]
            while len(live):
                key = state[live] * 256 + byte
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[at] == key
                state[live[hit]] = self.to[at[hit]]
                live, byte = live[~hit], byte[~hit]
                # No edge: take the pieces off, follow the link and try again; the root has no link.
                out[live] += self.taken[state[live]]
                state[live] = self.fail[state[live]]
                dead = state[live] < 0
                live, byte = live[~dead], byte[~dead]
        ended = state >= 0
        rest = np.where(ended, self.finish[np.maximum(state, 0)], -1)
        return np.where(rest >= 0, out + rest, -1)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            data, offsets = words.flat(batch.column(1))
            out = [np.zeros((3, 0), np.int64)]
            for i, j in words.slices(offsets):
                part = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)
                codes, distinct = part.codes()
                if len(distinct):
                    bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
                    count = automaton.counts(np.frombuffer(distinct.buffers()[2], np.uint8), bounds)[codes]
                else:
                    count = np.zeros(0, np.int64)
                sums = [np.append(0, np.cumsum(x)) for x in (np.abs(count), count < 0)]
                out.append(np.stack([np.diff(part.ptr), *(s[part.ptr[1:]] - s[part.ptr[:-1]] for s in sums)]))
            total = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, total)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, pieces: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, tokens and unknown words of every text; ``pieces`` is a vocabulary file's list, of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_count(shared), RESULT)
