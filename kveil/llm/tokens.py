"""Token ids by the tokenizers library, with every distinct piece encoded once per batch.

A text is cut where the tokenizer's own splitter always cuts, so its ids are the ids of
the pieces in order. Cuts stand at ASCII white space and, in plain words (ASCII without
apostrophes, and Latin-1 letters), between letters and other characters. Pieces that
hold anything else stay whole up to the next white space and go through the library as
they are. ``leading_space`` tells whether a space belongs to the following piece (byte
level BPE) or is dropped (word BPE).

These cuts hold for two kinds of tokenizer files (``KNOWN``). A file with another
normaliser, splitter or kind of added token is noticed when it is loaded, and its texts
go through the library whole.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa

MEMO_ENTRIES = 120_000
# The normaliser and splitter that the cuts follow, with and without leading spaces.
KNOWN = {
    True: (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        ]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
}
BATCH_BYTES = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTER[0x80:] = True


class Encoded(NamedTuple):
    """Ids of all texts; text ``i`` owns ``ids[ptr[i]:ptr[i + 1]]``."""

    ids: np.ndarray
    ptr: np.ndarray


@functools.lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def is_known(tokenizer, leading_space: bool) -> bool:
    """Whether the cuts made here are those of the tokenizer file."""
    def parts(component):
        return None if component is None else json.loads(component.__getstate__())

    special = all(t.special for t in tokenizer.get_added_tokens_decoder().values())
    plain_model = type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout and not tokenizer.model.byte_fallback
    return special and plain_model and (parts(tokenizer.normalizer), parts(tokenizer.pre_tokenizer)) == KNOWN[leading_space]


def _complex_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that stay whole, and those of them that may begin or end in a white space beyond ASCII."""
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    far = (data < 0x20) & ~_SPACE[data] | (data == 0x7F) | (data >= 0x80) & ~lead & ~after
    odd = far | (data == 0x27) | after & ((data == 0x97) | (data == 0xB7))
    return _any(odd, start, end), _any(far, start, end)


def _any(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total[end] > total[start]


def _cuts(data: np.ndarray, offsets: np.ndarray, leading_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    odd, far = _complex_words(data, start, end)
    kind = _LETTER[data]
    turn = np.zeros(n, bool)
    turn[1:] = (kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1] & ~edge[1:n]
    whole = np.zeros(n + 1, np.int32)
    whole[start[odd]] += 1
    whole[end[odd]] -= 1
    turn &= np.cumsum(whole[:-1]) == 0
    if not leading_space:
        begin = np.flatnonzero(first | turn)
        stop = np.flatnonzero(last | np.append(turn[1:], False)) + 1
        return begin, stop
    # White space is kept: the last blank of a run joins the word behind it.
    begins = turn | edge[:n]
    # Words that may touch another white space are not cut from their neighbours.
    begins = turn | edge[:n]
    one = start[~far & ~edge[start]]
    begins[one - 1] = True  # the last white space of a run stands alone, or leads the word if it is a blank
    begins[one[data[one - 1] != 0x20]] = True
    behind = end[~far]
    begins[behind[behind < n]] = True
    begin = np.flatnonzero(begins)
    return begin, np.append(begin[1:], n)


# Byte-level models spell bytes as characters: printable Latin-1 as itself, the others from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELL = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class Encoder:
    """Encodes Arrow batches. Pieces are remembered in two generations of bounded size, which changes no result."""

    def __init__(self, path: str, leading_space: bool):
        self.tokenizer, self.leading_space = _load(path), leading_space
        self.known = is_known(self.tokenizer, leading_space)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        """Plain words go straight to the library's merge model, all others through its whole pipeline."""
        if len(self.young) + len(pieces) > MEMO_ENTRIES:
            self.young, self.old = {}, self.young
        merge, others = self.tokenizer.model.tokenize, []
        for piece in pieces:
            if not self.known:
                others.append(piece)
                continue
            blank = piece[:1] == b" "
            if (piece[1:] if blank else piece).isalpha():  # ASCII letters
                spelled = piece.decode("ascii")
                spelled = (_SPELL[0x20] + spelled[1:] if blank else spelled) if self.leading_space else spelled.lower()
            elif _PLAIN(piece):
                word = piece if self.leading_space else piece.decode("utf-8").lower().encode("utf-8")
                spelled = word.decode("latin-1").translate(_SPELL)
            else:
                others.append(piece)
                continue
            self.young[piece] = array.array("i", [t.id for t in merge(spelled)]).tobytes()
        texts = [p.decode("utf-8") for p in others]
        for piece, got in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self.young[piece] = array.array("i", got.ids).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        found = [self.young.get(p) for p in pieces]
        lost = [i for i, f in enumerate(found) if f is None]
        known = {i: f for i in lost if (f := self.old.get(pieces[i])) is not None}
        self._learn([pieces[i] for i in lost if i not in known])
        for i in lost:
            found[i] = known[i] if i in known else self.young[pieces[i]]
        self.young.update((pieces[i], f) for i, f in known.items())
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> Encoded:
        """Ids of the texts in ``data``; ``end_id`` closes each text."""
        # Without known cuts every text is one piece.
        begin, stop = _cuts(data, offsets, self.leading_space) if self.known else (offsets[:-1], offsets[1:])
        sizes = stop - begin
        piece_ptr = np.searchsorted(begin, offsets) if self.known else np.arange(len(offsets))
        bounds = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        if self.leading_space or not self.known:
            body = data
        else:
            body = data[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], sizes)]
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))]
        ).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        found = self._ids(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), np.int32)
        at = np.cumsum(lengths) - lengths
        count = lengths[which]
        ends = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        ids = table[np.arange(ends[-1]) + np.repeat(at[which] - ends[:-1], count)]
        ptr = ends[piece_ptr]
        if end_id is not None:
            n = len(ptr) - 1
            closed = np.full(len(ids) + n, end_id, np.int32)
            keep = np.ones(len(closed), bool)
            ptr = ptr + np.arange(n + 1)
            keep[ptr[1:] - 1] = False
            closed[keep] = ids
            ids = closed
        return Encoded(ids, ptr)


@functools.lru_cache(maxsize=4)
def encoder(path: str, leading_space: bool) -> Encoder:
    """One encoder per worker process, so that its memo lives through all batches."""
    return Encoder(path, leading_space)



def forget() -> None:
    """Drop what a worker process keeps between tasks."""
    encoder.cache_clear()
    _load.cache_clear()
