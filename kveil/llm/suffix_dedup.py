"""Suffix-array dedup: remove bytes covered by a string of ``length`` bytes that also starts in a smaller document.

1. Every window of ``length`` bytes has an anchor, the q-gram with the smallest hash in
   it; equal windows have equal anchors at equal places. A group of documents asks
   which of its anchors occur elsewhere with the same left or right context.
2. Text around such anchors (a run: all windows of one anchor) goes to the anchor's
   slice, equal runs of a group once, with their smallest document.
3. The slice sorts the suffixes of its distinct runs by bucket-pointer refinement:
   buckets of the first five bytes, refined by the bucket identifiers of later offsets;
   updated identifiers stand for twice the depth and are used again. Windows in one
   bucket are equal strings; the answer is the smallest document of each.
4. The group removes the windows whose string starts in a smaller document.

Anchors only choose what is compared; equality is decided by the sorted bytes. Null
text is empty. Rows of one id do not remove from each other; null ids count as larger
than all others and not as smaller than each other. Texts shorter than ``length`` stay.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import groups, words

LENGTH = 50
Q = 20
SLICE = 1 << 18  # arrays of eight bytes a place stay in the cache
CHUNK = 1 << 20
HEAD = 5  # bytes of the first buckets; with a place in a chunk they fit one number
# A key is 40 bits of the anchor's hash and 12 bits of either context.
HALF, SIDE, SIDES = np.uint64(32), np.uint64(12), np.uint64(24)
RESULT = "doc_id long, tkey long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from every position; the last Q - 1 positions are 0."""
    out = np.zeros(len(data), np.uint64)
    n = len(data) - Q + 1
    if n > 0:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()
        with np.errstate(over="ignore"):
            x = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x += eight[8 : n + 8]
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x += eight[Q - 8 : n + Q - 8]
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        out[:n] = x
    return out


def _context(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 12-bit hash of ``size`` (8 to 16) bytes from each position, which may lie outside ``data``."""
    padded = np.concatenate([np.zeros(64, np.uint8), data, np.zeros(64, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        return words.mix(eight[at + 64] * np.uint64(0x9E3779B97F4A7C15) + eight[at + 64 + size - 8]) >> np.uint64(52)


class Runs:
    """Runs of windows with one anchor in a slice of documents: windows ``first..last``, anchor at ``anchor``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.length = data, length
        n, wide = len(data), length - Q + 1
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        # The position in the low half makes the leftmost of equal grams the smallest.
        gram = grams(data)
        low = (gram >> HALF << HALF) | np.arange(n, dtype=np.uint64)
        done = 1
        while done < wide:
            step = min(done, wide - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        anchor = (low[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
        window = words.ranges(offsets[:-1], np.maximum(0, sizes - length + 1))
        anchor = anchor[window]
        if not len(window):
            return
        start = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
        stop = np.append(start[1:], len(window)) - 1
        self.first, self.last, self.anchor, self.doc = window[start], window[stop], anchor[start], doc[start]
        side = (length - Q + 1) // 2
        hashes = words.mix(gram[self.anchor])
        left = _context(data, self.anchor - side, side)
        right = _context(data, self.anchor + Q, side)
        self.key = (hashes >> SIDES << SIDES) | (left << SIDE) | right


def _parts(table: pa.Table, length: int):
    data, offsets = groups.texts(table)
    for i, j in words.slices(offsets, SLICE):
        yield i, Runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)


def _runs(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first byte, size and document of every run of a group, in order of position."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    offsets = groups.texts(table)[1]
    for i, r in _parts(table, length):
        if len(r.key):
            size = (r.last - r.first + length).astype(np.int32)
            found.append((r.key, r.first + offsets[i], size, (r.doc + i).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _ask_anchors(length: int, count: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [runs.key for _, runs in _parts(groups.in_order(table), length)]
        keys, times = np.unique(np.concatenate(parts), return_counts=True)
        order, border = groups.slice_order(keys >> SIDES, count)
        again = (times > 1).astype(np.uint8)
        return groups.blobs(table["grp"][0].as_py(), order, border, lambda p: keys[p].astype("<u8").tobytes(), lambda p: np.packbits(again[p]).tobytes())

    return groups.lean(run)


def _recurring(table: pa.Table) -> pa.Table:
    """Bit per anchor: it occurs again with the same left or right context."""
    bodies = groups.views(table["body"], "<u8")
    key = np.concatenate(bodies)
    found = np.concatenate([np.unpackbits(e, count=len(b)) for e, b in zip(groups.views(table["extra"], np.uint8), bodies)]).astype(bool)
    for part in (key >> SIDE, (key >> SIDES << SIDE) | (key & np.uint64(0xFFF))):
        order = np.argsort(part)
        same = part[order][1:] == part[order][:-1]
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
    ends = np.cumsum([len(b) for b in bodies])
    parts = [np.packbits(found[e - len(b) : e]).tobytes() for b, e in zip(bodies, ends)]
    return pa.table([table["grp"], table["slice"], pa.array(parts, pa.binary()), pa.array([None] * len(parts), pa.binary())], names=["grp", "slice", "body", "extra"])


def _gram_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every run; runs stand in order of position and are short."""
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE, "right")))
        own, ends = first[a:b] - first[a], first[a:b] - first[a] + size[a:b]
        sums = words.prefix_sums(data[first[a] : first[a] + ends.max()])
        out[a:b] = words.range_hashes(sums, own, ends)
        a = b
    return out


def _distinct(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each run's text among the distinct ones, and one run of each; equal hashes are compared byte by byte."""
    _, head, number = np.unique(_gram_hashes(data, first, size), return_index=True, return_inverse=True)
    other = np.flatnonzero(head[number] != np.arange(len(first)))
    wrong = []
    ends = np.append(0, np.cumsum(size[other], dtype=np.int64))
    a = 0
    while a < len(other):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        mine, like = other[a:b], head[number[other[a:b]]]
        same = size[mine] == size[like]
        mine, like = mine[same], like[same]
        differ = data[words.ranges(first[mine], size[mine])] != data[words.ranges(first[like], size[like])]
        wrong += [other[a:b][~same], np.unique(np.repeat(mine, size[mine])[differ])]
        a = b
    alone = np.concatenate(wrong) if wrong else other
    number[alone] = len(head) + np.arange(len(alone))  # a text that only shares its hash goes by itself
    return number.astype(np.int32), np.append(head, alone)


class Asked:
    """The recurring runs of a group: where each stands, which distinct text it is, and the slice of that."""

    def __init__(self, table: pa.Table, reply: pa.Table, length: int, count: int):
        key, first, size, doc = _runs(table, length)
        keys, inverse = np.unique(key, return_inverse=True)
        order, border = groups.slice_order(keys >> SIDES, count)
        flag = np.zeros(len(keys), bool)
        for s, body in zip(reply["slice"].to_pylist(), groups.views(reply["body"], np.uint8)):
            mine = order[border[s] : border[s + 1]]
            flag[mine] = np.unpackbits(body, count=len(mine)).astype(bool)
        chosen = flag[inverse]
        del keys, inverse, order, flag
        self.data = groups.texts(table)[0]
        self.doc, self.first, self.size = doc[chosen], first[chosen], size[chosen]
        self.run, self.head = _distinct(self.data, self.first, self.size)
        # The slice of a distinct run is the slice of its anchor.
        number = ((key[chosen] >> SIDES) % np.uint64(count)).astype(np.int32)[self.head]
        self.windows = self.size[self.head].astype(np.int64) - length + 1
        self.order = np.argsort(number, kind="stable")
        self.border = np.append(0, np.cumsum(np.bincount(number, minlength=count)))

    def bytes_of(self, runs: np.ndarray) -> bytes:
        """The texts of distinct runs, one after the other."""
        head = self.head[runs]
        return self.data[words.ranges(self.first[head], self.size[head])].tobytes()


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(int(groups.NO_ID)).to_numpy()


def _ask_runs(length: int, count: int):
    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        table = groups.in_order(table)
        asked = Asked(table, reply, length, count)
        lowest = np.full(len(asked.head), groups.NO_ID)
        np.minimum.at(lowest, asked.run, _ids(table)[asked.doc])

        def extra(p: np.ndarray) -> bytes:
            return asked.size[asked.head[p]].astype("<i8").tobytes() + lowest[p].astype("<i8").tobytes()

        return groups.blobs(table["grp"][0].as_py(), asked.order, asked.border, asked.bytes_of, extra)

    return groups.lean(run)


def _ranks(key: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``at`` in order of ``key``, and the rank of each one's key among the distinct ones.

    Key and position are sorted as one number, without an index, where ``bits`` of key leave room for the position.
    """
    low = int(at[-1]).bit_length() if len(at) else 0
    if bits + low <= 64:
        both = np.sort((key << np.uint64(low)) | at.astype(np.uint64))
        at = (both & np.uint64((1 << low) - 1)).astype(np.int64)
        both >>= np.uint64(low)
    else:
        order = np.argsort(key, kind="stable")
        at, both = at[order], key[order]
    turn = np.zeros(len(both), np.int64)
    turn[1:] = both[1:] != both[:-1]
    return at, np.cumsum(turn)


def suffix_buckets(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers by the first ``length`` bytes of every suffix that has as many, in suffix order; -1 for others.

    ``offsets`` bound the strings in ``data``. Bucket numbers of depth d give those of
    depth up to 2d: a bucket is refined by sorting its suffixes on the bucket of the
    suffix that starts later by the offset.
    """
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    depth, open_ = HEAD, np.flatnonzero(left >= HEAD)
    head = np.ndarray((len(data),), ">u8", padded, 0, (1,))[open_].astype(np.uint64) >> np.uint64(64 - 8 * HEAD)
    bits = 8 * HEAD
    while True:
        at, number = _ranks(head, open_, bits)
        bucket = np.full(len(data), -1, np.int64)
        bucket[at] = number
        if depth >= length or not len(at):
            return bucket
        offset = min(depth, length - depth)
        open_ = open_[left[open_] >= depth + offset]
        half = max(1, int(number[-1]).bit_length())
        # Later bucket as the low half of the sort key: sorting orders each bucket by it.
        head = (bucket[open_] << half | bucket[open_ + offset]).astype(np.uint64)
        bits, depth = 2 * half, depth + offset


def _lowest(length: int):
    def run(table: pa.Table) -> pa.Table:
        numbers = [e.reshape(2, -1) for e in groups.views(table["extra"], "<i8")]
        sizes, owner = np.concatenate([x[0] for x in numbers]), np.concatenate([x[1] for x in numbers])
        bounds = np.append(0, np.cumsum(sizes)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(groups.views(table["body"], np.uint8)))]).dictionary_encode()
        run_of, texts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        del coded
        lowest = np.full(len(texts), groups.NO_ID)
        np.minimum.at(lowest, run_of, owner)
        # Equal windows share their anchor's gram, so runs of one gram are sorted together, chunk by chunk.
        data, offsets = np.frombuffer(texts.buffers()[2], np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        gram = _anchor_grams(data, offsets, length)
        order = np.argsort(gram, kind="stable")
        windows = np.diff(offsets) - length + 1
        at = np.append(0, np.cumsum(windows))
        answer = np.empty(at[-1], np.int64)
        size = np.diff(offsets)[order]
        cut = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
        bytes_at = np.append(0, np.cumsum(size))
        begin = 0
        while begin < len(cut):
            end = max(begin + 1, int(np.searchsorted(bytes_at[cut], bytes_at[cut[begin]] + CHUNK, "right")) - 1)
            end = min(end, len(cut))
            mine = order[cut[begin] : cut[end] if end < len(cut) else len(order)]
            own_size = np.diff(offsets)[mine]
            body = data[words.ranges(offsets[mine], own_size)]
            own = np.append(0, np.cumsum(own_size))
            bucket = suffix_buckets(body, own, length)
            place = words.ranges(own[:-1], windows[mine])
            bucket = bucket[place]
            least = np.full(int(bucket.max()) + 1, groups.NO_ID)
            np.minimum.at(least, bucket, np.repeat(lowest[mine], windows[mine]))
            answer[words.ranges(at[:-1][mine], windows[mine])] = least[bucket]
            begin = end
        parts, ends = [], np.cumsum([x.shape[1] for x in numbers])
        for x, e in zip(numbers, ends):
            mine = run_of[e - x.shape[1] : e]
            parts.append(answer[words.ranges(at[:-1][mine], windows[mine])].astype("<i8").tobytes())
        return pa.table([table["grp"], table["slice"], pa.array(parts, pa.binary()), pa.array([None] * len(parts), pa.binary())], names=["grp", "slice", "body", "extra"])

    return groups.lean(run)


def _anchor_grams(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """The compared half of the hash of each run's anchor: the smallest in its first window."""
    out = np.empty(len(offsets) - 1, np.uint32)
    for i in range(0, len(out), 1 << 13):
        own = offsets[i : i + (1 << 13) + 1]
        gram = (grams(data[own[0] : own[-1]]) >> HALF).astype(np.uint32)
        at = (own[:-1] - own[0])[:, None] + np.arange(length - Q + 1)
        out[i : i + (1 << 13)] = gram[at].min(axis=1)
    return out


def _gone(asked: Asked, lowest: np.ndarray, at: np.ndarray, ids: np.ndarray, span: tuple[int, int], length: int) -> np.ndarray:
    """Flags of the bytes to remove between two positions of the group; runs stand in order of position."""
    a, b = np.searchsorted(asked.first, span)
    run = asked.run[a:b]
    many = asked.windows[run]
    hit = lowest[words.ranges(at[:-1][run], many)] < np.repeat(ids[asked.doc[a:b]], many)
    window = words.ranges(asked.first[a:b], many)[hit] - span[0]
    edge = np.zeros(span[1] - span[0] + 1, np.int32)
    edge[window] += 1  # no window stands in two runs
    edge[window + length] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _remove(length: int, count: int, with_text: bool, carry: list[str]):
    def run(table: pa.Table, anchors: pa.Table, reply: pa.Table) -> pa.Table:
        table = groups.in_order(table)
        asked = Asked(table, anchors, length, count)
        data, offsets = groups.texts(table)
        at = np.append(0, np.cumsum(asked.windows))
        lowest = np.empty(at[-1], np.int64)
        for s, body in zip(reply["slice"].to_pylist(), groups.views(reply["body"], "<i8")):
            mine = asked.order[asked.border[s] : asked.border[s + 1]]
            lowest[words.ranges(at[:-1][mine], asked.windows[mine])] = body
        ids = _ids(table)
        sums, digests, kept = [np.zeros((2, 0), np.int64)], [], []
        for i, j in words.slices(offsets, SLICE):
            own = offsets[i : j + 1] - offsets[i]
            gone = _gone(asked, lowest, at, ids, (offsets[i], offsets[j]), length)
            turn = gone.copy()
            turn[1:] &= ~gone[:-1]
            starts = own[:-1][own[:-1] < len(gone)]
            turn[starts] = gone[starts]
            total = [np.append(0, np.cumsum(x, dtype=np.int32)) for x in (gone, turn)]
            sums.append(np.stack([np.diff(t[own]) for t in total]).astype(np.int64))
            part = data[offsets[i] : offsets[j]]
            for a, b in zip(own[:-1].tolist(), own[1:].tolist()):
                rest = part[a:b] if total[0][a] == total[0][b] else part[a:b][~gone[a:b]]
                if with_text:
                    kept.append(rest.tobytes().decode("utf-8", "ignore"))
                digests.append(hashlib.sha256(rest).hexdigest())
        removed, spans = np.concatenate(sums, axis=1)
        columns = [
            table["doc_id"], table["tkey"], pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(digests, pa.string()),
        ]
        names = ["doc_id", "tkey", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept"]
        return pa.table([*columns, *(table[c] for c in carry)], names=[*names, *carry])

    return run


def dedup(
    docs: DataFrame, length: int = LENGTH, with_text: bool = False, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Counts and checksum of what is left of every row; ``with_text`` adds it as ``kept``, ``carry`` names columns to take along.

    Removal may cut a character; its stray bytes are dropped from ``kept``.
    """
    if length < Q + 16:
        raise ValueError(f"length must be at least {Q + 16}")
    parts = groups.group_count(docs, text)
    dealt, count = groups.grouped(docs, parts, doc_id, text, *carry), groups.slice_count(parts)
    own = dealt.groupBy("grp")
    asked = own.applyInArrow(_ask_anchors(length, count), groups.BLOB)
    anchors = asked.groupBy("slice").applyInArrow(groups.lean(_recurring), groups.BLOB)
    runs = own.cogroup(anchors.groupBy("grp")).applyInArrow(_ask_runs(length, count), groups.BLOB)
    lowest = runs.groupBy("slice").applyInArrow(_lowest(length), groups.BLOB)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(lowest.withColumn("kind", F.lit(1)))
    remove = _remove(length, count, with_text, list(carry))

    def last(table: pa.Table, reply: pa.Table) -> pa.Table:
        kind = reply["kind"].to_numpy()
        return remove(table, reply.filter(pa.array(kind == 0)), reply.filter(pa.array(kind == 1)))

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return own.cogroup(both.groupBy("grp")).applyInArrow(groups.lean(last), RESULT + (", kept string" if with_text else "") + extra)


def keep_first(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with what is left of their texts; ``n_chars``, if there, follows the text."""
    others = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    taken = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(a) for c, a in others.items()])
    left = dedup(taken, length, with_text=True, carry=tuple(others.values()))
    values = {"text": F.col("kept"), "doc_id": F.col("doc_id"), **{c: F.col(a) for c, a in others.items()}}
    if "n_chars" in others:
        values["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*[values[c].alias(c) for c in docs.columns])
