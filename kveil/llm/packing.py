"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document of ids is cut at multiples of the capacity. Full pieces are sequences of
their own; the rest pieces are dealt to random groups of bounded expected size, and
each group is packed alone. Null text is empty and holds only the end id; repeated rows
and null ids are packed like any others; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import groups, tokens, words
from kveil.session import reliable_checkpoint

CAPACITY = 1024
GROUP_PIECES = 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Bins:
    """Tournament tree: each inner node holds the largest free capacity below it."""

    def __init__(self, count: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, count))))
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, size: int) -> tuple[int, int]:
        """Place ``size`` in the first bin with room; its number and the fill before."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        fill = self.capacity - tree[node]
        tree[node] -= size
        bin_number = node - self.leaves
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return bin_number, fill


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size, each at most ``capacity``."""
    bins, where, offset = Bins(len(sizes), capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        where[i], offset[i] = bins.put(int(sizes[i]))
    return where, offset


def _cut(path: str, end_id: int, leading_space: bool, capacity: int, with_ids: bool, batch_bytes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from groups.released(cut(batches))
        if batch_bytes:
            tokens.forget()
            groups.release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path, leading_space)
        for batch in batches:
            data, offsets = words.flat(batch.column(1))
            doc_ids = batch.column(0)
            for i, j in words.slices(offsets, batch_bytes or tokens.BATCH_BYTES):
                got = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                total = np.diff(got.ptr)
                count = -(-total // capacity)
                row = np.repeat(np.arange(j - i), count)
                start = words.ranges(np.zeros(j - i, np.int64), count) * capacity
                length = np.minimum(capacity, total[row] - start)
                at = got.ptr[row] + start
                ids = got.ids.astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(at, at + length)]
                columns = [doc_ids.take(pa.array(i + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(got.ids)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return run


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, leading_space: bool, capacity: int = CAPACITY, with_ids: bool = False,
    doc_id: str = "doc_id", text: str = "text", batch_bytes: int | None = None,
) -> DataFrame:
    """Token pieces of at most ``capacity`` ids; ``with_ids`` keeps the ids themselves.

    With ``batch_bytes`` a worker encodes so much text at a time and keeps nothing between
    tasks: slower, for jobs in which other stages need its memory.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, leading_space, capacity, with_ids, batch_bytes), PIECE + (", ids array<int>" if with_ids else ""))


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["_id"].to_numpy(), kind="stable")  # rows of a group arrive in any order
        table = table.take(pa.array(order))
        where, offset = first_fit_decreasing(table["length"].to_numpy(), capacity)
        group = table["_group"].to_numpy()
        return table.drop_columns(["_id", "_group"]).append_column("sequence_id", pa.array(((group << 32) + where) * 2 + 1)).append_column(
            "offset", pa.array(offset)
        )

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 2024) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``.

    The pieces are written once, so that their numbers, which choose the groups, stay
    the same whatever is recomputed.
    """
    stored = reliable_checkpoint(cut).withColumn("_id", F.monotonically_increasing_id())
    full, rest = F.col("length") == capacity, F.col("length") < capacity
    count = max(1, -(-stored.where(rest).count() // group_pieces))
    dealt = stored.where(rest).withColumn("_group", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(count)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    alone = stored.where(full).select(*cut.columns, (F.col("_id") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(dealt.groupBy("_group").applyInArrow(_pack(capacity), schema))
