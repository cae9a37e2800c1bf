"""Question and answer between groups of documents and slices of a key space.

Documents are dealt to groups by a hash of id and text. A group asks about its distinct
keys, sorted and packed into one blob per slice; a slice sees the blobs of all groups,
and its answers, in the order of the questions, come back to the group. So a key that
fills a third of the corpus reaches its slice once per group, no text moves twice (the
exchange of the documents is reused), and both sides can be recomputed at any time.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import words

BLOB = "grp int, slice int, body binary, extra binary"
NO_ID = np.iinfo(np.int64).max

# A task holds one group's text and its working arrays. Small inputs still fill the session's partitions.
GROUP_BYTES, LEAST_BYTES = 12 << 20, 1 << 20
# Slices are smaller than groups, since a slice holds what all groups ask.
SLICES_PER_GROUP = 2


def group_count(docs: DataFrame, text: str = "text") -> int:
    """Groups of about ``GROUP_BYTES`` of text, whatever the session's settings; one pass over the text column."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // GROUP_BYTES), min(partitions, -(-size // LEAST_BYTES)))


def slice_count(groups: int) -> int:
    return SLICES_PER_GROUP * groups


def grouped(docs: DataFrame, count: int, doc_id: str = "doc_id", text: str = "text", *extra: str) -> DataFrame:
    """doc_id, text, tkey (a hash of the text) and grp, one of ``count``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *extra)
    keyed = rows.withColumn("tkey", F.xxhash64("text"))
    return keyed.withColumn("grp", F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(count)).cast("int"))


@functools.cache
def _trim():
    """The C library's call that gives free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: None


def lean(run: Callable) -> Callable:
    """A group function that leaves little behind in its worker, which lives on through later stages.

    What other operators keep between tasks goes before, freed memory goes back after.
    """

    def call(*tables: pa.Table) -> pa.Table:
        tokens = sys.modules.get("kveil.llm.tokens")
        if tokens is not None:
            tokens.forget()
        try:
            return run(*tables)
        finally:
            release()

    # Spark counts the parameters of a group function.
    if run.__code__.co_argcount == 1:
        return lambda table: call(table)
    return lambda table, other: call(table, other)


def release() -> None:
    """Drop tables that are quick to make again and give freed memory of this worker back to the machine."""
    words.forget()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(batches: Iterator) -> Iterator:
    """The batches of a task; its worker's memory goes back after the last."""
    try:
        yield from batches
    finally:
        release()


def views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """The binary values of a column as arrays, without copies."""
    return [np.frombuffer(b.as_buffer(), kind) for b in column]


def in_order(table: pa.Table) -> pa.Table:
    """Rows in a fixed order, since a shuffle delivers them in any."""
    ids = table["doc_id"].fill_null(int(NO_ID)).to_numpy()
    return table.take(pa.array(np.lexsort((table["tkey"].to_numpy(), ids))))


def pack48(keys: np.ndarray) -> bytes:
    """The upper 48 bits of 64-bit keys, six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack48(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def slice_order(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted ``keys`` by slice, and the border of every slice in it."""
    number = (keys % np.uint64(count)).astype(np.uint16 if count <= 1 << 16 else np.int64)  # short numbers sort by radix
    return np.argsort(number, kind="stable"), np.append(0, np.cumsum(np.bincount(number, minlength=count)))


def blobs(grp: int, order: np.ndarray, border: np.ndarray, pack: Callable, extra: Callable) -> pa.Table:
    """One row per slice that has keys."""
    slices = np.flatnonzero(np.diff(border))
    parts = [order[border[s] : border[s + 1]] for s in slices]
    return pa.table(
        [
            pa.array([grp] * len(slices), pa.int32()), pa.array(slices.astype(np.int32)),
            pa.array([pack(p) for p in parts], pa.binary()), pa.array([extra(p) for p in parts], pa.binary()),
        ],
        names=["grp", "slice", "body", "extra"],
    )


def answers(table: pa.Table, order: np.ndarray, border: np.ndarray, kind: str, width: int = 1) -> np.ndarray:
    """Answers of all slices put back to the order of the keys, ``width`` values each."""
    out = np.zeros((len(order), width), kind)
    for s, body in zip(table["slice"].to_pylist(), views(table["body"], kind)):
        out[order[border[s] : border[s + 1]]] = body.reshape(-1, width)
    return out if width > 1 else out[:, 0]


def texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return words.flat(table["text"])
