"""Removing rows by key, with a broadcast only after its size is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.session import reliable_checkpoint

BROADCAST_KEYS = 1_000_000


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """Key of a row by its id and the hash of its text; equal for repeated rows only."""
    return F.xxhash64(doc_id.cast("long"), text_hash)


def bounded(keys: DataFrame) -> tuple[DataFrame, int]:
    """Narrow keys, stored; with a broadcast hint if they are few enough."""
    stored = reliable_checkpoint(keys)
    count = stored.count()
    return (F.broadcast(stored) if count <= BROADCAST_KEYS else stored), count


def without(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the single column of ``keys``."""
    small, count = bounded(keys.toDF("_gone").distinct())
    if not count:
        return docs
    rows = docs.select(F.struct("*").alias("doc"), key.alias("_key"))
    return rows.join(small, F.col("_key") == F.col("_gone"), "left_anti").select("doc.*")
