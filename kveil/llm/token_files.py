"""Token ids in ORC files: stripes of run-length coded integers, row indexes and Bloom filters on ids.

Documents are range-partitioned and sorted by id, so the files of a folder follow each
other in id order, and readers may split them by stripe. Null text is empty and has
only the end id; null ids come first; repeated rows are kept, in an order fixed by
their text; an empty table gives files without rows. Other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kveil.llm import tokens, words

SCHEMA = "doc_id long, first long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode(path: str, end_id: int, leading_space: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, coder = 0, tokens.encoder(path, leading_space)
        for batch in batches:
            data, offsets = words.flat(batch.column(1))
            for i, j in words.slices(offsets, tokens.BATCH_BYTES):
                got = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(first + got.ptr[:-1]),
                        pa.array(np.diff(got.ptr)),
                        pa.ListArray.from_arrays(pa.array(got.ptr.astype(np.int32)), pa.array(got.ids)),
                    ],
                    names=["doc_id", "first", "n_tokens", "ids"],
                )
                first += int(got.ptr[-1])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, leading_space: bool, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text with ``end_id`` behind them; ``first`` counts the ids before it in its part."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")  # spreads and orders rows of one id
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    coded = ordered.mapInArrow(_encode(tokenizer, end_id, leading_space), SCHEMA)
    coded.write.mode("errorifexists").options(**ORC_OPTIONS).orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = spark.read.schema(SCHEMA).orc(folder).withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum("n_tokens").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per written part.
    before = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(before), "_part")
    return joined.select("doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents: stripes and row groups without them are skipped by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(folder).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].data) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """Replace ids by the CRC-32 of their little-endian 32-bit form."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
