"""Tables of Parquet files in which single subjects can be changed or erased.

The files of a table are listed in its manifest, one small file that is replaced at once;
readers open what it lists. Files are sorted by the key and carry its statistics and Bloom
filters, so a change finds the few files that hold a subject by reading the key column
where those can not exclude it, copies them with the change made, and leaves all others.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kveil.sources.storage import exists, file_system, read_text, write_text

# A list of so many keys goes into the scan as a condition; more meet it in a join.
PUSHED_KEYS = 1000
FILE = "_metadata.file_path"


class KeyedTable:
    """A table below ``root``, kept in order of ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _manifest(self) -> dict:
        path = f"{self.root}/manifest.json"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else {"version": -1, "files": [], "schema": None}

    def _put(self, rows: DataFrame, version: int) -> list[str]:
        """Write rows as files of a version; their names below the root."""
        folder = f"{self.root}/v{version}"
        ordered = rows.repartitionByRange(self.key).sortWithinPartitions(self.key)
        ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)
        return [f"v{version}/{name}" for name in _names(self.spark.read.schema(rows.schema).parquet(folder))]

    def _commit(self, version: int, files: list[str], schema: str) -> None:
        write_text(self.spark, f"{self.root}/manifest.json", json.dumps({"version": version, "files": sorted(files), "schema": schema}))

    def write(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        old = self._manifest()
        version = old["version"] + 1
        self._commit(version, self._put(rows, version), rows.schema.json())
        self._delete(old["files"])

    def files(self) -> list[str]:
        return self._manifest()["files"]

    def read(self) -> DataFrame:
        return self._rows(self._manifest()["files"])

    def _rows(self, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self._manifest()["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])

    def holding(self, keys: DataFrame) -> list[str]:
        """The files that hold one of the keys (a single column)."""
        wanted = keys.toDF("_key").where("_key IS NOT NULL").distinct()
        few = [r[0] for r in wanted.limit(PUSHED_KEYS + 1).collect()]
        rows = self.read()
        if not rows.inputFiles() or not few:
            return []
        if len(few) <= PUSHED_KEYS:
            # In its own files the list also prunes row groups by statistics and Bloom filters.
            hits = rows.where(F.col(self.key).isin(few)).select(F.col(FILE).alias("_file"))
        else:
            hits = rows.select(F.col(FILE).alias("_file"), F.col(self.key).alias("_key")).join(wanted, "_key", "left_semi")
        found = {r[0].rsplit("/", 1)[1] for r in hits.select("_file").distinct().collect()}
        return [f for f in self.files() if f.rsplit("/", 1)[1] in found]

    def change(self, keys: DataFrame, how: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Copy the files that hold one of ``keys`` through ``how`` and delete the old ones; the names of those.

        ``how`` gets all rows of these files and returns them changed, in the same columns.
        Until the manifest is replaced the table is as before; after a crash the change can be made again.
        """
        touched = self.holding(keys)
        if not touched:
            return []
        old = self._manifest()
        version = old["version"] + 1
        new = self._put(how(self._rows(touched)), version)
        self._commit(version, [f for f in old["files"] if f not in set(touched)] + new, old["schema"])
        self._delete(touched)
        return touched

    def _delete(self, files: list[str]) -> None:
        for name in files:
            fs, where = file_system(self.spark, f"{self.root}/{name}")
            fs.delete(where, False)


def _names(rows: DataFrame) -> list[str]:
    return [f.rsplit("/", 1)[1] for f in rows.inputFiles()]
