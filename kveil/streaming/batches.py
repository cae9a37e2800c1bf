"""Micro-batches with versioned state.

Each batch reads the state that the batch before it wrote, and writes its output and
its new state into folders of its own number. A replayed batch overwrites exactly those
folders, so every row counts once whatever fails. The work of a batch is the same
DataFrame code as on history, so a hot key is spread over tasks here too.

Folded parts (counters, daily totals) are kept as fragments: a batch writes only what it
adds, by key, and never reads the old rows of a key to add new ones. Readers fold the live
fragments. Which are live stands in the manifest of a batch, one small file for all its
parts that is written last; without it the batch did not happen, and readers open no
other files. When a key has ``FAN`` fragments of one level, the next batch folds them into
one of the level above, so a row is rewritten log(batches) times. Null keys are keys.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kveil.sources.storage import file_system, folders, read_text, write_text

# So many fragments of one key and level become one fragment of the next level.
FAN = 8

Step = Callable[[DataFrame, DataFrame | None, "BatchFolder"], None]


class BatchFolder:
    """Folders of one batch below the root of a stream."""

    def __init__(self, spark: SparkSession, root: str, batch_id: int):
        self.spark, self.root, self.batch_id = spark, root.rstrip("/"), batch_id
        self.parts: dict[str, dict] = {}

    def path(self, part: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{part}/batch={self.batch_id if batch_id is None else batch_id}"

    def write(self, df: DataFrame, part: str) -> DataFrame:
        """Store one part and read it back, cut off from how it was computed."""
        df.write.mode("overwrite").parquet(self.path(part))
        return self.spark.read.schema(df.schema).parquet(self.path(part))

    def add(self, delta: DataFrame, part: str, key: str, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Write the folded rows of this batch as fragments of ``part`` by ``key``, with the old fragments that are due."""
        live = self._before().get(part, {"live": []})["live"]
        due = _due(live)
        rows = delta
        if due:
            rows = fold(_fragments(self.spark, self.root, part, delta.schema.json(), due).unionByName(delta))
        # A rebalanced write has few files per key and cuts a heavy one.
        rows.hint("rebalance", F.col(key)).write.mode("overwrite").partitionBy(key).parquet(self.path(part))
        raised = {folder: level + 1 for folder, _, level in due}
        kept = [e for e in live if tuple(e) not in set(map(tuple, due))]
        new = [[name, self.batch_id, raised.get(name, 0)] for name in folders(self.spark, self.path(part), f"{key}=")]
        self.parts[part] = {"key": key, "schema": delta.schema.json(), "live": kept + new}

    def _before(self) -> dict:
        return manifest(self.spark, self.root, self.batch_id)

    def commit(self) -> None:
        """Make the fragments of this batch live, all parts at once."""
        if self.parts:
            write_text(self.spark, f"{self.root}/manifest/{self.batch_id}.json", json.dumps({**self._before(), **self.parts}))

    def previous(self, part: str, batch_id: int | None = None) -> DataFrame | None:
        """What the batch before (or the given one) wrote; None before the first."""
        batch_id = self.batch_id - 1 if batch_id is None else batch_id
        return None if batch_id < 0 else self.spark.read.parquet(self.path(part, batch_id))


def run_batches(
    stream: DataFrame, step: Step, root: str, state: str | None = None, trigger: dict | None = None, name: str | None = None
):
    """Start a query that hands every micro-batch to ``step(batch, previous state, folder)``.

    ``root`` must be on storage that all executors share. Without a trigger, everything
    that is available is processed and the query ends.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = BatchFolder(batch.sparkSession, root, batch_id)
        batch = batch.persist()  # a step reads its batch several times
        try:
            step(batch, folder.previous(state) if state else None, folder)
            folder.commit()
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_part(spark: SparkSession, root: str, part: str) -> DataFrame:
    """All batches of one part."""
    return spark.read.parquet(f"{root.rstrip('/')}/{part}").drop("batch")


def _due(live: list) -> list:
    """The fragments to fold now: those of a key's lowest level that has ``FAN`` of them."""
    by_level = defaultdict(list)
    for entry in live:
        by_level[entry[0], entry[2]].append(entry)
    out: dict[str, list] = {}
    for (folder, _), entries in sorted(by_level.items()):
        if len(entries) >= FAN:
            out.setdefault(folder, entries)
    return [e for entries in out.values() for e in entries]


def manifest(spark: SparkSession, root: str, before: int | None = None) -> dict:
    """The parts with their live fragments after the newest batch (or the newest one below ``before``)."""
    numbers = [int(n[:-5]) for n in folders(spark, f"{root.rstrip('/')}/manifest") if n.endswith(".json")]
    numbers = [n for n in numbers if before is None or n < before]
    return json.loads(read_text(spark, f"{root.rstrip('/')}/manifest/{max(numbers)}.json")) if numbers else {}


def _fragments(spark: SparkSession, root: str, part: str, schema: str, entries: list) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    if not entries:
        return spark.createDataFrame([], kind)
    base = f"{root.rstrip('/')}/{part}"
    paths = [f"{base}/batch={batch}/{folder}" for folder, batch, _ in entries]
    return spark.read.schema(kind).option("basePath", base).parquet(*paths).select(kind.names)


def read_live(spark: SparkSession, root: str, part: str) -> DataFrame:
    """The live fragments of a folded part; a key has up to ``FAN`` rows per level for one thing, which the reader folds."""
    found = manifest(spark, root).get(part)
    if found is None:
        raise FileNotFoundError(f"{root} has no finished batch with {part}")
    return _fragments(spark, root, part, found["schema"], found["live"])


def drop_superseded(spark: SparkSession, root: str, part: str) -> int:
    """Delete the fragments that are live no more; call it between runs."""
    found = manifest(spark, root)[part]
    live, gone, base = {(e[1], e[0]) for e in found["live"]}, 0, f"{root.rstrip('/')}/{part}"
    for batch in folders(spark, base, "batch="):
        for folder in folders(spark, f"{base}/{batch}", found["key"] + "="):
            if (int(batch.removeprefix("batch=")), folder) not in live:
                fs, where = file_system(spark, f"{base}/{batch}/{folder}")
                gone += fs.delete(where, True)
    return gone
