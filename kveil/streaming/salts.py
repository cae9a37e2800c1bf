"""Salts that live as long as their day is open."""

from __future__ import annotations

import base64
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.functions.anonymize import SaltBook, salt_epoch
from kveil.operators import events
from kveil.sources.storage import exists, read_text, write_text
from kveil.streaming.batches import BatchFolder, run_batches
from kveil.streaming.jobs import on_time


class SaltVault:
    """Salts of the open epochs in one small file, so that a restarted stream gives an open day the same tokens.

    ``path`` belongs on storage that only the job may read, apart from the data. A salt is
    stored before it is used first and is gone for good once its epoch is forgotten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def epochs(self) -> dict[int, bytes]:
        held = json.loads(read_text(self.spark, self.path)) if exists(self.spark, self.path) else {}
        return {int(e): base64.b64decode(s) for e, s in held.items()}

    def _store(self, salts: dict[int, bytes]) -> None:
        write_text(self.spark, self.path, json.dumps({str(e): base64.b64encode(s).decode() for e, s in salts.items()}))

    def __call__(self, epoch: int) -> bytes:
        """The salt of an open epoch; a provider for ``SaltBook``."""
        held = self.epochs()
        if epoch not in held:
            self._store({**held, epoch: os.urandom(32)})
        return self.epochs()[epoch]

    def forget_before(self, epoch: int) -> None:
        held = self.epochs()
        left = {e: s for e, s in held.items() if e >= epoch}
        if len(left) < len(held):
            self._store(left)


def event_stream(visits: DataFrame, root: str, vault: SaltVault, delay_seconds: int, trigger: dict | None = None, **options):
    """Visits to clean events (part ``events``) with the salt of their day.

    A visit whose day the watermark has passed is refused and set aside (``jobs.late_rows``),
    never given a token of another salt or none. The salt of a day is forgotten by the
    batch after the one whose watermark passed it, so that a replayed batch still has it.
    """

    def step(batch: DataFrame, _, folder: BatchFolder) -> None:
        book = SaltBook(vault, strict=True)
        day_end = F.timestamp_millis((salt_epoch(F.col("ts")) + 1) * book.rotation_ms)
        rows = on_time(batch, folder, delay_seconds, day_end)
        # As many as there are open days.
        open_ = [r[0] for r in rows.select(salt_epoch(F.col("ts"))).distinct().collect() if r[0] is not None]
        folder.write(events.build_events(rows, book.cover(open_ or [0]), **options), "events")
        before = folder.previous("newest")
        before = before.first()[0] if before is not None else None
        if before is not None:
            vault.forget_before((before // 1000 - delay_seconds * 1000) // book.rotation_ms)

    return run_batches(visits, step, root, trigger=trigger)
