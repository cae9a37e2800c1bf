"""Session defaults and checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Keyed state with timers works on this store only.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # call sites cost driver time on long expressions
    # Salt blocks are literals of 64 bytes: keep them out of plans in the UI and the event log.
    "spark.sql.redaction.string.regex": "(0x|X')[0-9A-Fa-f]{128}",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE[0]: STATE_STORE[1],
}


def build_session(master: str | None = None, app: str = "kveil", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once, so that they need no install of it."""
    sc = spark.sparkContext
    if any(name.startswith("kveil-package-") for name in map(os.path.basename, getattr(sc, "_python_includes", []))):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="kveil-package-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local session without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kveil-checkpoint-"))


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so it survives lost executors."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below the folder the cluster names, or a local one in local mode."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
