import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from kveil.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "kveil-tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a column function to literal rows: ``values(fn, ["a", "b"])``."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema="x string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        names = [n for n in df.columns if n != "_i"]
        out = df.select("_i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("_i")
        return [r["out"] for r in out.collect()]

    return run
