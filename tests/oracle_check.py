"""Compare registered queries with their oracle SQL on one test folder."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    text = pdf.astype(object).where(pdf.notna(), None).map(lambda v: None if v is None else str(v)).fillna("<null>")
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def compare(spark, con, query, oracle: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    got = query(spark, sf_dir).toPandas()
    want = con.execute(oracle).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    return f"{bad.sum()} rows differ\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from kveil.plans.registry import ORACLES, QUERIES
    from kveil.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    duck = connect(folder)
    for n in names:
        t0 = time.time()
        try:
            if n in ORACLES:
                result = compare(session, duck, QUERIES[n], ORACLES[n], folder)
            else:
                result = f"no oracle, {QUERIES[n](session, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {str(e)[:600]}"
        print(f"{n}: {result or 'ok'} ({time.time() - t0:.1f}s)", flush=True)
