"""Rate limits and suspicious sources.

A source may send a third of all hits. Fixed windows use a ranked limit, which Spark
also applies before the shuffle (up to ``spark.sql.optimizer.windowGroupLimitThreshold``,
1000 by default); larger limits are first cut in ``SHARES`` shares of each key, so that no
task holds more than the shares times the limit of one key. Renewing limits and sessions
first reduce each source to one row per time unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Limits as (name, accepted hits, seconds, kind).
POLICIES = [
    ("success", 30, 60, "fixed"),
    ("login", 5, 900, "fixed"),
    ("collect", 240, 60, "fixed"),
    ("attest", 120, 60, "fixed"),
    ("register", 3, 3600, "renewing"),
    ("captcha", 51, 3600, "renewing"),
    ("trackers", 31, 3600, "renewing"),
    ("erase", 3, 3600, "renewing"),
    ("recover", 5, 900, "renewing"),
]
SUSPICIOUS_FAILURES, SUSPICIOUS_SECONDS = 5, 3600
SHARES = 32


def fixed_window_allowed(hits: DataFrame, limit: int, seconds: int, key: str = "key", ts: str = "ts", tie: str = "hit_id") -> DataFrame:
    """The hits that a fixed window lets through: the first ``limit`` per key and window."""
    window = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    timed = hits.withColumn("_window", window)
    if limit > int(hits.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        # Whatever is not among the first hits of its share is not among those of the key.
        timed = _first(timed.withColumn("_share", F.pmod(F.xxhash64(tie), F.lit(SHARES))), limit, [key, "_window", "_share"], ts, tie).drop("_share")
    return _first(timed, limit, [key, "_window"], ts, tie).drop("_window")


def _first(hits: DataFrame, limit: int, keys: list[str], ts: str, tie: str) -> DataFrame:
    ranked = hits.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def _mark(hits: DataFrame, allowed: DataFrame, tie: str) -> DataFrame:
    """Flag the allowed hits. The join is on the unique hit id, which can not be skewed."""
    flags = allowed.select(tie, F.lit(True).alias("allowed"))
    return hits.join(flags, tie, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def fixed_window_limit(hits: DataFrame, limit: int, seconds: int, key: str = "key", ts: str = "ts", tie: str = "hit_id") -> DataFrame:
    """Every hit with ``allowed``. ``tie`` must be unique."""
    return _mark(hits, fixed_window_allowed(hits, limit, seconds, key, ts, tie), tie)


def _accept(groups: Iterator[pd.DataFrame], limit: int, seconds: int, key: str) -> Iterator[pd.DataFrame]:
    """Walk (key, second, hits) rows in order and say how many hits of each second pass.

    A row with ``used`` set is the counter that an earlier walk left behind.
    """
    current, used, last = None, 0, 0
    for pdf in groups:
        rows = []
        for k, second, hits, carried in zip(pdf[key], pdf["second"], pdf["hits"], pdf["used"]):
            if k != current:
                current, used, last = k, 0, second
            if carried >= 0:
                used, last = carried, second
                continue
            if second >= last + seconds:
                used = 0
            take = min(hits, limit - used)
            if take > 0:
                used, last = used + take, max(last, second)
                rows.append((k, second, take, last, used))
        yield pd.DataFrame(rows, columns=[key, "second", "accepted", "last", "used"])


def renewing_counters(
    hits: DataFrame, limit: int, seconds: int, key: str = "key", ts: str = "ts", state: DataFrame | None = None
) -> DataFrame:
    """Accepted hits per key and second, with the counter after them and the newest second it counts.

    The walk sees one row per key and second with hits, so its length depends on the time
    span and not on the number of hits. ``state`` holds ``(key, second, used)`` of an
    earlier walk; a hit behind it counts, but does not make the counter older.
    """
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    work = hits.groupBy(key, second.alias("second")).agg(F.count("*").alias("hits"), F.lit(-1).cast("bigint").alias("used"))
    if state is not None:
        work = work.unionByName(state.select(key, "second", F.lit(0).cast("bigint").alias("hits"), "used"))
    return (
        work.repartition(key).sortWithinPartitions(key, F.col("used").desc(), "second")
        .mapInPandas(
            lambda it: _accept(it, limit, seconds, key),
            f"{key} {dict(hits.dtypes)[key]}, second BIGINT, accepted BIGINT, last BIGINT, used BIGINT",
        )
    )


def renewing_allowed(hits: DataFrame, counters: DataFrame, limit: int, key: str = "key", ts: str = "ts", tie: str = "hit_id") -> DataFrame:
    """The hits that the counters let through."""
    timed = hits.withColumn("second", F.unix_timestamp(F.col(ts).cast("timestamp")))
    # Only the first `limit` hits of a second can pass; the cut happens before the shuffle.
    w = Window.partitionBy(key, "second").orderBy(ts, tie)
    heads = timed.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    passed = heads.join(counters.select(key, "second", "accepted"), [key, "second"]).where(F.col("_rank") <= F.col("accepted"))
    return passed.select(hits.columns)


def renewing_limit(hits: DataFrame, limit: int, seconds: int, key: str = "key", ts: str = "ts", tie: str = "hit_id") -> DataFrame:
    """Every hit with ``allowed``, for a counter whose lifetime restarts at each accepted hit.

    Denied hits do not extend it. Time counts in whole seconds, the unit of the lifetime.
    """
    counters = renewing_counters(hits, limit, seconds, key, ts)
    narrow = hits.select(key, ts, tie)
    return _mark(hits, renewing_allowed(narrow, counters, limit, key, ts, tie), tie)


def apply_policy(hits: DataFrame, name: str, key: str = "key", ts: str = "ts", tie: str = "hit_id") -> DataFrame:
    """Every hit with ``allowed`` under one of the listed limits."""
    limit, seconds, kind = {p[0]: p[1:] for p in POLICIES}[name]
    apply = fixed_window_limit if kind == "fixed" else renewing_limit
    return apply(hits, limit, seconds, key, ts, tie)


def suspicious_sources(
    failures: DataFrame, source: str = "source", ts: str = "ts",
    threshold: int = SUSPICIOUS_FAILURES, seconds: int = SUSPICIOUS_SECONDS,
) -> DataFrame:
    """Failure runs per source: a failure within ``seconds`` of the last one continues a run.

    ``flagged`` is the number of failures at or beyond the threshold. Two failures in one
    aligned slot of ``seconds`` always share a run, so slots are counted first.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    slots = failures.groupBy(source, F.floor(us / span).alias("_slot")).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last"), F.count("*").alias("_n")
    )
    w = Window.partitionBy(source).orderBy("_slot")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(w) >= span, F.lit(True))
    runs = slots.withColumn("_run", F.sum(opens.cast("int")).over(w)).groupBy(source, "_run").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("failures")
    )
    return runs.select(
        source, F.timestamp_micros("_first").alias("first_failure"), F.timestamp_micros("_last").alias("last_failure"),
        "failures", F.greatest(F.col("failures") - (threshold - 1), F.lit(0)).cast("bigint").alias("flagged"),
        (F.col("failures") >= threshold).alias("suspicious"),
    )
