"""Usage counters and public feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kveil.functions.fields import is_feed_hash
from kveil.functions.web import feed_column, percent, usage_column

FEED_SECONDS, FEED_CAP, FEED_LISTED, FEED_SHOWN = 600, 100, 100, 20
COUNTERS = ["requests", "blocked", "stripped", "allowed"]


def monthly_usage(log: DataFrame, ts: str = "ts", action: str = "action") -> DataFrame:
    """Requests per customer and month, by counter."""
    column = usage_column(F.col(action))
    return log.groupBy("customer_id", F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("requests"), *[F.count_if(column == c).alias(c) for c in COUNTERS[1:]]
    )


def merge_usage(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Add new counts to stored ones."""
    return old.unionByName(delta).groupBy("customer_id", "month").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def feed_totals(projects: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """Counters and percentages of one month for every feed; zeros without usage."""
    current = usage.where(F.col("month") == month).withColumnRenamed("customer_id", "customer_id_ref")
    joined = projects.where(is_feed_hash(F.col("feed_hash"))).join(current, "customer_id_ref", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNTERS}
    return joined.select(
        "feed_hash", F.lit(month).alias("month"), *[v.alias(c) for c, v in counts.items()],
        *[percent(counts[c], counts["requests"]).alias(f"pct_{c}") for c in COUNTERS[1:]],
    )


def feed_breakdown(events: DataFrame) -> DataFrame:
    """Counters per feed and tracker; an absent tracker counts as ``unknown``."""
    column = feed_column(F.coalesce(F.col("action"), F.lit("allowed")))
    tracker = F.coalesce(F.nullif(F.col("tracker"), F.lit("")), F.lit("unknown"))
    return events.groupBy("feed_hash", tracker.alias("tracker")).agg(
        *[F.count_if(column == c).alias(c) for c in COUNTERS[1:]]
    )


def cap_feed(
    events: DataFrame, now: str, tie: str = "event_id", seconds: int = FEED_SECONDS, cap: int = FEED_CAP
) -> DataFrame:
    """Live feed: events younger than ``seconds``, the last ``cap`` per feed."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return _newest(events.where(age < seconds * 1_000_000), cap, tie).drop("rank")


def recent_events(events: DataFrame, tie: str = "event_id", shown: int = FEED_SHOWN, listed: int = FEED_LISTED) -> DataFrame:
    """Newest ``shown`` events per feed out of the first ``listed`` stored ones."""
    stored = Window.partitionBy("feed_hash").orderBy("ts", tie)
    head = events.withColumn("_place", F.row_number().over(stored)).where(F.col("_place") <= listed).drop("_place")
    return _newest(head, shown, tie)


def _newest(events: DataFrame, n: int, tie: str) -> DataFrame:
    # A ranked limit is also applied before the shuffle, so a hot feed sends n rows per task.
    w = Window.partitionBy("feed_hash").orderBy(F.col("ts").desc(), F.col(tie).desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
