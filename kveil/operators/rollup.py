"""Released events to daily reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kveil.functions.web import referrer_key

TOP_N, RANGE_DAYS, RETENTION_DAYS = 10, 7, 30
# Report dimensions with the event column each one counts.
DIMENSIONS = {"event": "event", "page": "path", "referrer": "referrer", "country": "country", "device": "device"}


def daily_totals(events: DataFrame, ts: str = "ts", visitor: str = "visitor") -> DataFrame:
    """Page views and exact unique visitors per UTC day."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(
        F.count_if(F.coalesce(F.col("event"), F.lit("pageview")) == "pageview").alias("pageviews"),
        F.count_distinct(visitor).alias("uniques"),
    )


def daily_dimensions(
    events: DataFrame, ts: str = "ts", min_visitors: int | None = None, visitor: str = "visitor"
) -> DataFrame:
    """Counts per day, dimension and key, with the time each key was first seen.

    ``min_visitors`` drops keys with fewer distinct visitors, so that also dimensions
    outside the quasi-identifiers (such as referrers) keep the floor.
    """
    values = {
        **{d: F.col(c) for d, c in DIMENSIONS.items()},
        "event": F.coalesce(F.col("event"), F.lit("pageview")),
        "referrer": referrer_key(F.col("referrer")),
    }
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("key")) for d, v in values.items()])
    long = events.select(
        F.to_date(ts).alias("day"), F.col(ts).alias("at"), *([visitor] if min_visitors else []), F.inline(cells),
    ).where(F.coalesce(F.col("key"), F.lit("")) != "")
    # A plain time has a fixed width, so this stays a hash aggregate.
    counts = long.groupBy("day", "dimension", "key").agg(
        F.count("*").alias("cnt"), F.min("at").alias("first_seen"),
        *([F.count_distinct(visitor).alias("_visitors")] if min_visitors else []),
    )
    if min_visitors:
        counts = counts.where(F.col("_visitors") >= min_visitors).drop("_visitors")
    return counts


def top_keys(dimensions: DataFrame, n: int = TOP_N) -> DataFrame:
    """Most frequent keys per day and dimension; equal counts keep first-seen order."""
    w = Window.partitionBy("day", "dimension").orderBy(F.col("cnt").desc(), "first_seen", "key")
    return dimensions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def daily_report(events: DataFrame, ts: str = "ts", visitor: str = "visitor", n: int = TOP_N) -> DataFrame:
    """One row per day: totals and the top keys of every dimension as ordered arrays."""
    ranked = top_keys(daily_dimensions(events, ts), n)
    item = F.struct("rank", F.struct("key", F.col("cnt").alias("count")).alias("item"))
    lists = ranked.groupBy("day").agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("dimension") == d, item))), lambda e: e["item"]).alias(f"top_{d}s")
        for d in DIMENSIONS
    ])
    return daily_totals(events, ts, visitor).join(lists, "day", "left")


def report_range(totals: DataFrame, last_day: str, days: int = RANGE_DAYS) -> DataFrame:
    """The last ``days`` calendar days, with zeros where nothing was released."""
    spark = totals.sparkSession
    spine = spark.range(1).select(
        F.explode(F.sequence(F.date_sub(F.to_date(F.lit(last_day)), days - 1), F.to_date(F.lit(last_day)))).alias("day")
    )
    recent = totals.where((F.col("day") > F.date_sub(F.to_date(F.lit(last_day)), days)) & (F.col("day") <= F.to_date(F.lit(last_day))))
    return spine.join(recent, "day", "left").select(
        "day", F.coalesce("pageviews", F.lit(0)).alias("pageviews"), F.coalesce("uniques", F.lit(0)).alias("uniques")
    )


def retain_days(df: DataFrame, days: int = RETENTION_DAYS, day: str = "day") -> DataFrame:
    """Rows of the newest ``days`` distinct days that are present.

    The day list is cut before the join, so it never has more than ``days`` rows.
    """
    kept = df.select(day).distinct().orderBy(F.col(day).desc()).limit(days)
    return df.join(F.broadcast(kept), day, "left_semi")
