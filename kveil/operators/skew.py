"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 10_000


def hot_key_join(
    facts: DataFrame, groups: DataFrame, keys: list[str], weight: str, spread_by: list[str], how: str = "left_semi",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Join ``facts`` to one row per key in ``groups`` without sending a hot key to one task.

    ``weight`` is the number of fact rows per key. A key above the target, which is
    ``hot_rows`` or one ``HOT_PARTS``-th of all rows, has its facts spread over as many
    shares as it holds targets, by a hash of ``spread_by``, and its group row repeated
    once per share. So no share is larger than about one target however heavy its key,
    and the list of hot keys, which is broadcast, has at most ``HOT_PARTS`` rows.
    """
    target = F.greatest(F.lit(hot_rows), F.ceil(groups.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar() / HOT_PARTS))
    shares = F.ceil(F.col(weight) / target).cast("int")
    hot = groups.where(F.col(weight) > target).select(*keys, shares.alias("_shares"))
    part = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_shares")), F.lit(0)).cast("int")
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", part)
    every = F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)
    copies = groups.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every))
    return salted.drop("_shares").join(copies.drop("_shares"), [*keys, "_salt"], how).drop("_salt")
