"""Joins on containment: which texts hold which shorter texts, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.session import reliable_checkpoint

Q = 4
BROADCAST_GRAMS = 200_000


def grams(text: Column, size: int | Column) -> Column:
    """The distinct substrings of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    every = F.transform(places, lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def cover(text: Column, size: int | Column) -> Column:
    """The distinct substrings of ``size`` characters that lie end to end from the first one, and the last one."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    places = F.concat(F.sequence(F.lit(1), last, size), F.array(last))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def contained(
    texts: DataFrame, parts: DataFrame, text: str = "text", part: str = "part", scope: tuple[str, ...] = (), q: int = Q, rank_by_texts: bool = True
) -> DataFrame:
    """Pairs (*scope, text, part) where ``part`` stands in ``text`` and both are of one scope; a pair once.

    A part is looked up by one of its q-grams only, the rarest of its cover, so the pairs
    to verify are few. How rare a gram is, is counted in the texts, or in the parts on
    request; by texts, a part with a gram that no text has is looked up no further. Up to
    ``BROADCAST_GRAMS`` counts go to the parts as a whole, else both are shuffled. Parts
    shorter than ``q`` are grams themselves. Nulls and empty parts are in no pair.
    """
    keys = list(scope)
    asked = parts.where(F.length(part) > 0).select(*keys, part).distinct()
    held = reliable_checkpoint(texts.where(F.col(text).isNotNull()).select(*keys, text).distinct())
    # At most q - 1 numbers.
    short = [r[0] for r in asked.where(F.length(part) < q).select(F.length(part)).distinct().collect()]
    posted = held.select(*keys, text, F.explode(F.concat(*[grams(F.col(text), n) for n in [q, *short]])).alias("_gram"))
    probes = asked.select(*keys, part, F.explode(cover(F.col(part), F.least(F.length(part), F.lit(q)))).alias("_gram"))
    often = reliable_checkpoint((posted if rank_by_texts else probes).groupBy(*keys, "_gram").agg(F.count("*").alias("_often")))
    often = F.broadcast(often) if often.count() <= BROADCAST_GRAMS else often
    best = probes.join(often, [*keys, "_gram"], "left").groupBy(*keys, part).agg(
        F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), "_gram")).alias("_gram"), F.count_if(F.col("_often").isNull()).alias("_absent")
    )
    rarest = best.where(F.col("_absent") == 0).drop("_absent")
    return rarest.join(posted, [*keys, "_gram"]).where(F.contains(F.col(text), F.col(part))).drop("_gram")
