"""Connected components of links by alternating star steps; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.session import reliable_checkpoint


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its smallest reachable node) for every node of ``links(a, b)``.

    A large-star step points the larger neighbours of a node to the smallest node it
    sees, a small-star step does so with the smaller ones; both keep the components.
    The steps stop when a round changes nothing. A hub's neighbours are grouped by a
    partial minimum and joined back, never gathered.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if large else edges
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = both.join(lowest, "a")
        moved = joined.where("b > a") if large else joined
        pointed = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            pointed = pointed.union(lowest.select("a", F.col("low").alias("b")))
        return pointed.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = reliable_checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = reliable_checkpoint(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
