"""Sharding: a keyed Feistel permutation over global row numbers.

Row ``i`` of ``n`` (in order of id, size and checksum) moves to ``p(i)``, a permutation
of 0..n-1; its shard is ``p(i) mod shards`` and its slot ``p(i) div shards``, so shard
sizes differ by one at most and slots have no gaps. Anyone who knows the key, ``n`` and
``i`` can compute both, and :func:`inverse` finds the row of a place.

Null text has no bytes; null ids come first in the order; repeated rows are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kveil.session import reliable_checkpoint

SHARDS = 40
PRIME = 2**31 - 1
ROUNDS = 6


class Domain(NamedTuple):
    """The rectangle ``a * b >= n`` that the rounds permute; ``walk`` = points beyond n."""

    n: int
    a: int
    b: int
    walk: int


def domain(n: int) -> Domain:
    """Sides near sqrt(n) with the fewest points beyond ``n``.

    A value beyond ``n`` is permuted again; it meets each point beyond ``n`` once at
    most, so ``walk`` further steps always suffice.
    """
    if n >= PRIME * PRIME // 4:
        raise ValueError("too many rows for the round function")
    if n < 1:
        return Domain(0, 1, 1, 1)
    root = isqrt(n)
    a = min(range(root, max(0, root - 100_000, root // 8), -1), key=lambda x: (-n) % x)
    b = -(-n // a)
    return Domain(n, a, b, a * b - n)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers per round, drawn from ``seed`` by a multiplicative generator."""
    x, keys = seed % (PRIME - 1) + 1, []
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = x * 48271 % PRIME
            row.append(x)
        keys.append(tuple(row))
    return keys


def _mix(r, key):
    """The round function, for integers, columns and SQL alike: ((r*A + B)^2 mod p) * C mod p."""
    x = (r % PRIME * key[0] + key[1]) % PRIME
    return x * x % PRIME * key[2] % PRIME


def permute(i: int, dom: Domain, keys: list[tuple[int, int, int]]) -> int:
    """Place of row ``i``, in plain integers."""
    while True:
        left, right = i // dom.b, i % dom.b
        for k, key in enumerate(keys):
            if k % 2 == 0:
                left = (left + _mix(right, key)) % dom.a
            else:
                right = (right + _mix(left, key)) % dom.b
        i = left * dom.b + right
        if i < dom.n:
            return i


def inverse(place: int, dom: Domain, keys: list[tuple[int, int, int]]) -> int:
    """Row number at ``place``."""
    i = place
    while True:
        left, right = i // dom.b, i % dom.b
        for k in reversed(range(len(keys))):
            if k % 2 == 0:
                left = (left - _mix(right, keys[k])) % dom.a
            else:
                right = (right - _mix(left, keys[k])) % dom.b
        i = left * dom.b + right
        if i < dom.n:
            return i


def place_column(row: Column, dom: Domain, keys: list[tuple[int, int, int]]) -> Column:
    """:func:`permute` as one column expression."""
    table = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("xyz", key)], F.lit(k % 2 == 0).alias("even"))
        for k, key in enumerate(keys)
    ])

    def once(i: Column) -> Column:
        start = F.struct(F.call_function("div", i, F.lit(dom.b)).alias("l"), (i % dom.b).alias("r"))
        return F.aggregate(
            table, start,
            lambda acc, k: F.when(
                k["even"],
                F.struct(((acc["l"] + _mix(acc["r"], (k["x"], k["y"], k["z"]))) % dom.a).alias("l"), acc["r"].alias("r")),
            ).otherwise(F.struct(acc["l"].alias("l"), ((acc["r"] + _mix(acc["l"], (k["x"], k["y"], k["z"]))) % dom.b).alias("r"))),
            lambda acc: acc["l"] * dom.b + acc["r"],
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, dom.walk)))
    return F.aggregate(steps, once(row), lambda i, _: F.when(i < dom.n, i).otherwise(once(i)))


def with_row_numbers(rows: DataFrame, order: list[str]) -> DataFrame:
    """``row_number`` 0..n-1 in ``order``, without one task that sees all rows.

    Narrow rows are range-partitioned, sorted and written once; each partition then
    numbers its rows from the sum of the partitions before it, one row per partition.
    """
    ranged = reliable_checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = ranged.withColumn("_at", F.monotonically_increasing_id())
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row per partition: the task count bounds the broadcast.
    return numbered.withColumn("_part", part).join(F.broadcast(before), "_part").select(
        *[F.col(c) for c in rows.columns], (F.col("_before") + at).alias("row_number")
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 2024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered = with_row_numbers(rows, ["doc_id", "size", "text_crc32"])
    dom = domain(numbered.count())
    place = numbered.withColumn("_place", place_column(F.col("row_number"), dom, round_keys(seed)))
    return place.select(
        "doc_id", "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), F.lit(shards)).alias("slot"),
    )


def oracle_sql(shards: int = SHARDS, seed: int = 2024) -> str:
    """The same placement in DuckDB SQL; CRC-32 is folded byte by byte over a table made from its polynomial."""
    once = "SELECT start, a, b, i // b AS l, i % b AS r FROM walk, m WHERE step = 0 OR i >= n"
    for k, (x, y, z) in enumerate(round_keys(seed)):
        side, other, width = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        line = f"(({other} % {PRIME} * {x} + {y}) % {PRIME})"
        once = f"SELECT start, a, b, {other}, ({side} + {line} * {line} % {PRIME} * {z} % {PRIME}) % {width} AS {side} FROM ({once})"
    return f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(range(8),
    lambda acc, s: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, b) AS v FROM range(256) AS x(b))),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT k, doc_id, CAST(octet_length(encode(d.t)) + 16 AS BIGINT) AS size, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda acc, v: xor(acc // 256, crc[xor(acc % 256, v) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, t),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i FROM s),
m AS (SELECT n, x AS a, (n + x - 1) // x AS b FROM (SELECT count(*) AS n FROM documents),
    unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS u(x)
    WHERE x > CAST(floor(sqrt(n)) AS BIGINT) // 8 AND x > floor(sqrt(n)) - 100000
    ORDER BY (n + x - 1) // x * x - n, x DESC LIMIT 1),
walk AS (SELECT i AS start, i, 0 AS step FROM o UNION ALL SELECT start, l * b + r, 1 FROM ({once})),
placed AS (SELECT start, walk.i FROM walk, m WHERE step = 1 AND walk.i < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p.i % {shards} AS INTEGER) AS shard, p.i // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN placed p ON p.start = o.i
"""
