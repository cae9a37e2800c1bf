"""k-anonymity: events leave only together with enough distinct visitors.

*Bucket mode* releases a whole bucket that holds at least k visitors. *Arrival mode*
follows the order of arrival: a bucket collects events until the k-th visitor shows up,
releases them, and starts again from zero; what waits longer than the TTL is dropped by
the next sweep.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kveil.operators.skew import hot_key_join
from kveil.session import reliable_checkpoint

QI_PARITY = ["event", "path", "country", "device", "hour"]
QI_DEFAULT = ["domain", *QI_PARITY]
# What an absent quasi-identifier counts as.
QI_EMPTY = {"event": "pageview", "path": "/", "country": "??", "device": "other"}

K, TTL_SECONDS, SWEEP_SECONDS = 5, 30 * 60, 60
CHUNK_ROWS, SMALL_CHUNK_ROWS = 1_000_000, 10_000
BROADCAST_CHUNKS = 10_000
FAN = 64  # summaries of one bucket that meet in one group
RELEASED, DROPPED, HELD = "released", "dropped", "held"


def with_quasi_identifiers(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Fill empty quasi-identifiers and add the UTC hour."""
    filled = {
        c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in QI_EMPTY.items() if c in events.columns
    }
    return events.withColumns({**filled, "hour": F.date_trunc("hour", F.col(ts))})


def _bucket(qi: list[str]) -> Column:
    """One key for all quasi-identifiers; nulls and separators can not make two buckets meet."""
    return F.substring(F.sha2(F.to_json(F.struct(*qi)), 256), 1, 32)


def bucket_sizes(events: DataFrame, qi: list[str], visitor: str = "visitor") -> DataFrame:
    """Events and distinct visitors per bucket."""
    return events.groupBy(*qi).agg(F.count("*").alias("events"), F.count_distinct(visitor).alias("visitors"))


def release_buckets(
    events: DataFrame, qi: list[str] | None = None, k: int = K, visitor: str = "visitor", ts: str = "ts"
) -> DataFrame:
    """Bucket mode: the events of every bucket with at least ``k`` distinct visitors.

    Distinct counting shuffles by (bucket, visitor) and the join back spreads the
    heaviest buckets, so no bucket has to fit one task.
    """
    _check_k(k)
    keyed = events.withColumn("_bucket", _bucket(qi or QI_DEFAULT))
    # The sizes serve as counts, hot list and join side: they are computed once.
    sizes = reliable_checkpoint(bucket_sizes(keyed, ["_bucket"], visitor).where(F.col("visitors") >= k))
    return hot_key_join(keyed, sizes, ["_bucket"], "events", [ts, visitor]).drop("_bucket")


def _check_k(k: int) -> None:
    if k < 2:
        raise ValueError("k must be at least 2")


class Gate:
    """Arrival rules for one bucket. Times are microseconds; a tick is one sweep."""

    def __init__(self, k: int, ttl_us: int, sweep_us: int, as_of_us: int | None):
        self.k, self.ttl, self.sweep, self.as_of = k, ttl_us, sweep_us, as_of_us

    def deadline(self, first_ts: int) -> int:
        """First sweep tick that drops a run opened at ``first_ts``."""
        return (first_ts + self.ttl) // self.sweep + 1

    def scan(self, ts: list, visitors: list, start: int, seen: set, deadline: int):
        """Go on with a run; returns its end and how it ended (None: still open)."""
        for i in range(start, len(ts)):
            if ts[i] // self.sweep >= deadline:
                return i, DROPPED
            if visitors[i] is not None:
                seen.add(visitors[i])
                if len(seen) >= self.k:
                    return i + 1, RELEASED
        return len(ts), None

    def leftover(self, first_ts: int) -> str:
        """State of a run that never ended."""
        overdue = self.as_of is not None and self.deadline(first_ts) * self.sweep <= self.as_of
        return DROPPED if overdue else HELD


def _steps(steps: list, cap: int) -> list:
    """Sweep steps in order of their ticks: neighbours with one outcome are one, and nothing is kept behind ``cap``."""
    out: list = []
    for tick, end in steps:
        if out and out[-1][0] >= cap:
            break
        if out and out[-1][1] == end:
            out[-1] = [tick, end]
        else:
            out.append([tick, end])
    return out


def _summary(gate: Gate, ts: list, visitors: list, first: bool) -> dict:
    """What rows in a row (a chunk's part of a bucket) do to a run that is open when they begin.

    An open run holds fewer than k visitors. It can only end at one of the first k new
    visitors (``heads``: visitor, tick, and the run that is open after the last row if
    it ends there) or at a sweep before them (``sweeps``: the run that is open after the
    last row if a deadline up to that tick is met). No deadline is later than that of a
    run opened by the first row (``cap``), so there are at most TTL / sweep + 2 steps.
    ``fresh`` is the run that is open after the last row if none was before the first.
    """
    heads, seen = [], set()
    for i, v in enumerate(visitors):
        if v is not None and v not in seen:
            seen.add(v)
            heads.append((v, i))
            if len(seen) == gate.k:
                break
    limit = heads[-1][1] if len(heads) == gate.k else len(ts) - 1
    cap, ticks = gate.deadline(ts[0]), []
    for i in range(limit + 1 if first else 0):
        tick = ts[i] // gate.sweep
        if not ticks or ticks[-1][0] != tick:
            ticks.append((tick, i))
            if tick >= cap:
                break
    starts = {0} | ({i + 1 for _, i in heads} | {i for _, i in ticks} if first else set())
    ends: dict[int, list | None] = {len(ts): None}
    for start in sorted(starts):
        path, at, end = [], start, None
        while at not in ends:
            path.append(at)
            tokens: set = set()
            stop, how = gate.scan(ts, visitors, at, tokens, gate.deadline(ts[at]))
            if how is None:
                ends[at] = end = [sorted(tokens), ts[at]]
                break
            at = stop
        else:
            end = ends[at]
        for p in path:
            ends[p] = end
    return {
        "cap": cap, "last": ts[-1] // gate.sweep, "fresh": ends[0],
        "heads": [[v, ts[i] // gate.sweep, ends[i + 1]] for v, i in heads] if first else [],
        "sweeps": _steps([[tick, ends[i]] for tick, i in ticks], cap),
    }


def _pass(gate: Gate, s: dict, run: list | None) -> tuple[str | None, list | None]:
    """How an open run ends within the rows of a summary (None: not at all), and which run is open after them."""
    if run is None:
        return None, s["fresh"]
    tokens, first_ts = run
    deadline = gate.deadline(first_ts)
    new = [h for h in s["heads"] if h[0] not in tokens]
    need = gate.k - len(tokens)
    release = new[need - 1] if len(new) >= need else None
    if s["last"] >= deadline and (release is None or release[1] >= deadline):
        return DROPPED, next(end for tick, end in s["sweeps"] if tick >= deadline)
    if release is not None:
        return RELEASED, release[2]
    return None, [tokens + [h[0] for h in new], first_ts]


def _compose(gate: Gate, a: dict, b: dict) -> dict:
    """The summary of the rows of ``a`` followed by those of ``b``; this is associative."""
    cache: dict = {}

    def through(run: list | None) -> list | None:
        key = None if run is None else (tuple(run[0]), run[1])
        if key not in cache:
            cache[key] = _pass(gate, b, run)[1]
        return cache[key]

    known = {h[0] for h in a["heads"]}
    full = len(a["heads"]) == gate.k
    heads = [[v, tick, through(end)] for v, tick, end in a["heads"]]
    heads += [h for h in b["heads"] if h[0] not in known][: gate.k - len(heads)]
    sweeps = [[tick, through(end)] for tick, end in a["sweeps"]]
    sweeps += [] if full else [x for x in b["sweeps"] if x[0] > a["last"]]
    return {"cap": a["cap"], "last": b["last"], "fresh": through(a["fresh"]), "heads": heads, "sweeps": _steps(sweeps, a["cap"])}


def _fold(gate: Gate, summaries: list[dict], run: list | None = None, final: str | None = None) -> list[dict]:
    """State at the start and end of each of the summarised stretches, in order.

    ``run`` is open before the first; ``final`` tells how the run ends that is open after the last.
    """
    entries = []
    for s in summaries:
        how, after = _pass(gate, s, run)
        tokens, first_ts = run or (None, None)
        entries.append({"tokens": tokens, "first_ts": first_ts, "entry_outcome": how, "exit_outcome": None})
        run = after
    if run is not None and final is None:
        final = gate.leftover(run[1])
    for entry in reversed(entries):
        entry["exit_outcome"] = final
        if entry["first_ts"] is not None:
            # Its outcome is that of the run open after the stretch before.
            final = entry["entry_outcome"] = entry["entry_outcome"] or final
        else:
            final = None
    return entries


def _label(gate: Gate, ts: list, visitors: list, entry: dict | None) -> list[str]:
    """Outcome of each row of one bucket within one chunk."""
    out: list[str] = []
    entry = entry or {}
    at = 0
    if entry.get("first_ts") is not None:
        at, _ = gate.scan(ts, visitors, 0, set(entry["tokens"]), gate.deadline(entry["first_ts"]))
        out += [entry["entry_outcome"]] * at
    while at < len(ts):
        stop, how = gate.scan(ts, visitors, at, set(), gate.deadline(ts[at]))
        out += [how or entry.get("exit_outcome") or gate.leftover(ts[at])] * (stop - at)
        at = stop
    return out


def _segments(buckets: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(buckets) + 1):
        if i == len(buckets) or buckets[i] != buckets[start]:
            yield start, i
            start = i


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup ordered batches so that a bucket is never cut within a chunk."""
    pending: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        keys = batch.column("_bucket").to_pylist()
        cut = len(keys) - 1
        while cut > 0 and keys[cut - 1] == keys[-1]:
            cut -= 1
        same = pending and pending[-1].column("_bucket")[-1].as_py() == keys[0]
        if cut == 0 and same:
            pending.append(table)
            continue
        if cut:
            pending.append(table.slice(0, cut))
        if pending:
            yield pa.concat_tables(pending)
        pending = [table.slice(cut)]
    if pending:
        yield pa.concat_tables(pending)


STATE = "_bucket STRING, _chunk INT, _state STRING"


def _border_states(gate: Gate, borders: DataFrame, chunks: int, fan: int) -> DataFrame:
    """State of every bucket at the borders of its chunks, folded as a tree: no group has more than ``fan`` summaries.

    Upwards, ``fan`` neighbours become one summary until a bucket has at most ``fan``;
    downwards, each of them tells its own parts which run is open before them and how the
    run that is open after them ends.
    """
    def compose(group: pd.DataFrame) -> pd.DataFrame:
        parts = [json.loads(s) for s in group.sort_values("_chunk")["summary"]]
        whole = functools.reduce(lambda a, b: _compose(gate, a, b), parts)
        return pd.DataFrame({"_bucket": group["_bucket"].iloc[:1], "_chunk": group["_node"].iloc[:1], "summary": [json.dumps(whole)]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_chunk")
        above = json.loads(group["_state"].iloc[0]) if "_state" in group else {}
        run = [above["tokens"], above["first_ts"]] if above.get("first_ts") is not None else None
        states = _fold(gate, [json.loads(s) for s in group["summary"]], run, above.get("exit_outcome"))
        return pd.DataFrame({
            "_bucket": group["_bucket"].to_numpy(), "_chunk": group["_chunk"].to_numpy(), "_state": [json.dumps(s) for s in states],
        })

    node = F.floor(F.col("_chunk") / fan).cast("int").alias("_node")
    levels = [borders]
    while chunks > fan:
        levels[-1] = reliable_checkpoint(levels[-1])  # read on the way up and down
        levels.append(levels[-1].select("*", node).groupBy("_bucket", "_node").applyInPandas(compose, "_bucket STRING, _chunk INT, summary STRING"))
        chunks = -(-chunks // fan)
    states = levels.pop().groupBy("_bucket").applyInPandas(fold, STATE)
    while levels:
        above = states.select("_bucket", F.col("_chunk").alias("_node"), "_state")
        states = levels.pop().select("*", node).join(above, ["_bucket", "_node"]).groupBy("_bucket", "_node").applyInPandas(fold, STATE)
    return states


def arrival_status(
    events: DataFrame, qi: list[str] | None = None, k: int = K, ttl_seconds: int = TTL_SECONDS,
    sweep_seconds: int | None = None, as_of: str | None = None, ts: str = "ts", tie: str = "event_id",
    visitor: str = "visitor", chunks: int | None = None, fan: int = FAN,
) -> DataFrame:
    """Arrival mode: ``tie`` and ``status`` (released, dropped or held) of every event.

    The order is ``(ts, tie)``; ``tie`` must be a stored, unique id. Sweeps happen at
    multiples of ``sweep_seconds``. With ``as_of`` (a UTC timestamp) a last sweep runs
    then.

    The rows are range-partitioned by (bucket, time), so a heavy bucket is spread over
    many chunks of even size. Each chunk is reduced to a small summary for the buckets
    that cross its borders, the summaries of a bucket are folded as a tree of ``fan``
    neighbours each, and a second scan labels the rows. The result equals one pass over
    each bucket.
    """
    _check_k(k)
    sweep_seconds = sweep_seconds or max(1, min(ttl_seconds, SWEEP_SECONDS))
    as_of_us = int(pd.Timestamp(as_of, tz="UTC").value // 1000) if as_of else None
    gate = Gate(k, ttl_seconds * 1_000_000, sweep_seconds * 1_000_000, as_of_us)
    keyed = events.select(
        _bucket(qi or QI_DEFAULT).alias("_bucket"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), tie, visitor
    )
    if chunks is None:
        shuffle = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = events.count()
        chunks = max(1, -(-rows // CHUNK_ROWS), min(shuffle, rows // SMALL_CHUNK_ROWS))
    order = ["_bucket", "_us", tie]
    ordered = keyed.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    # Both scans must see the same chunks: they are stored once.
    ordered = reliable_checkpoint(ordered.withColumn("_chunk", F.spark_partition_id()))

    def summarise(batches):
        first = last = None  # (bucket, chunk, ts, visitors) of the chunk's border buckets
        for table in _by_bucket(batches):
            keys = table.column("_bucket").to_pylist()
            cuts = list(_segments(keys))
            for a, b in ([cuts[0]] if first is None else []) + [cuts[-1]]:
                part = table.slice(a, b - a)
                last = (keys[a], part.column("_chunk")[0].as_py(), part.column("_us").to_pylist(),
                        part.column(visitor).to_pylist())
                first = first or last
        found = [] if first is None else [first] if first[0] == last[0] else [first, last]
        for key, chunk, times, who in found:
            text = json.dumps(_summary(gate, times, who, first=(key == first[0])))
            yield pa.RecordBatch.from_pydict({"_bucket": [key], "_chunk": pa.array([chunk], pa.int32()), "summary": [text]})

    borders = ordered.select("_bucket", "_chunk", "_us", visitor).mapInArrow(
        summarise, "_bucket STRING, _chunk INT, summary STRING"
    )
    states = _border_states(gate, borders, chunks, fan)

    def label(batches):
        for table in _by_bucket(batches):
            keys, times, who = (table.column(c).to_pylist() for c in ("_bucket", "_us", visitor))
            state = table.column("_state")
            status: list[str] = []
            for a, b in _segments(keys):
                text = state[a].as_py()
                status += _label(gate, times[a:b], who[a:b], json.loads(text) if text else None)
            yield from table.select([tie]).append_column("status", pa.array(status, pa.string())).to_batches()

    schema = T.StructType([events.schema[tie], T.StructField("status", T.StringType())])
    if chunks <= BROADCAST_CHUNKS:  # at most two states per chunk
        return ordered.join(F.broadcast(states), ["_bucket", "_chunk"], "left").mapInArrow(label, schema)
    # Joined by shuffle, a chunk's part of a bucket is a bucket of its own, sorted again.
    joined = ordered.join(states, ["_bucket", "_chunk"], "left").withColumn("_bucket", F.concat_ws(":", "_bucket", "_chunk"))
    return joined.sortWithinPartitions("_bucket", "_us", tie).mapInArrow(label, schema)


def release_in_order(events: DataFrame, qi: list[str] | None = None, k: int = K, tie: str = "event_id", **options) -> DataFrame:
    """Every event with its ``status`` in arrival mode; options as in ``arrival_status``.

    Only keys, times and visitors go through the gate. The other columns meet the result
    by the unique id, which can not be skewed, and only as far as the caller reads them.
    """
    return events.join(arrival_status(events, qi, k, tie=tie, **options), tie)


def gate_state(labelled: DataFrame, qi: list[str], k: int = K) -> DataFrame:
    """``k``, open buckets and buffered events."""
    per_bucket = labelled.where(F.col("status") == HELD).groupBy(*qi).agg(F.count("*").alias("n"))
    return per_bucket.agg(
        F.lit(k).cast("bigint").alias("k"),
        F.count("*").alias("open_buckets"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("buffered_events"),
    )
