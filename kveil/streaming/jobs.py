"""Streaming twins of the gate, the counters, the reports, the limits and the account checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kveil.operators import accounts, kanon, limits, rollup, usage
from kveil.sources import io, schemas
from kveil.streaming.batches import BatchFolder, read_live, read_part, run_batches

SKETCH_LG_K = 14


def gate_stream(
    events: DataFrame, root: str, qi: list[str], k: int = kanon.K, ttl_seconds: int = kanon.TTL_SECONDS,
    delay_seconds: int = 0, sweep: bool = True, trigger: dict | None = None, **options,
):
    """Arrival-mode gate over a stream; ``released_events`` reads what came out.

    A batch is ordered by event time and joined with the events still held. The sweep
    runs at the newest event time minus ``delay_seconds``; ``sweep=False`` never drops
    a run that is still open.
    """

    def step(batch: DataFrame, held: DataFrame | None, folder: BatchFolder) -> None:
        rows = batch if held is None else batch.unionByName(held)
        newest = batch.agg(F.max("ts").cast("timestamp").alias("t")).select(
            F.date_format(F.col("t") - F.make_dt_interval(secs=F.lit(delay_seconds)), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ).first()[0]
        labelled = folder.write(
            kanon.release_in_order(rows, qi, k, ttl_seconds=ttl_seconds, as_of=newest if sweep else None, **options), "labelled"
        )
        folder.write(labelled.where(F.col("status") == kanon.HELD).drop("status"), "held")
        counts = labelled.groupBy("status").agg(F.count("*").alias("events"))
        folder.write(counts.where(F.col("status") != kanon.HELD), "counts")

    return run_batches(events, step, root, state="held", trigger=trigger)


def released_events(spark: SparkSession, root: str) -> DataFrame:
    return read_part(spark, root, "labelled").where(F.col("status") == kanon.RELEASED).drop("status")


def decided_events(spark: SparkSession, root: str) -> DataFrame:
    """The events that were released or dropped, with their ``status``."""
    return read_part(spark, root, "labelled").where(F.col("status") != kanon.HELD)


def gate_counts(spark: SparkSession, root: str) -> DataFrame:
    """Released and dropped events so far."""
    return read_part(spark, root, "counts").groupBy("status").agg(F.sum("events").alias("events"))


def _fold_usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("customer_id", "month").agg(*[F.sum(x).alias(x) for x in usage.COUNTERS])


def usage_stream(log: DataFrame, root: str, trigger: dict | None = None):
    """Count usage; each batch adds fragments of the months it holds. Rows without a time count in a null month."""

    def step(batch: DataFrame, _, folder: BatchFolder) -> None:
        folder.add(usage.monthly_usage(batch), "usage", "month", _fold_usage)

    return run_batches(log, step, root, trigger=trigger)


def stored_usage(spark: SparkSession, root: str) -> DataFrame:
    return _fold_usage(read_live(spark, root, "usage"))


def publish_usage(spark: SparkSession, root: str, path: str) -> None:
    """Write the counters as a table by month, replacing the months that have counts."""
    io.write_by_day(stored_usage(spark, root), path, day="month")


def _visitors(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "visitor").agg(
        F.count_if(F.coalesce(F.col("event"), F.lit("pageview")) == "pageview").alias("pageviews")
    )


def _fold_visitors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "visitor").agg(F.sum("pageviews").alias("pageviews"))


def _fold_dimensions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "dimension", "key").agg(F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"))


def rollup_stream(events: DataFrame, root: str, trigger: dict | None = None):
    """Fold events into daily aggregates; the events themselves are not kept.

    Visitors are folded to one row per day and visitor, so uniques stay exact. Each batch
    adds fragments of the days it holds; events without a time belong to a null day.
    """

    def step(batch: DataFrame, _, folder: BatchFolder) -> None:
        folder.add(_visitors(batch), "visitors", "day", _fold_visitors)
        folder.add(rollup.daily_dimensions(batch), "dimensions", "day", _fold_dimensions)

    return run_batches(events, step, root, trigger=trigger)


def stored_totals(spark: SparkSession, root: str) -> DataFrame:
    return _fold_visitors(read_live(spark, root, "visitors")).groupBy("day").agg(
        F.sum("pageviews").alias("pageviews"), F.count("*").alias("uniques")
    )


def stored_dimensions(spark: SparkSession, root: str) -> DataFrame:
    return _fold_dimensions(read_live(spark, root, "dimensions")).select("day", "dimension", "key", "cnt", "first_seen")


def lane_stream(
    lines: DataFrame, root: str, schema: str = schemas.BEACON, required: tuple[str, ...] = io.REQUIRED, max_bytes: int | None = None,
    trigger: dict | None = None,
):
    """Split a stream of text lines into records (``accepted_records``) and rejected lines (``rejected_lines``)."""

    def step(batch: DataFrame, _, folder: BatchFolder) -> None:
        lanes = io.split_lines(batch, schema, required, max_bytes=max_bytes)
        folder.write(lanes.good, "accepted")
        folder.write(lanes.rejected, "rejected")

    return run_batches(lines, step, root, trigger=trigger)


def accepted_records(spark: SparkSession, root: str) -> DataFrame:
    return read_part(spark, root, "accepted")


def rejected_lines(spark: SparkSession, root: str) -> DataFrame:
    return read_part(spark, root, "rejected")


def sketch_stream(events: DataFrame, root: str, lg_k: int = SKETCH_LG_K, trigger: dict | None = None):
    """Unique visitors per day as sketches of a fixed size, beside the exact form of ``rollup_stream``.

    A day's state does not grow with its visitors: at most ``2 ** lg_k`` bytes a fragment;
    the standard error is about ``1.04 / sqrt(2 ** lg_k)``.
    """

    def step(batch: DataFrame, _, folder: BatchFolder) -> None:
        sketches = batch.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("visitor", lg_k).alias("sketch"))
        folder.add(sketches, "sketches", "day", _fold_sketches)

    return run_batches(events, step, root, trigger=trigger)


def _fold_sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.hll_union_agg("sketch").alias("sketch"))


def stored_uniques(spark: SparkSession, root: str) -> DataFrame:
    """Estimated unique visitors per day; days can be united further by ``hll_union_agg`` over ``sketch``."""
    return _fold_sketches(read_live(spark, root, "sketches")).withColumn("uniques", F.hll_sketch_estimate("sketch"))


def on_time(batch: DataFrame, folder: BatchFolder, delay_seconds: int, closes: Column, ts: str = "ts") -> DataFrame:
    """The rows of a batch whose time is still open; the others go to the part ``late``, so that every row is counted once.

    The watermark is the newest ``ts`` of all batches before, less the delay; it is kept in
    the part ``newest``. ``closes`` is when a row's window ends. Rows without a time are on time.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    before = folder.previous("newest")
    before = before.first()[0] if before is not None else None
    newest = batch.agg(F.max(at)).first()[0]
    known = [x for x in (before, newest) if x is not None]
    folder.write(batch.sparkSession.createDataFrame([(max(known, default=None),)], "us BIGINT"), "newest")
    late = F.lit(False)
    if before is not None:
        late = F.coalesce(F.unix_micros(closes.cast("timestamp")) <= before - delay_seconds * 1_000_000, F.lit(False))
    folder.write(batch.where(late), "late")
    return batch.where(~late)


def closed_days_stream(events: DataFrame, root: str, delay_seconds: int, trigger: dict | None = None):
    """Daily totals that do not change once the watermark has passed their day; later rows are kept aside and counted.

    ``stored_totals`` has the days, ``late_rows`` what came too late: together they hold every row.
    """

    def step(batch: DataFrame, _, folder: BatchFolder) -> None:
        day_end = F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")
        rows = on_time(batch, folder, delay_seconds, day_end)
        folder.add(_visitors(rows), "visitors", "day", _fold_visitors)

    return run_batches(events, step, root, trigger=trigger)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return read_part(spark, root, "late")


def closed_day_totals(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Append-mode totals of days that the watermark has passed, with exact uniques.

    Two chained aggregations: first per day and visitor, then per day, so a day's
    visitors are spread over all tasks. Later rows of a closed day are dropped.
    """
    day = F.window("ts", "1 day")
    per_visitor = (
        events.withWatermark("ts", delay).groupBy(day.alias("w"), "visitor")
        .agg(F.count_if(F.coalesce(F.col("event"), F.lit("pageview")) == "pageview").alias("pageviews"))
    )
    per_day = per_visitor.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.sum("pageviews").alias("pageviews"), F.count("*").alias("uniques")
    )
    return per_day.select(F.to_date("d.start").alias("day"), "pageviews", "uniques")


def fixed_limit_stream(
    hits: DataFrame, root: str, limit: int, seconds: int, late_seconds: int = 3600, trigger: dict | None = None
):
    """Fixed-window limit across batches: the state is the accepted count per open window.

    Counts are kept for windows up to ``late_seconds`` behind the newest hit of all
    batches before. A hit behind them is refused, since its window's count is gone;
    ``late_hits`` has them.
    """

    def step(batch: DataFrame, used: DataFrame | None, folder: BatchFolder) -> None:
        window = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
        last = used.agg(F.max("window")).first()[0] if used is not None else None
        if last is not None:
            behind = F.coalesce(window < last - late_seconds // seconds - 1, F.lit(False))
            folder.write(batch.where(behind), "late")
            batch = batch.where(~behind)
        heads = limits.fixed_window_allowed(batch, limit, seconds).withColumn("window", window)
        if used is None:
            used = batch.sparkSession.createDataFrame([], f"key {dict(batch.dtypes)['key']}, window BIGINT, used BIGINT")
        # The accepted hits of a window are its first ones, so ranks only move by the old count.
        w = Window.partitionBy("key", "window").orderBy("ts", "hit_id")
        ranked = heads.withColumn("_rank", F.row_number().over(w)).join(used, ["key", "window"], "left")
        passed = ranked.where(F.col("_rank") + F.coalesce("used", F.lit(0)) <= limit)
        out = folder.write(passed.select("hit_id", "key", "ts", "window"), "allowed")
        new = out.groupBy("key", "window").agg(F.count("*").alias("used"))
        merged = used.unionByName(new).groupBy("key", "window").agg(F.sum("used").alias("used"))
        ends = [x for x in (batch.agg(F.max(window)).first()[0], last) if x is not None]
        oldest = max(ends) - late_seconds // seconds - 1 if ends else 0
        folder.write(merged.where(F.col("window") >= oldest), "used")

    return run_batches(hits, step, root, state="used", trigger=trigger)


def renewing_limit_stream(hits: DataFrame, root: str, limit: int, seconds: int, trigger: dict | None = None):
    """Renewing limit across batches: the state is the counter of every key that may still be alive.

    A hit two lifetimes or more behind the newest hit of all batches before is refused and
    listed in ``late_hits``. A hit that is not refused can meet a counter up to one lifetime
    older than itself, so counters are kept for three. The newest hit time, accepted or not,
    is stored beside the counters, and both borders are taken from it.
    """

    def step(batch: DataFrame, state: DataFrame | None, folder: BatchFolder) -> None:
        at = F.unix_timestamp(F.col("ts").cast("timestamp"))
        before = folder.previous("newest").first()[0] if state is not None else None
        if before is not None:
            behind = F.coalesce(at <= before - 2 * seconds, F.lit(False))
            folder.write(batch.where(behind), "late")
            batch = batch.where(~behind)
        counters = folder.write(limits.renewing_counters(batch, limit, seconds, state=state), "counters")
        folder.write(limits.renewing_allowed(batch, counters, limit), "allowed")
        live = counters.select("key", F.col("last").alias("second"), "used")
        if state is not None:
            live = live.unionByName(state)
        latest = live.groupBy("key").agg(F.max(F.struct("second", "used")).alias("s")).select("key", "s.second", "s.used")
        ends = [x for x in (batch.agg(F.max(at)).first()[0], before) if x is not None]
        end = max(ends, default=None)
        folder.write(batch.sparkSession.createDataFrame([(end,)], "second BIGINT"), "newest")
        folder.write(latest if end is None else latest.where(F.col("second") > end - 3 * seconds), "state")

    return run_batches(hits, step, root, state="state", trigger=trigger)


def allowed_hits(spark: SparkSession, root: str) -> DataFrame:
    return read_part(spark, root, "allowed")


def late_hits(spark: SparkSession, root: str) -> DataFrame:
    """Hits refused because the counts of their time were already dropped; the part exists from the second batch on."""
    return read_part(spark, root, "late")


def first_uses(attestations: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """First use of every nonce on a stream."""
    return attestations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["nonce"])


def first_activations(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First activation per email on a stream."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["email"])


def revoked_stream(
    requests: DataFrame, revocations: DataFrame, root: str, hours: int = accounts.REVOKED_HOURS, late_seconds: int = 3600, trigger: dict | None = None
):
    """Drop requests whose key was revoked less than ``hours`` before, both sides being streams.

    A batch meets the revocations that came before or with it; those are the state, each
    for ``hours`` and ``late_seconds``, and then forgotten. A request ``late_seconds`` or
    more behind the newest time of all batches before might have lost its revocation: it is not
    passed on but set aside (``late_rows``). ``passed_requests`` has the others.
    """
    request, revocation = (f"STRUCT<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.schema)}>" for df in (requests, revocations))
    both = requests.select(F.struct("*").alias("request"), F.lit(None).cast(revocation).alias("revocation")).unionByName(
        revocations.select(F.lit(None).cast(request).alias("request"), F.struct("*").alias("revocation"))
    )

    def step(batch: DataFrame, state: DataFrame | None, folder: BatchFolder) -> None:
        asked = batch.where("request IS NOT NULL").select("request.*")
        known = batch.where("revocation IS NOT NULL").select("revocation.key_hash", "revocation.revoked_at")
        known = (known if state is None else known.unionByName(state)).distinct()
        in_time = on_time(asked, folder, late_seconds, F.col("ts"))
        folder.write(accounts.drop_revoked(in_time, known, hours), "passed")
        newest = F.lit(folder.previous("newest", folder.batch_id).first()[0])
        ends = F.unix_micros(F.col("revoked_at").cast("timestamp")) + (hours * 3600 + late_seconds) * 1_000_000
        folder.write(known.where(newest.isNull() | (ends > newest)), "revocations")

    return run_batches(both, step, root, state="revocations", trigger=trigger)


def passed_requests(spark: SparkSession, root: str) -> DataFrame:
    return read_part(spark, root, "passed")


def suspicious_stream(
    failures: DataFrame, source: str = "source", ts: str = "ts", threshold: int = limits.SUSPICIOUS_FAILURES,
    seconds: int = limits.SUSPICIOUS_SECONDS, delay: str = "1 hour",
) -> DataFrame:
    """Failure runs of ``limits.suspicious_sources`` as session windows of a stream, in append mode.

    A run is given out when the watermark has passed its end; a failure that comes late,
    but within ``delay``, still joins the runs on both its sides.
    """
    # Windows that touch are one session; a failure exactly ``seconds`` later opens a new run.
    gap = f"{seconds * 1_000_000 - 1} microseconds"
    runs = failures.withWatermark(ts, delay).groupBy(source, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("first_failure"), F.max(ts).alias("last_failure"), F.count("*").alias("failures")
    )
    return runs.select(
        source, "first_failure", "last_failure", "failures",
        F.greatest(F.col("failures") - (threshold - 1), F.lit(0)).cast("bigint").alias("flagged"), (F.col("failures") >= threshold).alias("suspicious"),
    )
