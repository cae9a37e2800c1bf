import datetime
import os
import subprocess
import sys

from pyspark.sql import functions as F

from kveil.operators import kanon, limits, rollup, usage
from kveil.streaming import jobs


def feed(spark, df, path, parts, order):
    """Write ``df`` as ordered files, one per future batch, and stream them one by one."""
    for i in range(parts):
        df.where(F.col(order) % parts == i if isinstance(order, str) else order(i)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def timeline(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 40).alias("ts"),
        F.concat(F.lit("v"), F.pmod(F.hash("id"), F.lit(9))).alias("visitor"), F.concat(F.lit("b"), F.pmod(F.hash("id", F.lit(1)), F.lit(7))).alias("b"),
        F.lit("pageview").alias("event"), F.lit("/").alias("path"), F.lit("").alias("referrer"), F.lit("NL").alias("country"), F.lit("desktop").alias("device"),
    )


def by_time(df, parts):
    size = df.count() // parts + 1
    return lambda i: (F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size)


def test_gate_over_batches_equals_history(spark, tmp_path):
    df = timeline(spark)
    stream = feed(spark, df, str(tmp_path / "in"), 3, by_time(df, 3))
    root = str(tmp_path / "out")
    jobs.gate_stream(stream, root, ["b"], 4, ttl_seconds=1800, chunks=4).awaitTermination()
    history = kanon.release_in_order(df, ["b"], 4, ttl_seconds=1800)
    want = sorted(r.event_id for r in history.where("status = 'released'").collect())
    assert sorted(r.event_id for r in jobs.released_events(spark, root).collect()) == want
    assert {r.status: r.events for r in jobs.gate_counts(spark, root).collect()}["released"] == len(want)


def test_usage_over_batches(spark, tmp_path):
    log = timeline(spark).select("event_id", F.col("b").alias("customer_id"), "ts", F.lit("strip").alias("action"))
    jobs.usage_stream(feed(spark, log, str(tmp_path / "in"), 3, "event_id"), str(tmp_path / "out")).awaitTermination()
    assert sorted(jobs.stored_usage(spark, str(tmp_path / "out")).collect()) == sorted(usage.monthly_usage(log).collect())
    jobs.publish_usage(spark, str(tmp_path / "out"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).agg(F.sum("requests")).first()[0] == 400


def test_rollup_over_batches(spark, tmp_path):
    df = timeline(spark, 4000)
    jobs.rollup_stream(feed(spark, df, str(tmp_path / "in"), 3, "event_id"), str(tmp_path / "out")).awaitTermination()
    assert sorted(jobs.stored_totals(spark, str(tmp_path / "out")).collect()) == sorted(rollup.daily_totals(df).collect())
    assert sorted(jobs.stored_dimensions(spark, str(tmp_path / "out")).collect()) == sorted(rollup.daily_dimensions(df).select("day", "dimension", "key", "cnt", "first_seen").collect())


def test_closed_days_only(spark, tmp_path):
    df = timeline(spark, 6000)
    stream = feed(spark, df, str(tmp_path / "in"), 2, by_time(df, 2))
    q = jobs.closed_day_totals(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.day: (r.pageviews, r.uniques) for r in rollup.daily_totals(df).collect()}
    got = {r.day: (r.pageviews, r.uniques) for r in spark.table("closed").collect()}
    assert got and max(got) < max(want) and all(want[d] == v for d, v in got.items())


def test_limits_over_batches(spark, tmp_path):
    hits = timeline(spark).select(F.col("event_id").alias("hit_id"), F.col("b").alias("key"), "ts", "event_id")
    stream = feed(spark, hits, str(tmp_path / "in"), 3, by_time(hits, 3))
    jobs.fixed_limit_stream(stream, str(tmp_path / "fixed"), 3, 3600).awaitTermination()
    jobs.renewing_limit_stream(stream, str(tmp_path / "renewing"), 2, 900).awaitTermination()
    fixed = limits.fixed_window_limit(hits, 3, 3600).where("allowed")
    renewing = limits.renewing_limit(hits, 2, 900).where("allowed")
    for name, want in (("fixed", fixed), ("renewing", renewing)):
        got = sorted(r.hit_id for r in jobs.allowed_hits(spark, str(tmp_path / name)).collect())
        assert got == sorted(r.hit_id for r in want.collect()), name


def test_first_uses(spark, tmp_path):
    rows = timeline(spark, 50).select("ts", F.col("visitor").alias("nonce"))
    stream = feed(spark, rows.coalesce(1), str(tmp_path / "in"), 1, lambda i: F.lit(True))
    q = jobs.first_uses(stream, "1 day").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == rows.select("nonce").distinct().count()
    assert isinstance(spark.table("firsts").first().ts, datetime.datetime)


def test_late_hits_are_refused(spark, tmp_path):
    def hits(rows):
        return spark.createDataFrame(rows, "hit_id long, key string, s long").select("hit_id", "key", F.timestamp_seconds("s").alias("ts"))

    path, start = str(tmp_path / "in"), 1_704_067_200
    for rows in ([(1, "a", start), (2, "a", start + 9000)], [(3, "a", start + 10), (4, "a", start + 9001)], [(5, "a", start + 20)]):
        hits(rows).coalesce(1).write.mode("append").parquet(path)
    for name, run in (("fixed", jobs.fixed_limit_stream), ("renewing", jobs.renewing_limit_stream)):
        root = str(tmp_path / name)
        stream = spark.readStream.schema(hits([(1, "a", 0)]).schema).option("maxFilesPerTrigger", 1).parquet(path)
        run(stream, root, 5, 60).awaitTermination()
        assert sorted(r.hit_id for r in jobs.allowed_hits(spark, root).collect()) == [1, 2, 4]
        assert sorted(r.hit_id for r in jobs.late_hits(spark, root).collect()) == [3, 5]


def test_late_hit_meets_its_counter(spark, tmp_path):
    def hits(rows):
        return spark.createDataFrame(rows, "hit_id long, key string, s long").select("hit_id", "key", F.timestamp_seconds("s").alias("ts"))

    start = 1_704_067_200
    cases = {
        # One to two lifetimes late: hit 3 falls under the counter of hit 1, hit 4 does not.
        "late": ([[(1, "a", 0), (2, "b", 120)], [(3, "a", 30), (4, "a", 61)], [(5, "a", 62), (6, "b", 181)]], []),
        # The newest hit is a denied one; hit 4 is two lifetimes behind it.
        "denied": ([[(1, "a", -35), (2, "c", 100), (3, "c", 150)], [(4, "a", 20), (5, "c", 161)]], [4]),
    }
    for name, (batches, refused) in cases.items():
        batches = [[(i, k, start + s) for i, k, s in rows] for rows in batches]
        path, root = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        for rows in batches:
            hits(rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(hits(batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
        jobs.renewing_limit_stream(stream, root, 1, 60).awaitTermination()
        assert sorted(r.hit_id for r in jobs.late_hits(spark, root).collect()) == refused, name
        walk = limits.renewing_limit(hits([r for rows in batches for r in rows if r[0] not in refused]), 1, 60).where("allowed")
        got = sorted(r.hit_id for r in jobs.allowed_hits(spark, root).collect())
        assert got == sorted(r.hit_id for r in walk.collect()), name


def test_carried_counter_never_gets_older(spark):
    hits = spark.createDataFrame([(1, "a", 50)], "hit_id long, key string, s long").select("hit_id", "key", F.timestamp_seconds("s").alias("ts"))
    state = spark.createDataFrame([("a", 100, 1)], "key string, second long, used long")
    row = limits.renewing_counters(hits, 5, 60, state=state).first()
    assert (row.second, row.accepted, row["last"], row.used) == (50, 1, 100, 2)


def test_folded_fragments_can_go(spark, tmp_path):
    from kveil.streaming import batches

    log = timeline(spark).select("event_id", F.col("b").alias("customer_id"), "ts", F.lit("strip").alias("action"))
    log = log.withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    root, steps = str(tmp_path / "out"), 2 * batches.FAN + 3
    jobs.usage_stream(feed(spark, log, str(tmp_path / "in"), steps, "event_id"), root).awaitTermination()
    want = sorted(usage.monthly_usage(log).collect(), key=str)
    assert sorted(jobs.stored_usage(spark, root).collect(), key=str) == want
    live = batches.manifest(spark, root)["usage"]["live"]
    # Two keys, one of them null; each was folded twice.
    assert len({folder for folder, _, _ in live}) == 2 and max(level for _, _, level in live) == 1 and len(live) < 2 * batches.FAN
    files = len(batches.read_live(spark, root, "usage").inputFiles())
    assert files == len(live)  # readers open live files only
    assert batches.drop_superseded(spark, root, "usage") > 0 and batches.drop_superseded(spark, root, "usage") == 0
    assert sorted(jobs.stored_usage(spark, root).collect(), key=str) == want


def test_a_batch_without_manifest_did_not_happen(spark, tmp_path):
    from kveil.streaming import batches

    root, fold = str(tmp_path / "out"), lambda r: r.groupBy("day").agg(F.sum("n").alias("n"))
    def rows(n):
        return spark.createDataFrame([("x", n), (None, n)], "day string, n long")

    for batch, commit in ((0, True), (1, False)):
        folder = batches.BatchFolder(spark, root, batch)
        folder.add(rows(1), "a", "day", fold)
        if commit:
            folder.add(rows(1), "b", "day", fold)
            folder.commit()
    # The second batch stopped between its parts: both read as after the first.
    assert [fold(batches.read_live(spark, root, p)).agg(F.sum("n")).first()[0] for p in "ab"] == [2, 2]
    for _ in range(2):  # replayed, even twice, it counts once
        folder = batches.BatchFolder(spark, root, 1)
        for part in "ab":
            folder.add(rows(5), part, "day", fold)
        folder.commit()
    assert [sorted(fold(batches.read_live(spark, root, p)).collect(), key=str) for p in "ab"] == [[("x", 6), (None, 6)]] * 2


def test_sketches_unite(spark, tmp_path):
    df = timeline(spark, 4000).withColumn("visitor", F.concat(F.lit("v"), F.col("event_id")))
    jobs.sketch_stream(feed(spark, df, str(tmp_path / "in"), 3, "event_id"), str(tmp_path / "out")).awaitTermination()
    stored = jobs.stored_uniques(spark, str(tmp_path / "out"))
    for r in stored.join(rollup.daily_totals(df).withColumnRenamed("uniques", "exact"), "day").collect():
        assert abs(r["uniques"] - r["exact"]) <= 1 + 0.035 * r["exact"] and len(r["sketch"]) <= 2 ** jobs.SKETCH_LG_K + 64
    whole = stored.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).first()[0]
    assert abs(whole - 4000) <= 0.035 * 4000


def test_late_rows_are_counted(spark, tmp_path):
    df = timeline(spark, 6000)
    days = [F.col("event_id") < 4500, (F.col("event_id") >= 4500) | (F.col("event_id") == 7)]
    stream = feed(spark, df, str(tmp_path / "in"), 2, lambda i: days[i])
    jobs.closed_days_stream(stream, str(tmp_path / "out"), 3600).awaitTermination()
    assert [r.event_id for r in jobs.late_rows(spark, str(tmp_path / "out")).collect()] == [7]
    assert sorted(jobs.stored_totals(spark, str(tmp_path / "out")).collect()) == sorted(rollup.daily_totals(df).collect())


def test_revocations_are_forgotten(spark, tmp_path):
    from kveil.functions.anonymize import short_hash

    start = 1_704_067_200

    def batch(rows):
        return spark.createDataFrame(rows, "kind string, id long, api_key string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + start)).drop("s")

    hour = 3600
    batches_ = [
        [("revoke", 0, "a", 10), ("ask", 1, "a", 5), ("ask", 2, "a", 20), ("ask", 3, "b", 30)],
        [("ask", 4, "a", 23 * hour), ("ask", 5, "a", 24 * hour + 10), ("revoke", 0, "b", 23 * hour)],
        [("ask", 6, "b", 40 * hour), ("ask", 7, "a", 2 * hour)],
        [("ask", 8, "b", 60 * hour)],
    ]
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches_:
        batch(rows).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batch(batches_[0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    asked = stream.where("kind = 'ask'").select("id", "api_key", "ts")
    revoked = stream.where("kind = 'revoke'").select(short_hash(F.col("api_key")).alias("key_hash"), F.col("ts").alias("revoked_at"))
    # Both sides read the same files; a trigger takes one file of each.
    jobs.revoked_stream(asked, revoked, root).awaitTermination()
    assert sorted(r.id for r in jobs.passed_requests(spark, root).collect()) == [1, 3, 5, 8]
    assert [r.id for r in jobs.late_rows(spark, root).collect()] == [7]  # its revocation may be forgotten: not passed
    assert [spark.read.parquet(f"{root}/revocations/batch={i}").count() for i in range(4)] == [1, 2, 1, 0]


def test_a_late_failure_joins_two_runs(spark, tmp_path):
    def failures(rows):
        return spark.createDataFrame(rows, "source string, s long").select("source", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"))

    path = str(tmp_path / "in")
    for rows in ([("x", 0), ("x", 100), ("y", 0), ("y", 60)], [("x", 50), ("z", 500)], [("z", 10_000)]):
        failures(rows).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(failures([("x", 0)]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.suspicious_stream(stream, threshold=3, seconds=60, delay="10 minutes")
    q = out.writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.source, r.failures, r.suspicious) for r in spark.table("runs").collect()}
    # Exactly 60 seconds apart are two runs.
    assert got == {("x", 3, True), ("y", 1, False), ("z", 1, False)}
    assert spark.table("runs").where("source = 'y'").count() == 2


def test_keyed_gate_equals_history(spark, tmp_path):
    from kveil.streaming import keyed

    df = timeline(spark).withColumn("visitor", F.when(F.col("event_id") % 11 != 0, F.col("visitor")))
    stream = feed(spark, df, str(tmp_path / "in"), 3, by_time(df, 3))
    out = keyed.keyed_gate(stream, ["b"], 4, ttl_seconds=1800)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    end = df.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    want = kanon.release_in_order(df, ["b"], 4, ttl_seconds=1800, as_of=end).where("status <> 'held'")
    rows = {(r.event_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(r.event_id, r.status) for r in want.collect()} and {s for _, s in rows} == {"released", "dropped"}


def test_a_restarted_stream_keeps_the_salts_of_open_days(spark, tmp_path):
    from kveil.streaming.batches import read_part
    from kveil.streaming.salts import SaltVault, event_stream

    hour, start = 3600, 1_704_067_200
    visits = spark.createDataFrame(
        [(i, start + s, "10.0.0.9", "Firefox", "https://a.nl", "pageview", "/", "", "NL", "{}") for i, s in ((1, 0), (2, 5 * hour), (3, 20 * hour), (4, 30 * hour), (5, 23 * hour), (6, 31 * hour))],
        "event_id long, s long, ip string, ua string, origin string, e string, u string, r string, country string, p string",
    ).select("*", F.timestamp_seconds("s").alias("ts"), F.lit(None).cast("string").alias("d")).drop("s")
    path, root, secret = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "secret" / "salts.json")
    held = []
    for ids in ([1], [2, 3], [4], [5, 6]):
        visits.where(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(path)
        vault = SaltVault(spark, secret)  # as after a restart
        event_stream(spark.readStream.schema(visits.schema).parquet(path), root, vault, hour).awaitTermination()
        held.append(sorted(vault.epochs()))
    tokens = {r.event_id: r.visitor for r in read_part(spark, root, "events").collect()}
    assert tokens[1] == tokens[2] == tokens[3] and tokens[4] == tokens[6] != tokens[1]
    # The first day was over for the watermark when visit 5 came: refused, with no token at all.
    assert 5 not in tokens and [r.event_id for r in jobs.late_rows(spark, root).collect()] == [5]
    assert held == [[19723], [19723], [19723, 19724], [19724]]


_PLAIN_GATE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from kveil.session import ship_package
from kveil.streaming import keyed

root = sys.argv[2]
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}).getOrCreate()
ship_package(spark)
rows = [(i, "x" if i < 4 else "y", f"v{i % 2}") for i in range(6)]
df = spark.createDataFrame(rows, "event_id long, b string, visitor string").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_704_067_200))
df.write.parquet(f"{root}/in")
out = keyed.keyed_gate(spark.readStream.schema(df.schema).parquet(f"{root}/in"), ["b"], 2, ttl_seconds=1800)
out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
assert sorted(map(tuple, spark.read.parquet(f"{root}/out").collect())) == [(i, "released") for i in range(6)]
"""


def test_keyed_gate_runs_in_a_session_of_others(tmp_path):
    """A session with Spark's defaults, started outside the repository and without it on the workers' path."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", _PLAIN_GATE, repo, str(tmp_path / "gate")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
