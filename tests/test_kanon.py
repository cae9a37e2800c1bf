import functools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kveil.operators import kanon
from kveil.operators.skew import hot_key_join

US = 1_000_000


def brute_force(rows, k, ttl, sweep, as_of):
    """The gate, one event at a time: rows are (bucket, us, id, visitor)."""
    out, open_runs = {}, {}
    for bucket, us, i, visitor in sorted(rows):
        run = open_runs.get(bucket)
        if run and us // sweep >= (run["first"] + ttl) // sweep + 1:
            out.update(dict.fromkeys(run["ids"], "dropped"))
            run = None
        run = run or {"first": us, "ids": [], "seen": set()}
        open_runs[bucket] = run
        run["ids"].append(i)
        run["seen"].add(visitor)
        if len(run["seen"]) >= k:
            out.update(dict.fromkeys(run["ids"], "released"))
            del open_runs[bucket]
    for run in open_runs.values():
        late = as_of is not None and ((run["first"] + ttl) // sweep + 1) * sweep <= as_of
        out.update(dict.fromkeys(run["ids"], "dropped" if late else "held"))
    return out


def gate(spark, rows, **options):
    df = spark.createDataFrame(rows, "b string, us long, event_id long, visitor string").withColumn("ts", F.timestamp_micros("us"))
    return kanon.release_in_order(df, ["b"], **options)


def status(spark, rows, **options):
    return {r.event_id: r.status for r in gate(spark, rows, **options).collect()}


def rows_of(visitors, bucket="x", step=US):
    return [(bucket, i * step, i, v) for i, v in enumerate(visitors)]


def test_held_below_k_and_released_at_k(spark):
    assert set(status(spark, rows_of("ab"), k=3).values()) == {"held"}
    assert set(status(spark, rows_of("abc"), k=3).values()) == {"released"}
    assert list(status(spark, rows_of("aabc"), k=3).values()) == ["released"] * 4


def test_counting_restarts_after_a_release(spark):
    out = status(spark, rows_of("abc"), k=2)
    assert [out[i] for i in range(3)] == ["released", "released", "held"]


def test_sweep_drops_what_waits_too_long(spark):
    rows = [("x", 36_000 * US, 0, "a"), ("x", (36_000 + 31 * 60) * US, 1, "b")]
    assert status(spark, rows, k=2) == {0: "dropped", 1: "held"}
    assert status(spark, rows[:1], k=5, as_of="1970-01-01 10:31:00") == {0: "dropped"}
    assert status(spark, rows[:1], k=5, as_of="1970-01-01 10:30:00") == {0: "held"}


def test_k_must_protect(spark):
    with pytest.raises(ValueError):
        gate(spark, rows_of("ab"), k=1)


@pytest.mark.parametrize("seed,k,ttl,chunks,bot,fan", [(0, 3, 1800, 8, 0.5, 64), (1, 3, 600, 40, 0.97, 3), (2, 5, 1800, 13, 0.0, 4)])
def test_heavy_bucket_over_many_chunks_equals_brute_force(spark, seed, k, ttl, chunks, bot, fan):
    r = random.Random(seed)
    rows = [
        (r.choice(["hot", "hot", "a", f"c{r.randrange(50)}"]), r.randrange(7200) * US, i, "bot" if r.random() < bot else f"v{r.randrange(30)}")
        for i in range(3000)
    ]
    got = status(spark, rows, k=k, ttl_seconds=ttl, as_of="1970-01-01 02:00:00", chunks=chunks, fan=fan)
    assert got == brute_force(rows, k, ttl * US, 60 * US, 7200 * US)


events = st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abcd")), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(events, st.integers(2, 4), st.integers(1, 20), st.integers(1, 5), st.lists(st.integers(1, 59), max_size=6))
def test_any_cut_into_chunks_gives_the_same_labels(rows, k, ttl, sweep, cuts):
    rows = sorted(rows)
    want = brute_force([("x", t, i, v) for i, (t, v) in enumerate(rows)], k, ttl, sweep, None)
    g = kanon.Gate(k, ttl, sweep, None)
    marks = sorted({0, len(rows), *[c for c in cuts if c < len(rows)]})
    parts = [rows[a:b] for a, b in zip(marks, marks[1:])]
    columns = [([t for t, _ in p], [v for _, v in p]) for p in parts]
    summaries = [json.loads(json.dumps(kanon._summary(g, ts, who, True))) for ts, who in columns]
    assert all(len(s["sweeps"]) <= ttl // sweep + 3 and len(s["heads"]) <= k for s in summaries)
    states = kanon._fold(g, summaries)
    got = [s for (ts, who), state in zip(columns, states) for s in kanon._label(g, ts, who, state)]
    assert got == [want[i] for i in range(len(rows))]
    # The same states by way of a tree, and composition in any grouping.
    for fan in (2, 3):
        assert by_tree(g, summaries, fan) == states
    if len(summaries) > 2:
        a, b, c = summaries[:3]
        assert kanon._compose(g, kanon._compose(g, a, b), c) == kanon._compose(g, a, kanon._compose(g, b, c))


def by_tree(gate, summaries, fan, run=None, final=None):
    if len(summaries) <= fan:
        return kanon._fold(gate, summaries, run, final)
    parts = [summaries[i : i + fan] for i in range(0, len(summaries), fan)]
    whole = [functools.reduce(lambda a, b: kanon._compose(gate, a, b), p) for p in parts]
    assert all(len(s["sweeps"]) <= gate.ttl // gate.sweep + 3 for s in whole)
    above = by_tree(gate, whole, fan, run, final)
    return [
        s for part, e in zip(parts, above)
        for s in kanon._fold(gate, part, [e["tokens"], e["first_ts"]] if e["first_ts"] is not None else None, e["exit_outcome"])
    ]


def test_buckets_are_released_whole(spark):
    r = random.Random(5)
    rows = [(f"b{r.randrange(20)}", r.randrange(3000) * US, i, f"v{r.randrange(9)}") for i in range(120)]
    df = spark.createDataFrame(rows, "b string, us long, event_id long, visitor string").withColumn("ts", F.timestamp_micros("us"))
    whole = kanon.release_buckets(df, ["b"], 4)
    sizes = {r.b: r.visitors for r in kanon.bucket_sizes(df, ["b"]).collect()}
    assert {r.event_id for r in whole.collect()} == {i for b, _, i, _ in rows if sizes[b] >= 4}
    in_order = gate(spark, rows, k=4, ttl_seconds=10_000).where("status = 'released'")
    assert in_order.join(whole, "event_id", "left_anti").count() == 0
    assert whole.groupBy("b").agg(F.count_distinct("visitor").alias("n")).where("n < 4").count() == 0


def test_null_and_pipe_in_quasi_identifiers(spark):
    rows = [("a|b", "c", 1, "v1"), ("a", "b|c", 2, "v2"), (None, "x", 3, "v1"), (None, "x", 4, "v2")]
    df = spark.createDataFrame(rows, "p string, q string, event_id long, visitor string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert sorted(r.event_id for r in kanon.release_buckets(df, ["p", "q"], 2).collect()) == [3, 4]


def test_hot_keys_are_salted_and_complete(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    groups = facts.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7")
    got = hot_key_join(facts, groups, ["k"], "n", ["id"], hot_rows=100)
    assert got.count() == facts.where("k <> 7").count() == got.select("id").distinct().count()


def test_gate_state(spark):
    out = kanon.gate_state(gate(spark, rows_of("ab") + [("y", 5, 9, "q")], k=3), ["b"], 3).first()
    assert (out.k, out.open_buckets, out.buffered_events) == (3, 2, 3)
