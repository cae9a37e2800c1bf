from pyspark.sql import functions as F

from kveil.functions.anonymize import SaltBook
from kveil.operators import audit, rollup, usage
from kveil.plans import reports
from kveil.sources import io, schemas

EVENT = "event_id long, ts timestamp, visitor string, event string, path string, country string, device string, referrer string"


def events(spark, rows):
    df = spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_report_of_two_page_views(spark):
    rows = [
        (1, "2024-01-01 10:00:00", "a", "pageview", "/", "NL", "desktop", ""),
        (2, "2024-01-01 11:00:00", "b", "pageview", "/", "NL", "mobile", "https://google.com/x"),
        (3, "2024-01-01 12:00:00", "b", "click", "", "NL", "mobile", "not a url"),
    ]
    report = rollup.daily_report(events(spark, rows)).first()
    assert (report.pageviews, report.uniques) == (2, 2)
    assert [(e.key, e["count"]) for e in report.top_referrers] == [("(direct)", 1), ("google.com", 1), ("(other)", 1)]
    assert [(e.key, e["count"]) for e in report.top_pages] == [("/", 2)]  # the empty path is not counted


def test_ties_keep_first_seen_order_and_ten_keys(spark):
    rows = [(i, f"2024-01-01 10:00:{i:02d}", "a", "pageview", f"/{(i * 7) % 12}", "NL", "desktop", "") for i in range(12)]
    top = rollup.top_keys(rollup.daily_dimensions(events(spark, rows))).where("dimension = 'page'").orderBy("rank").collect()
    assert [r.key for r in top] == [f"/{(i * 7) % 12}" for i in range(10)]


def test_retention_counts_present_days(spark):
    days = spark.createDataFrame([(f"2024-0{m}-{d:02d}",) for m in (1, 3) for d in range(1, 21)], "day string").withColumn("day", F.to_date("day"))
    kept = [str(r.day) for r in rollup.retain_days(days, 30).orderBy("day").collect()]
    assert len(kept) == 30 and kept[0] == "2024-01-11"


def test_range_fills_gaps(spark):
    totals = spark.createDataFrame([("2024-01-05", 3, 2), ("2023-12-01", 9, 9)], "day string, pageviews long, uniques long").withColumn("day", F.to_date("day"))
    out = rollup.report_range(totals, "2024-01-06").orderBy("day").collect()
    assert [(str(r.day)[-2:], r.pageviews) for r in out] == [("31", 0), ("01", 0), ("02", 0), ("03", 0), ("04", 0), ("05", 3), ("06", 0)]


def test_floor_on_dimensions(spark):
    rows = [(i, "2024-01-01 10:00:00", v, "pageview", "/", "NL", "desktop", r) for i, (v, r) in enumerate([("a", ""), ("b", ""), ("c", "https://rare.nl")])]
    kept = rollup.daily_dimensions(events(spark, rows), min_visitors=2).where("dimension = 'referrer'").collect()
    assert [r.key for r in kept] == ["(direct)"]


def test_flow_from_beacon_files_to_report(spark, tmp_path):
    lines = [
        f'{{"event_id":{i},"ts":"2024-01-01T10:{i:02d}:00Z","ip":"10.0.{i}.9","ua":"Firefox","origin":"https://shop.nl","e":"pageview","u":"/p?gclid={i}","r":"","country":"nl","p":"{{}}"}}'
        for i in range(6)
    ] + ['{"event_id":99,"ts":"2024-01-01T10:59:00Z","ip":"10.9.9.9","ua":"x","origin":"https://shop.nl","e":"pageview","u":"/rare","country":"is"}']
    (tmp_path / "b.json").write_text("\n".join(lines))
    visits = io.read_beacons(spark, str(tmp_path))
    report = reports.arrival_report(visits, SaltBook().cover([19723]), k=3).first()
    assert report.pageviews == 6 and report.uniques == 6
    assert [(e.key, e["count"]) for e in report.top_pages] == [("/p", 6)]
    top = reports.top_keys_report(visits, SaltBook().cover([19723]), ["event", "path"], 3).where("dimension = 'country'").collect()
    assert [(r.key, r.cnt) for r in top] == [("NL", 6)]


def test_every_line_has_a_lane(spark):
    good = '{"event_id":1,"ts":"2024-01-01T00:00:00Z","ip":"1.1.1.1","p":{"a":1}}'
    lines = {
        good: None, "  " + good + " ": None, "": "empty", " \t": "empty", good[:-5]: "broken", good + good: "broken", good + "," + good: "broken",
        good + " x": "broken", "{'ts':'2024-01-01T00:00:00Z'}": "broken", '{"ts":NaN}': "broken", "GET /": "broken", "[" + good + "]": "no_object",
        "17": "no_object", '"text"': "no_object", "null": "no_object", '{"ts":"yesterday"}': "bad_field", '{"ts":["x"]}': "bad_field", "{}": "incomplete",
        '{"ts":null,"e":"x"}': "incomplete", '{"other":1}': "incomplete", good[:-1] + ',"u":"' + "x" * 200 + '"}': "too_long",
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, None])], "n int, value string")
    judged = io.judge_lines(df, schemas.BEACON, max_bytes=200).orderBy("n").collect()
    assert [r.reason for r in judged] == [*lines.values(), "empty"]
    assert all((r.rec is not None) == (r.reason is None) for r in judged)
    lanes = io.split_lines(df, schemas.BEACON, max_bytes=200)
    counts = {r.reason: r.lines for r in io.rejected_counts(lanes.rejected).collect()}
    assert lanes.good.count() + sum(counts.values()) == len(lines) + 1 and counts["broken"] == 7
    assert lanes.good.columns[0] == "event_id" and lanes.good.first().p == '{"a":1}'


def test_messages_and_json_lists(spark):
    messages = spark.createDataFrame([('{"ts":"2024-01-01T00:00:00Z","ip":"1.1.1.1"}',), ("nonsense",)], "value string")
    assert io.parse_beacon_messages(messages).count() == 1
    lines = spark.createDataFrame([("h", '{"ts":"2024-01-01T00:00:00Z","tracker":"ga4","action":"strip"}'), ("h", "{broken"), ("h", None)], "feed_hash string, line string")
    rows = io.parse_json_list(lines, "line", schemas.FEED_EVENT).collect()
    assert [(r.feed_hash, r.tracker) for r in rows] == [("h", "ga4")]


def test_day_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "daily")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    for rows in ([("2024-01-01", 1), ("2024-01-02", 2)], [("2024-01-02", 5)]):
        io.write_by_day(spark.createDataFrame(rows, "day string, n int"), path)
    assert {(str(r.day), r.n) for r in spark.read.parquet(path).collect()} == {("2024-01-01", 1), ("2024-01-02", 5)}


def test_usage_and_feed(spark):
    log = spark.createDataFrame(
        [("c1", "2024-01-05", a) for a in ("blocked", "strip", "allow", "block")] + [("c1", "2024-02-01", "allow")], "customer_id string, ts string, action string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    monthly = usage.monthly_usage(log)
    january = monthly.where("month = '2024-01'").first()
    assert (january.requests, january.blocked, january.stripped, january.allowed) == (4, 1, 1, 2)
    assert usage.merge_usage(monthly, monthly).where("month = '2024-01'").first().requests == 8
    projects = spark.createDataFrame([("c1", "0123456789abcdef"), ("c2", "0123456789abcde0"), ("c3", "BAD")], "customer_id_ref string, feed_hash string")
    totals = {r.feed_hash: r for r in usage.feed_totals(projects, monthly, "2024-01").collect()}
    assert set(totals) == {"0123456789abcdef", "0123456789abcde0"}
    assert (totals["0123456789abcdef"].pct_allowed, totals["0123456789abcde0"].pct_allowed) == (50, 0)


def test_feed_windows(spark):
    rows = [("f", i, f"2024-01-01 10:{i // 60:02d}:{i % 60:02d}") for i in range(200)]
    feed = spark.createDataFrame(rows, "feed_hash string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.event_id for r in usage.cap_feed(feed, "2024-01-01 10:12:00").collect()) == list(range(121, 200))
    assert sorted(r.event_id for r in usage.cap_feed(feed, "2024-01-01 10:05:00").collect()) == list(range(100, 200))
    assert sorted(r.event_id for r in usage.recent_events(feed).collect()) == list(range(80, 100))


def test_verdicts(spark):
    urls = {
        "ok.nl": ["https://relay.example/c", "https://eu.relay.example/c", "https://ok.nl/a"],
        "mixed.nl": ["https://relay.example/c", "https://www.google-analytics.com/g/collect"],
        "bad.nl": ["https://bat.bing.com/x", "https://relay.example.evil/bat.bing.com"],
        "clean.nl": ["https://clean.nl/"],
    }
    requests = spark.createDataFrame([(h, u) for h, us in urls.items() for u in us], "page_host string, url string")
    attest = spark.createDataFrame([("ok.nl", True, None), ("mixed.nl", True, True), ("bad.nl", True, False)], "domain string, enrolled boolean, signature_valid boolean")
    rows = {r.page_host: r for r in audit.leakage_verdict(audit.page_leakage(requests, ["relay.example"]), attest).collect()}
    assert {h: r.verdict for h, r in rows.items()} == {"ok.nl": "protected", "mixed.nl": "partial", "bad.nl": "unprotected", "clean.nl": "clean"}
    assert rows["ok.nl"].relayed == ["eu.relay.example", "relay.example"] and rows["mixed.nl"].direct == ["google-analytics.com"]


def test_fresh_attestations(spark):
    rows = [
        ("a.nl", "2024-01-01 11:58:00", "n1", "k"), ("a.nl", "2024-01-01 11:59:00", "n1", "k"), ("a.nl", "2024-01-01 11:50:00", "n2", "k"),
        ("b.nl", "2024-01-01 11:59:00", "n3", "k"), ("a.nl", "2024-01-01 11:59:00", "n4", "other"),
    ]
    df = spark.createDataFrame([(*r, 300_000, "A.nl") for r in rows], "domain string, ts string, nonce string, public_key string, ttl_ms long, asked string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.nonce for r in audit.fresh_attestations(df, "2024-01-01 12:00:00", "asked", "k").collect()] == ["n1"]


def test_enrolment(spark):
    projects = spark.createDataFrame([(1, ["a.nl", "www.c.nl"]), (2, ["off.nl"]), (3, [])], "customer_id_ref long, allowed_domains array<string>")
    customers = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, enabled boolean")
    asked = spark.createDataFrame([("https://www.a.nl/x",), ("c.nl",), ("off.nl",), (".nl",), ("nl",)], "domain string")
    assert sorted(r.domain for r in audit.enrolled_domains(asked, projects, customers).collect()) == ["c.nl", "https://www.a.nl/x"]
    assert sorted(r.domain for r in audit.enrolled_domains(asked, projects, customers, "contains").collect()) == ["c.nl", "https://www.a.nl/x", "nl"]


def test_vendor_flow_and_feed(spark):
    salts = SaltBook().cover([19723])
    requests = spark.createDataFrame(
        [
            (1, "wk_" + "a" * 48, "https://www.facebook.com/tr?id=1&fbp=2", "GET"), (2, "wk_" + "a" * 48, "https://x.piwik.pro/p?idsite=1&uid=u", "GET"),
            (3, "wk_" + "a" * 48, "", "GET"), (4, "wk_" + "b" * 48, "https://none.example/", "GET"),
        ],
        "request_id long, api_key string, url string, method string",
    ).selectExpr(
        "*", "timestamp'2024-01-01 10:00:00' AS ts", "'zz' AS customer_id", "cast(null as map<string,string>) AS headers", "cast(null as string) AS body",
        "'10.0.0.1' AS ip", "'Firefox' AS ua", "'https://shop.nl' AS origin", "cast(null as string) AS referer", "'NL' AS country",
    )
    customers = spark.createDataFrame([(7, "wk_" + "a" * 48, "pro", True)], "id long, api_key string, plan string, enabled boolean")
    projects = spark.createDataFrame([(1, 7, "f" * 16, ["shop.nl"]), (2, 7, "e" * 16, ["other.nl"])], "id long, customer_id_ref long, feed_hash string, allowed_domains array<string>")
    revoked = spark.createDataFrame([], "key_hash string, revoked_at timestamp")
    clean, first_party = reports.vendor_flow(requests, customers, projects, revoked, salts)
    rows = {r.request_id: r for r in clean.collect()}
    assert {i: (r.lane, r.disposition, r.counted_as) for i, r in rows.items()} == {
        1: ("meta", "blocked", "blocked"), 2: ("piwik", "forwarded", "stripped"), 3: ("generic", "dropped", None),
    }
    assert rows[1].clean_url is None and "uid=u&" not in rows[2].clean_url and rows[2].clean_headers["x-forwarded-for"] == "0.0.0.0"
    assert [r.request_id for r in first_party.collect()] == [2]
    known = reports.admitted(requests, customers, projects, revoked)
    totals = {r.feed_hash: r for r in reports.feed(known, projects, "2024-01")[0].collect()}
    assert (totals["f" * 16].requests, totals["f" * 16].blocked, totals["f" * 16].stripped, totals["f" * 16].allowed) == (2, 1, 1, 0)
