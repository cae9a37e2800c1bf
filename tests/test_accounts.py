from pyspark.sql import functions as F

from kveil.functions import fields
from kveil.operators import accounts, limits, retention

KEY = "wk_" + "0" * 47


def stamp(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def test_normalisers(values):
    assert values(fields.clean_email, ["  Jan@Example.NL ", "no", None, "a@b.c"]) == ["jan@example.nl", None, None, None]
    domains = ["https://www.A.nl/x, b.nl,-bad,,a b", None, ",".join(f"d{i}.nl" for i in range(200))]
    out = values(fields.clean_domains, domains)
    assert out[:2] == [["a.nl", "b.nl"], []] and len(out[2]) == 150
    assert values(fields.clean_plan, ["pro", "gold", None]) == ["pro", "starter", "starter"]
    assert values(fields.clean_template, ["custom", "x"]) == ["custom", "ultra-streng"]
    assert values(fields.clean_text, [" <b>x</b> ", None]) == ["x", ""]
    assert values(fields.is_api_key, [KEY + "a", KEY, None]) == [True, False, False]


def test_rejects(values):
    rows = [("/a", '{"__proto__":1}'), ("/a/../b", "{}"), ("/a%2e%2e", None), ("/a\0", None), ("/a", "{}")]
    assert values(fields.reject_reason, rows, "u string, b string") == ["invalid_input", "invalid_path", "invalid_path", "invalid_path", None]


def test_domain_lock(values):
    rows = [
        ("https://a.nl", None, ["a.nl"]), ("https://x.a.nl/p", None, ["a.nl"]), ("https://ba.nl", None, ["a.nl"]), (None, "https://www.a.nl/q", ["A.nl "]),
        (None, None, ["a.nl"]), (None, None, []), ("https://z.nl", None, [""]),
    ]
    out = values(accounts.domain_allowed, rows, "o string, r string, d array<string>")
    assert out == [True, True, False, True, False, True, True]


def test_key_lookup_and_revocation(spark):
    customers = spark.createDataFrame([(1, 1, KEY + "a", "pro", True), (2, 1, KEY + "b", "pro", False), (3, 1, "short", "pro", True)], "id long, user_id long, api_key string, plan string, enabled boolean")
    projects = spark.createDataFrame([(1, "f", ["a.nl"]), (2, "g", []), (3, "h", [])], "customer_id_ref long, feed_hash string, allowed_domains array<string>")
    requests = stamp(spark.createDataFrame([(KEY + k, t) for k in "ab" for t in ("2024-01-02 11:00:00", "2024-01-02 13:00:00")] + [("short", "2024-01-01")], "api_key string, ts string"), "ts")
    known = accounts.authenticate(requests, customers, projects)
    assert known.count() == 2
    revoked = spark.createDataFrame([(KEY + "a", "2024-01-01 12:00:00")], "api_key string, revoked_at string")
    revoked = stamp(revoked.select(accounts.short_hash(F.col("api_key")).alias("key_hash"), "revoked_at"), "revoked_at")
    assert [str(r.ts) for r in accounts.drop_revoked(known, revoked).collect()] == ["2024-01-02 13:00:00"]


def test_activation_and_closing(spark):
    users = stamp(spark.createDataFrame([(1, "on@x.nl", "2020-01-01", None), (2, "off@x.nl", "2020-01-01", None)], "id long, email string, created_at string, deleted_at string"), "created_at", "deleted_at")
    customers = spark.createDataFrame([(10, 1, True), (11, 2, False)], "id long, user_id long, enabled boolean")
    pending = spark.createDataFrame([("paid@x.nl", True), ("new@x.nl", None)], "email string, payment_processed boolean")
    acts = stamp(spark.createDataFrame([(1, "2024-01-02", "new@x.nl"), (2, "2024-01-01", "new@x.nl"), (3, "2024-01-01", "on@x.nl"), (4, "2024-01-01", "paid@x.nl"), (5, "2024-01-01", "off@x.nl")], "event_id long, ts string, email string"), "ts")
    won = accounts.activate(acts, users, customers, pending)
    assert sorted(r.event_id for r in won.collect()) == [2, 5]
    new_users, new_customers = accounts.close_old_accounts(won, users, customers.withColumn("enabled", F.lit(True)), "2024-02-01 00:00:00")
    assert [r.deleted_at is not None for r in new_users.orderBy("id").collect()] == [False, True]
    assert [r.enabled for r in new_customers.orderBy("id").collect()] == [True, False]


def test_erasure(spark):
    users = stamp(spark.createDataFrame([(1, "a@x.nl", "2020-01-01", None), (2, "b@x.nl", "2020-01-01", None), (3, "c@x.nl", "2020-01-01", "2021-01-01")], "id long, email string, created_at string, deleted_at string"), "created_at", "deleted_at")
    customers = stamp(spark.createDataFrame([(10, 1, "k1", True, "2020-01-01"), (11, 2, "k2", True, "2020-01-01")], "id long, user_id long, api_key string, enabled boolean, created_at string"), "created_at")
    asks = spark.createDataFrame([("b@x.nl", "k1"), ("c@x.nl", None), (None, "zz")], "email string, api_key string")
    subjects = accounts.find_subjects(asks, users, customers)
    assert sorted((r.user_id or 0) for r in subjects.collect()) == [0, 0, 1]
    new_users, new_customers, audit = retention.erase_subjects(subjects, users, customers, "2024-01-01 00:00:00")
    rows = {r.id: r for r in new_users.collect()}
    assert rows[1].email.startswith("deleted_") and rows[1].email.endswith("@deleted") and rows[2].email == "b@x.nl"
    assert {r.id: r.enabled for r in new_customers.collect()} == {10: False, 11: True}
    assert [(len(r.user_hash), r.reason) for r in audit.collect()] == [(16, "user_confirmed")]


def test_retention_edges(spark):
    now = "2024-01-01 12:00:00"
    pending = stamp(spark.createDataFrame([("a", "2024-01-01 10:00:00", None), ("b", "2024-01-01 09:59:59", None), ("c", "2023-01-01 00:00:00", True)], "email string, created_at string, payment_processed boolean"), "created_at")
    assert sorted(r.email for r in retention.purge(pending, "pending_accounts", now).collect()) == ["a", "c"]
    links = stamp(spark.createDataFrame([("a", True, "2024-01-01 12:10:00"), ("b", False, "2024-01-01 11:00:00"), ("c", None, "2024-01-01 10:59:59")], "token_hash string, used boolean, expires_at string"), "expires_at")
    assert [r.token_hash for r in retention.purge(links, "magic_links", now).collect()] == ["b"]
    trials = stamp(spark.createDataFrame([(1, "test", True, "2024-01-01 11:49:59"), (2, "test", True, "2024-01-01 11:50:00"), (3, "pro", True, "2023-01-01 00:00:00")], "id long, plan string, enabled boolean, created_at string"), "created_at")
    assert [r.enabled for r in retention.expire_trials(trials, now).orderBy("id").collect()] == [False, True, True]
    audit = stamp(spark.createDataFrame([("h", "2018-12-31 00:00:00", "x"), ("i", "2019-01-02 00:00:00", "x")], "user_hash string, deleted_at string, reason string"), "deleted_at")
    assert [r.user_hash for r in retention.purge(audit, "deletions", now).collect()] == ["i"]


def hits(spark, seconds, key="k"):
    return spark.createDataFrame([(i, key, s) for i, s in enumerate(seconds)], "hit_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))


def allowed(df):
    return [r.allowed for r in df.orderBy("hit_id").collect()]


def test_fixed_window(spark):
    out = limits.fixed_window_limit(hits(spark, [0, 1, 2, 3, 4, 5, 899, 900]), 5, 900)
    assert allowed(out) == [True] * 5 + [False] * 2 + [True]


def test_large_limits_are_cut_in_shares(spark):
    rows = hits(spark, [i % 700 for i in range(2000)])
    want = allowed(limits.fixed_window_limit(rows, 40, 100))
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        assert allowed(limits.fixed_window_limit(rows, 40, 100)) == want and sum(want) == 7 * 40
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)


def test_renewing_window(spark):
    out = limits.renewing_limit(hits(spark, [0, 3000, 6000, 9000, 9599, 9601]), 3, 3600)
    assert allowed(out) == [True, True, True, False, False, True]
    assert allowed(limits.renewing_limit(hits(spark, [5] * 6), 4, 60)) == [True] * 4 + [False] * 2


def test_suspicious_sources(spark):
    rows = hits(spark, [0, 3599, 7198, 7199, 7200, 20_000], "ip").withColumnRenamed("key", "source")
    out = limits.suspicious_sources(rows).orderBy("first_failure").collect()
    assert [(r.failures, r.flagged, r.suspicious) for r in out] == [(5, 1, True), (1, 0, False)]


def test_named_policies(spark):
    assert allowed(limits.apply_policy(hits(spark, range(7)), "login")) == [True] * 5 + [False] * 2
    assert allowed(limits.apply_policy(hits(spark, range(5)), "erase")) == [True] * 3 + [False] * 2
