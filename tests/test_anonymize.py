import hashlib
import hmac

import pytest

from pyspark.sql import functions as F

from kveil.functions import anonymize as an

SALT = bytes(range(32))
SALTS = an.SaltBook.fixed(SALT)


def test_coarse_addresses(values):
    ips = ["81.83.12.44", "", "not-an-ip", "::ffff:81.83.12.5", " 81.83.12.9 ", "2001:db8:1:2:3:4:5:6", None, "::FFFF:2001:db8::1"]
    assert values(an.coarsen_ip, ips) == [
        "81.83.12.0/24", "0", "0", "81.83.12.0/24", "81.83.12.0/24", "2001:db8:1::/48", "0", "2001:db8:0::/48",
    ]
    short = ["fe80::1", "::1", "a:b::c", "a:b:c:d::e"]
    assert values(an.coarsen_ip, short) == ["fe80:0:0::/48", "0:0:0::/48", "a:b:0::/48", "a:b:c::/48"]
    assert values(lambda x: an.coarsen_ip(x, expand_v6=False), ["fe80::1", "::1"]) == ["fe80::1::/48", "::1::/48"]


def test_user_agent_families(values):
    rows = {
        "Mozilla/5.0 (Windows NT 10.0) Firefox/120": "ff/win",
        "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120": "edge/win",
        "Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile Safari/537": "chrome/android",
        "Mozilla/5.0 (iPad; CPU OS 17 like Mac OS X) Safari/604": "safari/ios",
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 14) Safari/605": "safari/mac",
        "curl (Linux)": "other/linux", "": "other/other",
    }
    assert values(an.coarsen_ua, list(rows)) == list(rows.values())


def test_token_is_a_keyed_hash_of_coarse_values(values):
    rows = [
        ("81.83.12.44", "Mozilla/5.0 Firefox/120", "shop.nl"),
        ("81.83.12.1", "Mozilla/5.0 Firefox/119", "shop.nl"),
        ("::ffff:81.83.12.5", "Mozilla/5.0 Firefox/120", "shop.nl"),
        ("81.83.13.44", "Mozilla/5.0 Firefox/120", "shop.nl"),
        ("81.83.12.44", "Mozilla/5.0 Firefox/120", ""),
    ]
    schema = "ip string, ua string, origin string"
    out = values(lambda i, u, o: an.visitor_token(i, u, o, SALTS), rows, schema)
    assert out[0] == out[1] == out[2]
    assert len({out[0], out[3], out[4]}) == 3
    want = hmac.new(SALT, b"81.83.12.0/24|ff/other|shop.nl", hashlib.sha256).hexdigest()[:16]
    assert out[0] == want
    other = values(lambda i, u, o: an.visitor_token(i, u, o, an.SaltBook.fixed(b"\1" * 32)), rows[:1], schema)
    assert other[0] != out[0]


def test_salts_change_every_day_and_can_be_forgotten(spark):
    book = an.SaltBook().cover([19723, 19724])
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 23:59:59' AS a, TIMESTAMP '2024-01-02 00:00:00' AS b, TIMESTAMP '2024-01-01 00:00:00' AS c")
    row = df.select(*[an.keyed_token(F.lit("m"), book, F.col(c)).alias(c) for c in "abc"]).first()
    assert row.a == row.c != row.b
    book.forget_before(19724)
    row = df.select(*[an.keyed_token(F.lit("m"), book, F.col(c)).alias(c) for c in "abc"]).first()
    assert row.a is None and row.b is not None
    a, b = an.SaltBook().cover([1]), an.SaltBook().cover([1])
    assert a._salts != b._salts


def test_client_ids_stay_distinct(values):
    out = values(lambda x: an.client_pseudonym(x, SALTS), ["123.456", "123.457"])
    assert out[0] != out[1]
    assert values(lambda x: an.anonymize_ip(x, SALTS), ["", None]) == ["unknown", "unknown"]


def test_salts_stay_out_of_plans(spark, capsys):
    import secrets

    salt = secrets.token_bytes(32)
    spark.range(1).select(an.keyed_token(F.lit("m"), an.SaltBook.fixed(salt)).alias("t"), F.rand().alias("r")).explain("extended")
    spark.range(1).select(an.keyed_token(F.col("id").cast("string"), an.SaltBook.fixed(salt)).alias("t")).explain("extended")
    shown = capsys.readouterr().out.lower()
    pads = [an._pad(salt, b).hex() for b in (0x36, 0x5C)]
    assert "sha2" in shown and not any(p[:40] in shown for p in pads)
    assert len(an.SaltBook.fixed(salt).fingerprint(1)) == 8


def test_a_day_without_salt_is_not_silent(spark):
    rows = spark.createDataFrame([(1, 19723), (2, 19725)], "i int, d int").select("i", F.timestamp_seconds(F.col("d") * 86400).alias("ts"))
    token = an.visitor_token(F.lit("1.2.3.4"), F.lit("x"), F.lit("a.nl"), an.SaltBook(strict=True).cover([19723]), F.col("ts"))
    assert [tuple(r) for r in an.SaltBook().cover([19723]).uncovered(rows).collect()] == [(19725, 1)]
    assert rows.where("i = 1").select(token.alias("t")).first().t is not None
    with pytest.raises(Exception, match="no salt is held for epoch 19725"):
        rows.select(token.alias("t")).collect()
    untimed = rows.select(F.lit(None).cast("timestamp").alias("ts")).select(token.alias("t"))
    assert {r.t for r in untimed.collect()} == {None}
