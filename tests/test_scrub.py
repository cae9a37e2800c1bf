import json

from pyspark.sql import functions as F

from kveil.functions import scrub as sc

TEXTS = {
    "write to k.vos@post.example or call +44 20 55501234": "write to [email] or call [phone]",
    "host 203.0.113.77": "host [phone]",
    "ip 1.2.3.4": "ip [ip]",
    "id 123456789": "id [phone]",
    "card 4111111111111111": "card [phone]",
    "on 2024-01-15": "on [phone]",
    "at 12:34:56": "at [ip6]",
    "fe80::1": "fe80::1",
    "2001:db8:1::5": "[ip6]::5",
    "order 12345678": "order 12345678",
    "06 12345678": "[phone]",
    "plain text": "plain text",
    "06\u00a012345678": "[phone]",
}


def test_text(values):
    assert values(sc.scrub_text, list(TEXTS)) == list(TEXTS.values())


def test_specific_rules_first(values):
    got = values(lambda x: sc.scrub_text(x, "specific_first"), ["host 203.0.113.77", "card 5500005555555559", "ref 987654321"])
    assert got == ["host [ip]", "card [num]", "ref [id]"]


def test_ascii_word_boundaries(values):
    assert values(lambda x: sc.scrub_text(x, "specific_first"), ["é1.2.3.4", "a1.2.3.4"]) == ["é[ip]", "a1.2.3.4"]


def test_scrubbing_twice_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(sc.scrub_text(F.col("text")).alias("a"))
    assert docs.where(sc.scrub_text(F.col("a")) != F.col("a")).count() == 0


def test_urls(values):
    urls = {
        "https://books.example/list?fbp=7&page=2&gclid=q1&fbclid=q2": "https://books.example/list?page=2",
        "https://root:pw@files.example:9000/dir?GCLID=z#top": "https://files.example:9000/dir",
        "/list?sort=up&utm_source=mail": "/list?sort=up&utm_source=mail",
        "/list?%67clid=5&sort=up": "/list?sort=up",
        "/list?to=k.vos@post.example": "/list?to=[email]",
        "https://": "https://",
        "": "",
    }
    assert values(sc.scrub_url, list(urls)) == list(urls.values())


def test_strip_urls(values):
    token = "a123456789012345"  # looks like a phone number, and must survive
    def strip(fields):
        if len(fields) == 6:
            return lambda u: sc.strip_tracker_url(u, fields, F.lit(token))
        return lambda u: sc.strip_tracker_url(u, F.array(*[F.lit(f) for f in fields]), F.lit(token))

    visit = "https://stats.tenant.example/matomo.php?rec=1&_id=77f0&idsite=12&cip=198.51.100.9&uid=k.vos&uid=again&token_auth=T0&e_c=menu&url=https://tenant.example/home"
    out = values(strip("_id uid cid cip token_auth e_c".split()), [visit, "no address?uid=1"])
    assert out == [f"https://stats.tenant.example/matomo.php?rec=1&_id={token}&idsite=12&uid={token}&url=https://tenant.example/home", "no address?uid=1"]
    hit = "https://m.tenant.example/b/ss/suite/2?pe=lnk_d&mid=31&vid=Q9Q9&aid=44&email=k.vos@post.example&c_ip=198.51.100.9&eVar12=v"
    assert values(strip("vid aid mid c_ip email eVar pe".split()), [hit]) == [
        f"https://m.tenant.example/b/ss/suite/2?mid={token}&vid={token}&aid={token}"
    ]


def test_payloads(values):
    flat = '{"em":"9f","tier":"gold","email":"k.vos@post.example","visits":12,"memo":"ask k.vos@post.example"}'
    want = {"em": "[redacted]", "tier": "gold", "email": "[redacted]", "visits": 12, "memo": "ask [email]"}
    assert [json.loads(v) for v in values(sc.scrub_flat_json, [flat])] == [want]
    nested = '{"batch":[{"row":{"email":"k.vos@post.example","screen":"/cart","user_id":31}}]}'
    out = values(sc.scrub_payload, [flat, nested, "q=1&to=k.vos@post.example", "", "[1.0, 1.5, true, null]", None])
    assert json.loads(out[0]) == want
    assert json.loads(out[1]) == {"batch": [{"row": {"email": "[redacted]", "screen": "/cart", "user_id": "[redacted]"}}]}
    assert out[2:] == ["q=1&to=[email]", "", "[1,1.5,true,null]", None]
    # The flat form can not look inside a nested value, so it lets nothing of it through.
    assert "post.example" not in values(sc.scrub_flat_json, [nested])[0]


def test_one_result_for_flat_and_nested(values):
    """What the JVM form takes on, the recursive form scrubs to the same text."""
    payloads = [
        '{"k": 7}', "{}", '{"a":{"b":"x"},"c":[1,2]}', '{"a":"x","a":"y"}', '{"n":1.0}', '{"n":-0}', '{"n":1e3}', '{"a":"q\\"z"}',
        '{"a":true,"b":null,"Email":"u"}', ' {"a":1}', '{"a":1,}', '{"a" : "to k.vos@post.example" , "b":-15}', '{"n":12345678901234567890}', "7", '"x"', '{"é":"ü"}',
    ]
    assert values(sc.scrub_payload, payloads) == values(sc.scrub_json, payloads)


def test_payload_depth_limit(values):
    deep = '{"a":' * 9 + '"x@y.nl"' + "}" * 9
    assert "x@y.nl" not in values(sc.scrub_json, [deep])[0]
