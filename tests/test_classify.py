from pyspark.sql import functions as F

from kveil.functions import web
from kveil.operators import classify, events
from kveil.sources import rulebase as rb

URLS = {
    "https://www.google-analytics.com/g/collect?cid=1.2": ("ga4", "strip"),
    "https://stad.piwik.pro/t/web": ("piwik_pro", "strip"),
    "https://t.sc.omtrdc.net/b/ss/r/1": ("adobe_analytics", "strip"),
    "https://dpm.demdex.net/id": ("adobe_analytics", "strip"),
    "https://www.facebook.com/tr?id=1": ("meta_pixel", "block"),
    "https://static.hotjar.com/c/hotjar-1.js": ("hotjar", "block"),
    "https://cdn.cookielaw.org/x": ("onetrust", "allow"),
    "https://consent.cookiebot.com/uc.js": ("twitter_x", "block"),
    "https://target.com/x": ("twitter_x", "block"),
    "https://js.intercomcdn.com/a": ("intercom", "strip"),
    "https://example.org/": (None, None),
}


def resolve(spark, urls, **options):
    df = spark.createDataFrame([("c1", u) for u in urls], "customer_id string, url string")
    return {r.url: (r.tracker, r.action, r.custom) for r in classify.resolve_trackers(df, **options).collect()}


def test_rule_base_is_complete():
    rules = rb.load_rules()
    assert (len(rules), sum(len(r.patterns) for r in rules), sum(len(r.cookies) for r in rules), sum(len(r.strip_fields) for r in rules)) == (56, 172, 180, 77)
    assert (len(rb.INTERCEPT_PATTERNS), len(rb.SCRIPT_PATTERNS), len(rb.COOKIE_PREFIXES), len(rb.AUDIT_HOSTS)) == (77, 8, 37, 49)
    action = {r.key: r.default_action for r in rules}
    assert {action[k] for k in ("piwik_pro", "matomo", "adobe_analytics", "adobe_target", "snowplow", "tealium")} == {"strip"}


def test_first_rule_wins(spark):
    assert resolve(spark, URLS) == {u: (*v, False) for u, v in URLS.items()}
    unknown = resolve(spark, URLS, template="no such template")
    assert unknown == {u: (*v, False) for u, v in URLS.items()}


def test_templates_and_host_matching(spark):
    light = resolve(spark, URLS, template="marketing-light", match="host_suffix")
    assert light["https://www.facebook.com/tr?id=1"][1] == "strip"
    assert light["https://consent.cookiebot.com/uc.js"] == ("cookiebot", "allow", False)
    assert light["https://target.com/x"] == (None, None, False)
    assert resolve(spark, ["https://static.hotjar.com/x"], template="basis-analytics")["https://static.hotjar.com/x"][1] == "strip"


def test_custom_rules_come_first(spark):
    own = spark.createDataFrame(
        [("c1", 2, "example.org", "block"), ("c1", 1, "Example.ORG", "strip"), ("c1", 0, "", "allow"), ("c2", 0, "hotjar", "allow")],
        "customer_id string, ord int, domain string, action string",
    )
    out = resolve(spark, ["https://example.org/", "https://static.hotjar.com/c"], custom_rules=own)
    assert out["https://example.org/"] == ("Example.ORG", "strip", True)
    assert out["https://static.hotjar.com/c"] == ("hotjar", "block", False)


def test_catalogue_search(spark):
    rules = rb.rules_df(spark)
    assert {r.tracker for r in classify.search_catalogue(rules, "analytics", "GOOGLE").collect()} == {"ga4", "ga_signals"}
    assert classify.search_catalogue(rules).count() == 56
    empty = rb.categories_df(spark).join(rules, "category", "left_anti").collect()
    assert [r.category for r in empty] == ["hosting"]


def test_all_allow_template(spark):
    choices = spark.createDataFrame([("c1", "alles-allow")], "customer_id string, template string")
    manual = spark.createDataFrame([("c1", "ga4", "block")], "customer_id string, tracker string, action string")
    config = classify.effective_config(choices, rb.rules_df(spark), rb.templates_df(spark), manual)
    assert classify.action_counts(config).first().asDict() == {"customer_id": "c1", "total": 56, "blocked": 1, "stripped": 0, "allowed": 55}


def test_intercept_route_and_cookies(values):
    assert values(web.is_intercepted, ["https://bat.bing.com/x", "https://relay.example/proxy?u=bat.bing.com", "/local", None]) == [True, False, False, False]
    assert values(web.vendor_route, ["https://a.PIWIK.pro/x", "https://x/b/ss/1", "https://y"]) == ["piwik", "adobe", "generic"]
    assert values(web.is_blocked_cookie, [" _ga_X=1; path=/", "fresh=1", "cart=_ga", "IDE"]) == [True, True, False, True]


def test_page_resources(spark):
    html = (
        '<script src="https://connect.facebook.net/en_US/fbevents.js"></script><img src="https://www.facebook.com/tr?id=1">'
        '<link href="https://mc.yandex.ru/x"><script src="/app.js"></script><IMG alt="a" SRC=\'/logo.png\'>'
    )
    rows = classify.page_resources(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert sorted((r.kind, r.blocked) for r in rows) == [("link", True), ("pixel", False), ("pixel", True), ("script", False), ("script", True)]


def test_page_resources_without_quotes(spark):
    html = (
        "<script src=https://bat.bing.com/bat.js></script><!-- <img src='https://www.facebook.com/tr'> -->"
        '<script>document.write("<img src=https://www.facebook.com/tr?x=1>")</script><img src="https://www.facebook.com/tr?a=1&amp;b=2">'
    )
    rows = classify.page_resources(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert sorted((r.kind, r.resource_url) for r in rows) == [
        ("pixel", "https://www.facebook.com/tr?a=1&b=2"), ("script", "https://bat.bing.com/bat.js"),
    ]


def test_resolver_lists(spark):
    rows = spark.createDataFrame([(1, "https://stad.piwik.pro/x"), (2, "https://static.hotjar.com/a"), (3, "https://none.example")], "i int, url string")
    got = {r.i: r for r in classify.resolve_trackers(rows).collect()}
    rules = {r.key: r for r in classify.load_rules()}
    assert got[1].strip_fields == list(rules["piwik_pro"].strip_fields) and got[1].cookies == list(rules["piwik_pro"].cookies)
    assert got[2].strip_fields == [] and got[3].strip_fields is None


def test_referrer_and_origin_keys(values):
    refs = ["", None, "https://google.com/x", "https://a.nl:8443/", "https://a.nl:443/", "http://u:p@B.nl:80?x", "no url", "mailto:a@b.nl"]
    assert values(web.referrer_key, refs) == ["(direct)", "(direct)", "google.com", "a.nl:8443", "a.nl", "b.nl", "(other)", None]
    assert values(lambda o, d: web.origin_host(o, d), [("https://X.nl", "d"), ("null", "d"), (None, None)], "o string, d string") == ["x.nl", "d", ""]


def test_event_fields(values):
    assert values(web.event_path, ["", None, "https://a.nl?x=1", "https://a.nl/b#c", "p", "/a?gclid=1"]) == ["/", "/", "/?x=1", "/b", "/p", "/a"]
    assert values(web.country_code, ["nl", "T1", None, "NLD"]) == ["NL", "??", "??", "??"]
    assert values(web.event_name, ["x" * 50, None, "click"]) == ["x" * 40, "pageview", "click"]
    agents = ["iPad Mobile", "Android Mobile", "Android", "ExampleBot", "X11", None]
    assert values(web.beacon_device, agents) == ["tablet", "mobile", "desktop", "bot", "desktop", "desktop"]
    assert values(web.vendor_device, agents) == ["mobile", "mobile", "mobile", "desktop", "desktop", "desktop"]


def test_vendor_parameters(values):
    url = "https://x/collect?v=2&dl=https%3A%2F%2Fa.nl&en=&em=hash&id=5&dt=" + "t" * 300
    assert values(lambda u: events.allowed_params(u, events.GA4_PARAMS), [url]) == [{"v": "2", "dl": "https://a.nl", "dt": "t" * 200}]
    assert values(events.generic_url, ["https://x/a?uid=1&UID=2&q=3#f", "https://x/a?uid=1", "no url?uid=1"]) == ["https://x/a?UID=2&q=3#f", "https://x/a", "no url?uid=1"]
    body = '{"client_id":"1","events":[{"name":"a","params":{"email":"x","v":1}},{"name":"b"}]}'
    assert values(events.drop_event_params, [body, "no json", '{"a":1}']) == [
        '{"client_id":"1","events":[{"name":"a","params":{"v":1}},{"name":"b","params":{}}]}', "no json", '{"a":1}',
    ]


def test_dispositions(spark):
    rows = [("piwik", "", "x"), ("generic", "", "x"), ("adobe", "u", "block"), ("generic", "u", "block"), ("generic", "u", "strip"), ("generic", "u", "allow"), ("generic", "u", "?")]
    df = spark.createDataFrame(rows, "route string, url string, action string")
    out = df.select(*events.request_disposition(F.col("route"), F.col("url"), F.col("action"))).collect()
    assert [tuple(r) for r in out] == [
        ("dropped", "blocked"), ("dropped", None), ("forwarded", "stripped"), ("blocked", "blocked"), ("forwarded", "stripped"),
        ("forwarded", "allowed"), ("processed", "allowed"),
    ]


def test_original_url(spark):
    rows = [("https://r/p?_orig=https%3A%2F%2Fx.nl%2Fa%3Fb%3D1&k=2", {}), ("https://r/p", {"X-Original-Url": "https://y.nl"}), ("https://r/p", {})]
    df = spark.createDataFrame(rows, "u string, h map<string,string>")
    out = [r[0] for r in df.select(events.original_url(F.col("u"), F.col("h"))).collect()]
    assert out == ["https://x.nl/a?b=1", "https://y.nl", ""]


def test_contained_equals_all_pairs(spark):
    import random

    from kveil.operators.substring import contained

    rnd = random.Random(4)
    word = lambda low, high: "".join(rnd.choice("ab.") for _ in range(rnd.randint(low, high)))
    texts = [(rnd.choice("xy"), word(0, 12)) for _ in range(60)] + [("x", None), (None, "abab")]
    parts = [(rnd.choice("xy"), word(0, 6)) for _ in range(60)] + [("x", None), ("y", "")]
    a, b = spark.createDataFrame(texts, "s string, text string"), spark.createDataFrame(parts, "s string, part string")
    want = {(s, t, p) for s, t in texts for z, p in parts if s == z and t is not None and p and p in t}
    for by_texts in (True, False):
        got = [tuple(r) for r in contained(a, b, scope=("s",), rank_by_texts=by_texts).select("s", "text", "part").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    wide = {(t, p) for _, t in texts for _, p in parts if t is not None and p and p in t}
    assert {tuple(r) for r in contained(a, b).select("text", "part").collect()} == wide


def test_a_part_is_looked_up_by_few_grams(spark, monkeypatch):
    from kveil.operators import substring

    rows = spark.createDataFrame([("rule123.example",), ("abcd",), ("abcde",), ("aaaaaaaa",), ("ab",)], "p string")
    got = [r[0] for r in rows.select(substring.cover(F.col("p"), F.least(F.length("p"), F.lit(4)))).collect()]
    assert got == [["rule", "123.", "exam", "mple"], ["abcd"], ["abcd", "bcde"], ["aaaa"], ["ab"]]
    texts = spark.createDataFrame([("xabcdex",), ("rule123.example/aaaaaaaa",), ("",)], "text string")
    want = {("xabcdex", "abcd"), ("xabcdex", "abcde"), ("xabcdex", "ab"), ("rule123.example/aaaaaaaa", "rule123.example"), ("rule123.example/aaaaaaaa", "aaaaaaaa")}
    for most in (0, 1000):  # counts shuffled, counts sent as a whole
        monkeypatch.setattr(substring, "BROADCAST_GRAMS", most)
        assert {tuple(r) for r in substring.contained(texts, rows, part="p").select("text", "p").collect()} == want


def test_long_rule_lists_match_like_short_ones(spark, monkeypatch):
    rules = spark.createDataFrame([("c", i, f"r{i}.nl" if i != 7 else "SHOP", "block") for i in range(20)] + [("d", 1, "shop", "allow")],
                                  "customer_id string, ord int, domain string, action string")
    asked = spark.createDataFrame([(1, "c", "https://shop.r19.nl/r3.nl"), (2, "c", "https://shop.nl"), (3, "d", "https://shop.nl"), (4, "c", "https://x"), (5, None, "https://shop.nl")],
                                  "request_id int, customer_id string, url string")
    out = {}
    for limit in (5, 256):
        monkeypatch.setattr(classify, "LIST_RULES", limit)
        found = classify.resolve_trackers(asked, custom_rules=rules)
        out[limit] = sorted((r.request_id, r.tracker, r.action, r.custom) for r in found.collect())
        assert found.columns[:3] == asked.columns or limit == 256
    assert out[5] == out[256] and out[5][0][1] == "r3.nl" and out[5][1][1] == "SHOP"
