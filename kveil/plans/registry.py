"""Registered queries and their oracle SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.functions import anonymize as an
from kveil.functions import fields, scrub, web
from kveil.operators import accounts, audit, classify, events, kanon, limits, retention, rollup, usage
from kveil.plans import oracle as sql
from kveil.plans import reports
from kveil.plans.inputs import NOW, Inputs, duckdb_views
from kveil.session import reliable_checkpoint, shared_dir
from kveil.sources import io
from kveil.sources.rulebase import (
    AUDIT_HOSTS, CATEGORIES, COOKIE_PREFIXES, INTERCEPT_PATTERNS, ROUTE_PATTERNS, ROUTE_TRACKER, SCRIPT_PATTERNS, categories_df, load_rules,
    rules_df, template_overrides, templates_df,
)
from kveil.sources.tables import KeyedTable
from kveil.streaming import jobs, keyed
from kveil.streaming.batches import read_part
from kveil.streaming.salts import SaltVault, event_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SALTS = an.SaltBook.fixed(sql.TEST_SALT)
c = F.col


def query(name: str, views: str = "", oracle: str | None = None, ctes: str = "", recursive: bool = False):
    """Register a query over ``Inputs`` with the SQL that must give the same rows."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle:
            parts = [p for p in (duckdb_views(*views.split()), ctes) if p]
            head = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) if parts else ""
            ORACLES[name] = f"{head} {oracle.strip()}".strip()
        return fn

    return register


def text_time(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_time(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def clean_events(t: Inputs) -> DataFrame:
    return kanon.with_quasi_identifiers(events.build_events(t.visits, SALTS)).withColumn(
        "day", F.date_trunc("day", "ts")
    )


# ---------------------------------------------------------------- anonymise and scrub

@query("visitor_tokens", "visits", f"SELECT event_id, {sql.visitor()} AS visitor, {sql.token(sql.ip24('ip'))} AS ip_token FROM visits")
def visitor_tokens(t):
    v = t.visits
    return v.select(
        "event_id", an.visitor_token(c("ip"), c("ua"), web.origin_host(c("origin")), SALTS, c("ts")).alias("visitor"),
        an.anonymize_ip(c("ip"), SALTS, c("ts")).alias("ip_token"),
    )


_DAY_SALTS = {str(19723 + d): hashlib.sha256(f"salt of day {d}".encode()).digest() for d in range(-1, 32)}


@query("daily_tokens", "visits", f"""SELECT event_id, {sql.token(f"{sql.ip24('ip')} || '|' || {sql.ua_class('ua')} || '|' || {sql.host('origin')}",
       _DAY_SALTS, 'epoch_ms(ts) // 86400000')} AS visitor FROM visits""")
def daily_tokens(t):
    """Tokens under a salt of their own for each day."""
    salts = an.SaltBook(lambda epoch: _DAY_SALTS[str(epoch)]).cover(map(int, _DAY_SALTS))
    return t.visits.select("event_id", an.visitor_token(c("ip"), c("ua"), web.origin_host(c("origin")), salts, c("ts")).alias("visitor"))


_V6 = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('2001:db8:', hex(user_id), '::', hex(event_id)) WHEN 1 THEN concat('fe80::', hex(user_id))
  WHEN 2 THEN concat('::ffff:', ip) WHEN 3 THEN concat('2a02:', hex(user_id), ':1:2:3:4:5:', hex(event_id)) ELSE concat(' ', ip, ' ') END AS address FROM {visits}"""


@query("coarse_v6", "visits", f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN array_to_string(string_split(address, ':')[1:3], ':') || '::/48' WHEN 1 THEN 'fe80:0:0::/48'
  WHEN 2 THEN {sql.ip24("replace(address, '::ffff:', '')")} WHEN 3 THEN array_to_string(string_split(address, ':')[1:3], ':') || '::/48'
  ELSE {sql.ip24('trim(address)')} END AS coarse FROM ({_V6.format(visits='visits')})""")
def coarse_v6(t):
    return t.sql(_V6).select("event_id", an.coarsen_ip(c("address")).alias("coarse"))


@query("origin_fallback", "visits", f"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'shop' || user_id || '.example' WHEN event_id % 3 = 1 THEN '' ELSE {sql.host('origin')} END AS domain FROM visits""")
def origin_fallback(t):
    """Beacons without a usable origin name their domain themselves, or have none."""
    site = F.when(c("event_id") % 3 == 0, F.concat(F.lit("shop"), c("user_id"), F.lit(".example")))
    rows = t.visits.withColumns({"origin": F.when(c("event_id") % 3 == 2, c("origin")).otherwise("null"), "d": site})
    return events.build_events(rows, SALTS).select("event_id", "domain")


@query("coarse_population", "visits", f"""
SELECT {sql.ip24('ip')} AS ip24, {sql.ua_class('ua')} AS ua_class, count(*) AS events, count(DISTINCT user_id) AS users
FROM visits GROUP BY 1, 2""")
def coarse_population(t):
    return t.visits.groupBy(an.coarsen_ip(c("ip")).alias("ip24"), an.coarsen_ua(c("ua")).alias("ua_class")).agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users")
    )


@query("salt_epochs", "visits", """
SELECT epoch_ms(ts) // 86400000 AS epoch, count(*) AS events FROM visits GROUP BY 1""")
def salt_epochs(t):
    return t.visits.groupBy(an.salt_epoch(c("ts")).alias("epoch")).agg(F.count("*").alias("events"))


@query("scrub_documents", "", f"SELECT doc_id, {sql.scrub('text')} AS clean_text FROM documents")
def scrub_documents(t):
    return t.documents.select("doc_id", scrub.scrub_text(c("text")).alias("clean_text"))


@query("scrub_pages", "", f"SELECT page_id, {sql.scrub('html')} AS clean_html FROM pages")
def scrub_pages(t):
    return t.pages.select("page_id", scrub.scrub_text(c("html")).alias("clean_html"))


@query("scrub_conversations", "", f"""
SELECT role, count(*) AS turns, sum(CASE WHEN {sql.scrub('text')} <> text THEN 1 ELSE 0 END)::BIGINT AS changed
FROM conversations GROUP BY role""")
def scrub_conversations(t):
    return t.conversations.groupBy("role").agg(
        F.count("*").alias("turns"), F.count_if(scrub.scrub_text(c("text")) != c("text")).alias("changed")
    )


_FULL_URL = "regexp_replace(origin, '://', concat('://u', user_id, ':pw@')) || u"


@query("scrub_urls", "visits", f"SELECT event_id, {sql.scrub_url('full_url')} AS clean_url FROM (SELECT event_id, {_FULL_URL} AS full_url FROM visits)")
def scrub_urls(t):
    full = t.visits.select("event_id", F.expr(_FULL_URL).alias("full_url"))
    return full.select("event_id", scrub.scrub_url(c("full_url")).alias("clean_url"))


_FLAT = """concat('{"k": ', {k}, ', "Email": "u', user_id, '@example.nl", "note": "mail u', user_id, '@example.nl or +31 6 ', 10000000 + event_id, '", "ok": true, "none": null}')"""


@query("scrub_props", "visits", f"""
SELECT event_id, concat('{{"k":', json_extract_string(p, '$.k'), ',"Email":"[redacted]","note":"',
  {sql.scrub("concat('mail u', user_id, '@example.nl or +31 6 ', 10000000 + event_id)")}, '","ok":true,"none":null}}') AS props
FROM visits""")
def scrub_props(t):
    rows = t.visits.select("event_id", F.expr(_FLAT.replace("{k}", "get_json_object(p, '$.k')")).alias("p"))
    return rows.select("event_id", scrub.scrub_payload(c("p")).alias("props"))


_NESTED = """concat('{"events": [{"data": {"user_id": ', user_id, ', "email": "u@x.nl", "page": "/p?', event_id, '", "note": ["u', user_id, '@example.nl", ', user_id, ']}}]}')"""


@query("scrub_nested_props", "visits", """
SELECT event_id, concat('{"events":[{"data":{"user_id":"[redacted]","email":"[redacted]","page":"/p?', event_id,
  '","note":["[email]",', user_id, ']}}]}') AS body FROM visits""")
def scrub_nested_props(t):
    rows = t.visits.select("event_id", F.expr(_NESTED).alias("p"))
    return rows.select("event_id", scrub.scrub_payload(c("p")).alias("body"))


_EVENT_COLUMNS = "event_id, visitor, domain, origin, event, path, referrer, country, device, props"


@query("build_events", "visits", f"SELECT {_EVENT_COLUMNS}, {sql_time('ts')} AS ts FROM clean", ctes=sql.CLEAN_EVENTS)
def build_events(t):
    return clean_events(t).select(*_EVENT_COLUMNS.split(", "), text_time(c("ts")).alias("ts"))


# ---------------------------------------------------------------- k-anonymity

_QI = ["day", "section", "country", "device"]


def _bucket_sql(qi: list[str], k: int) -> str:
    on = " AND ".join(f"c.{q} = b.{q}" for q in qi)
    return f"""SELECT c.event_id, c.visitor FROM clean c JOIN (SELECT {', '.join(qi)} FROM clean GROUP BY {', '.join(qi)}
      HAVING count(DISTINCT visitor) >= {k}) b ON {on}"""


@query("kanon_bucket", "visits", _bucket_sql(_QI, 5), ctes=sql.CLEAN_EVENTS)
def kanon_bucket(t):
    return kanon.release_buckets(clean_events(t), _QI, 5).select("event_id", "visitor")


_QI_FULL = ["hour", "event", "section", "country", "device"]


@query("kanon_bucket_hourly", "visits", _bucket_sql(_QI_FULL, 3), ctes=sql.CLEAN_EVENTS)
def kanon_bucket_hourly(t):
    return kanon.release_buckets(clean_events(t), _QI_FULL, 3).select("event_id", "visitor")


@query("kanon_bucket_sizes", "visits", f"""
SELECT {sql_time('day')} AS day, section, country, device, count(*) AS events, count(DISTINCT visitor) AS visitors
FROM clean GROUP BY clean.day, section, country, device""", ctes=sql.CLEAN_EVENTS)
def kanon_bucket_sizes(t):
    return kanon.bucket_sizes(clean_events(t), _QI).withColumn("day", text_time(c("day")))


_ARRIVAL_QI, _ARRIVAL_KEY = ["event", "hour"], "event || '|' || hour"
_DAY_QI, _DAY_KEY = ["event", "section", "day"], "event || '|' || section || '|' || day"
_NO_TTL = 400 * 86400


@query("kanon_arrival", "visits", "SELECT event_id, status FROM labelled",
       ctes=sql.CLEAN_EVENTS + "," + sql.arrival("clean", _ARRIVAL_KEY, 3), recursive=True)
def kanon_arrival(t):
    return kanon.arrival_status(clean_events(t), _ARRIVAL_QI, 3, ttl_seconds=_NO_TTL)


_TTL_CTES = sql.CLEAN_EVENTS + "," + sql.arrival("clean", _DAY_KEY, 4, 7200, 60, NOW)


def _ttl_labels(t: Inputs, as_of: str = NOW) -> DataFrame:
    return kanon.release_in_order(clean_events(t), _DAY_QI, 4, ttl_seconds=7200, as_of=as_of)


@query("kanon_arrival_ttl", "visits", "SELECT event_id, status FROM labelled", ctes=_TTL_CTES, recursive=True)
def kanon_arrival_ttl(t):
    return kanon.arrival_status(clean_events(t), _DAY_QI, 4, ttl_seconds=7200, as_of=NOW)


@query("kanon_dropped", "visits", """
SELECT c.event, count(*) FILTER (l.status = 'released') AS released, count(*) FILTER (l.status = 'dropped') AS dropped
FROM labelled l JOIN clean c USING (event_id) GROUP BY c.event""", ctes=_TTL_CTES, recursive=True)
def kanon_dropped(t):
    return _ttl_labels(t).groupBy("event").agg(
        *[F.count_if(c("status") == s).alias(s) for s in (kanon.RELEASED, kanon.DROPPED)]
    )


_MID = "2024-01-30 23:00:00"


@query("gate_state", "visits", """
SELECT 4::BIGINT AS k, count(DISTINCT bucket) AS open_buckets, count(*) AS buffered_events FROM labelled WHERE status = 'held'""",
       ctes=sql.CLEAN_EVENTS + "," + sql.arrival("clean", _DAY_KEY, 4, 7200, 60, _MID), recursive=True)
def gate_state(t):
    return kanon.gate_state(_ttl_labels(t, _MID), _DAY_QI, 4)


# ---------------------------------------------------------------- reports

_REFERRER = f"CASE WHEN referrer = '' THEN '(direct)' ELSE {sql.host('referrer')} END"
_DIMENSION_CTE = sql.CLEAN_EVENTS + f""", cells AS (
  SELECT CAST(day AS DATE) AS day, ts, event_id, unnest([
    {{'dimension': 'event', 'key': event}}, {{'dimension': 'page', 'key': path}}, {{'dimension': 'referrer', 'key': {_REFERRER}}},
    {{'dimension': 'country', 'key': country}}, {{'dimension': 'device', 'key': device}}], recursive := true) FROM clean),
counts AS (SELECT day, dimension, "key", count(*) AS cnt, min(ts) AS first_ts FROM cells GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day, dimension ORDER BY cnt DESC, first_ts, "key") AS rank FROM counts)"""


@query("daily_totals", "visits", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (event = 'pageview') AS pageviews, count(DISTINCT visitor) AS uniques
FROM clean GROUP BY 1""", ctes=sql.CLEAN_EVENTS)
def daily_totals(t):
    return rollup.daily_totals(clean_events(t)).withColumn("day", c("day").cast("string"))


@query("daily_dimensions", "visits", """
SELECT strftime(day, '%Y-%m-%d') AS day, dimension, "key", cnt FROM counts""", ctes=_DIMENSION_CTE)
def daily_dimensions(t):
    return rollup.daily_dimensions(clean_events(t)).select(c("day").cast("string").alias("day"), "dimension", "key", "cnt")


@query("daily_top_keys", "visits", """
SELECT strftime(day, '%Y-%m-%d') AS day, dimension, "key", cnt, rank FROM ranked WHERE rank <= 10""", ctes=_DIMENSION_CTE)
def daily_top_keys(t):
    top = rollup.top_keys(rollup.daily_dimensions(clean_events(t)))
    return top.select(c("day").cast("string").alias("day"), "dimension", "key", "cnt", c("rank").cast("bigint").alias("rank"))


@query("daily_floor_referrers", "visits", """
SELECT strftime(c.day, '%Y-%m-%d') AS day, c.dimension, c."key", count(*) AS cnt
FROM cells c JOIN clean e USING (event_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT e.visitor) >= 5""", ctes=_DIMENSION_CTE)
def daily_floor_referrers(t):
    kept = rollup.daily_dimensions(clean_events(t), min_visitors=5)
    return kept.select(c("day").cast("string").alias("day"), "dimension", "key", "cnt")


_LIST = """(SELECT string_agg("key" || '=' || cnt, ';' ORDER BY rank) FROM ranked r WHERE r.day = d.day AND rank <= 10 AND dimension = '{0}') AS top_{0}s"""


@query("daily_report", "visits", f"""
SELECT strftime(d.day, '%Y-%m-%d') AS day, d.pageviews, d.uniques, {', '.join(_LIST.format(d) for d in rollup.DIMENSIONS)}
FROM (SELECT CAST(day AS DATE) AS day, count(*) FILTER (event = 'pageview') AS pageviews, count(DISTINCT visitor) AS uniques
      FROM clean GROUP BY 1) d""", ctes=_DIMENSION_CTE)
def daily_report(t):
    report = rollup.daily_report(clean_events(t))
    flat = [
        F.array_join(F.transform(c(f"top_{d}s"), lambda e: F.concat(e["key"], F.lit("="), e["count"])), ";").alias(f"top_{d}s")
        for d in rollup.DIMENSIONS
    ]
    return report.select(c("day").cast("string").alias("day"), "pageviews", "uniques", *flat)


_RELEASED_CTE = sql.CLEAN_EVENTS + f", out AS ({_bucket_sql(_QI, 5).replace('c.event_id, c.visitor', 'c.*')})"


@query("report_range", "visits", """
SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(pageviews, 0) AS pageviews, coalesce(uniques, 0) AS uniques
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-27', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS day) s
LEFT JOIN (SELECT day, count(*) FILTER (event = 'pageview') AS pageviews, count(DISTINCT visitor) AS uniques
           FROM out GROUP BY day) d ON d.day = s.day""", ctes=_RELEASED_CTE)
def report_range(t):
    totals = rollup.daily_totals(kanon.release_buckets(clean_events(t), _QI, 5))
    return rollup.report_range(totals, "2024-02-02").withColumn("day", c("day").cast("string"))


@query("retain_days", "visits", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (event = 'pageview') AS pageviews, count(DISTINCT visitor) AS uniques
FROM clean WHERE day IN (SELECT DISTINCT day FROM clean ORDER BY day DESC LIMIT 12) GROUP BY 1""", ctes=sql.CLEAN_EVENTS)
def retain_days(t):
    return rollup.retain_days(rollup.daily_totals(clean_events(t)), 12).withColumn("day", c("day").cast("string"))


@query("released_top_pages", "visits", """
SELECT strftime(day, '%Y-%m-%d') AS day, path AS page, cnt, rank FROM (
  SELECT day, path, count(*) AS cnt, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, min(ts), path) AS rank
  FROM out GROUP BY day, path) WHERE rank <= 10""",
       ctes=sql.CLEAN_EVENTS + f", out AS ({_bucket_sql(['day', 'section'], 5).replace('c.event_id, c.visitor', 'c.*')})")
def released_top_pages(t):
    """Flagship: visits to k-anonymous daily top pages."""
    visits = t.visits.withColumn("day", F.date_trunc("day", "ts"))
    top = reports.top_keys_report(visits, SALTS, ["day", "section"])
    return top.where("dimension = 'page'").select(
        c("day").cast("date").cast("string").alias("day"), c("key").alias("page"), "cnt", c("rank").cast("bigint").alias("rank")
    )


# ---------------------------------------------------------------- classification

_RULES = load_rules()
_PATTERN_ROWS = ", ".join(
    f"({i * 100 + j}, '{r.key}', '{r.category}', '{r.default_action}', '{p.lower()}')"
    for i, r in enumerate(_RULES) for j, p in enumerate(r.patterns)
)
_RULE_CTE = f"rules(ord, tracker, category, default_action, pattern) AS (VALUES {_PATTERN_ROWS})"


def _override_cte(*templates: str) -> str:
    rows = ", ".join(f"('{t}', '{k}', '{a}')" for t in templates for k, a in template_overrides(t).items())
    return f"overrides(template, tracker, action) AS (VALUES {rows})"


_HIT_CTE = _RULE_CTE + """, hits AS (
  SELECT r.request_id, arg_min(p.tracker, p.ord) AS tracker, arg_min(p.category, p.ord) AS category,
    arg_min(p.default_action, p.ord) AS default_action
  FROM requests r JOIN rules p ON contains(lower(r.url), p.pattern) GROUP BY r.request_id)"""


@query("resolve_trackers", "requests", """
SELECT r.request_id, h.tracker, h.category, coalesce(o.action, h.default_action) AS action
FROM requests r LEFT JOIN hits h USING (request_id) LEFT JOIN overrides o ON o.tracker = h.tracker""",
       ctes=_HIT_CTE + ", " + _override_cte("ultra-streng"))
def resolve_trackers(t):
    return classify.resolve_trackers(t.requests).select("request_id", "tracker", "category", "action")


_SUFFIX = """(CASE WHEN contains(p.pattern, '/') OR ends_with(p.pattern, '.php') OR ends_with(p.pattern, '.js') OR ends_with(p.pattern, '.')
   THEN contains(lower(r.url), p.pattern)
   ELSE ends_with('.' || regexp_replace(lower(regexp_extract(r.url, '^[a-zA-Z]+://([^/?#]+)', 1)), ':[0-9]*$', ''), '.' || ltrim(p.pattern, '.')) END)"""


@query("resolve_trackers_by_host", "requests", """
SELECT r.request_id, h.tracker, coalesce(o.action, h.default_action) AS action
FROM requests r LEFT JOIN hits h USING (request_id) LEFT JOIN overrides o ON o.tracker = h.tracker""",
       ctes=_HIT_CTE.replace("contains(lower(r.url), p.pattern)", _SUFFIX) + ", " + _override_cte("marketing-light"))
def resolve_trackers_by_host(t):
    out = classify.resolve_trackers(t.requests, template="marketing-light", match="host_suffix")
    return out.select("request_id", "tracker", "action")


def _lists_cte() -> str:
    def values(items) -> str:
        return "[" + ", ".join(f"'{x}'" for x in items) + "]::VARCHAR[]"

    return "lists(tracker, cookies, strip_fields) AS (VALUES " + ", ".join(f"('{r.key}', {values(r.cookies)}, {values(r.strip_fields)})" for r in _RULES) + ")"


@query("resolve_lists", "requests", """
SELECT r.request_id, array_to_string(l.cookies, ',') AS cookies, array_to_string(l.strip_fields, ',') AS strip_fields
FROM requests r LEFT JOIN hits h USING (request_id) LEFT JOIN lists l USING (tracker)""", ctes=_HIT_CTE + ", " + _lists_cte())
def resolve_lists(t):
    """Cookies and fields that the rule of each request lists."""
    found = classify.resolve_trackers(t.requests)
    return found.select("request_id", *[F.array_join(x, ",").alias(x) for x in ("cookies", "strip_fields")])


_CATEGORY_CTE = "labels_of(category, label) AS (VALUES " + ", ".join(f"('{x[0]}', '{x[1]}')" for x in CATEGORIES) + ")"


@query("category_labels", "requests", """
SELECT h.category, l.label, count(*) AS requests FROM hits h LEFT JOIN labels_of l USING (category) GROUP BY ALL""", ctes=_HIT_CTE + ", " + _CATEGORY_CTE)
def category_labels(t):
    found = classify.resolve_trackers(t.requests).where("tracker IS NOT NULL")
    return found.join(categories_df(t.spark).select("category", "label"), "category", "left").groupBy("category", "label").agg(F.count("*").alias("requests"))


_NAMED_CTE = "named(tracker, name, vendor, category) AS (VALUES " + ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (r.key, r.name, r.vendor, r.category)) + ")" for r in _RULES) + ")"


@query("catalogue_requests", "requests", """
SELECT n.tracker, count(h.request_id) AS requests FROM named n LEFT JOIN hits h USING (tracker)
WHERE n.category = 'analytics' AND (contains(lower(n.name), 'google') OR contains(lower(n.vendor), 'google')) GROUP BY 1""", ctes=_HIT_CTE + ", " + _NAMED_CTE)
def catalogue_requests(t):
    """Requests of the trackers that a search in the catalogue finds."""
    listed = classify.search_catalogue(rules_df(t.spark), "analytics", "Google").select(c("tracker").alias("_t"))
    found = classify.resolve_trackers(t.requests).select("request_id", c("tracker").alias("_f"))
    return listed.join(found, c("_t") == c("_f"), "left").groupBy(c("_t").alias("tracker")).agg(F.count("request_id").alias("requests"))


_CUSTOM = """SELECT concat('c', c_custkey) AS customer_id, CAST(c_nationkey AS INT) AS ord,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Target.com' WHEN 'MACHINERY' THEN 'hotjar.com' ELSE 'example.com' END AS domain,
  CASE c_nationkey % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'strip' ELSE 'block' END AS action FROM {customer}"""
_CUSTOM_DUCK = _CUSTOM.replace("{customer}", "customer")


@query("resolve_custom", "requests", """
SELECT r.request_id, coalesce(m.domain, h.tracker) AS tracker,
  CASE WHEN m.domain IS NOT NULL THEN m.action ELSE coalesce(o.action, h.default_action) END AS action, m.domain IS NOT NULL AS custom
FROM requests r LEFT JOIN hits h USING (request_id) LEFT JOIN overrides o ON o.tracker = h.tracker
LEFT JOIN mine m USING (request_id)""",
       ctes=_HIT_CTE + ", " + _override_cte("basis-analytics") + f""", mine AS (
  SELECT r.request_id, arg_min(k.domain, k.ord) AS domain, arg_min(k.action, k.ord) AS action
  FROM requests r JOIN ({_CUSTOM_DUCK}) k ON k.customer_id = r.customer_id AND contains(lower(r.url), lower(k.domain)) GROUP BY 1)""")
def resolve_custom(t):
    out = classify.resolve_trackers(t.requests, template="basis-analytics", custom_rules=t.sql(_CUSTOM))
    return out.select("request_id", "tracker", "action", "custom")


# Five customers with thousands of rules each, some of which match.
_MANY = """SELECT concat('c', o_orderkey % 5) AS customer_id, CAST(o_orderkey AS INT) AS ord,
  CASE WHEN o_orderkey % 50 = 7 THEN concat('UID=u', o_custkey % 40, '&') WHEN o_orderkey % 50 = 9 THEN 'js' ELSE concat('rule', o_orderkey, '.example') END AS domain,
  CASE o_orderkey % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'strip' ELSE 'block' END AS action FROM {orders}"""


@query("resolve_custom_many", "requests", f"""
SELECT r.request_id, m.domain AS own_rule, m.action AS own_action FROM requests r JOIN (
  SELECT r.request_id, arg_min(k.domain, k.ord) AS domain, arg_min(k.action, k.ord) AS action
  FROM (SELECT * FROM requests WHERE customer_id IN ('c0', 'c1', 'c2', 'c3', 'c4')) r JOIN ({_MANY.replace('{orders}', 'orders')}) k
  ON k.customer_id = r.customer_id AND contains(lower(r.url), lower(k.domain)) GROUP BY 1) m USING (request_id)""")
def resolve_custom_many(t):
    out = classify.resolve_trackers(t.requests, custom_rules=t.sql(_MANY)).where("custom")
    return out.select("request_id", c("tracker").alias("own_rule"), c("action").alias("own_action"))


_CHOICES = """SELECT concat('c', c_custkey) AS customer_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'ultra-streng' WHEN 'MACHINERY' THEN 'basis-analytics'
  WHEN 'BUILDING' THEN 'alles-allow' WHEN 'FURNITURE' THEN 'marketing-light' ELSE 'custom' END AS template FROM {customer}"""
_MANUAL = """SELECT concat('c', c_custkey) AS customer_id, CASE WHEN c_acctbal > 5000 THEN 'ga4' ELSE 'hotjar' END AS tracker,
  CASE WHEN c_nationkey > 12 THEN 'allow' ELSE 'block' END AS action FROM {customer}"""
_CONFIG_SQL = (
    f"SELECT ch.customer_id, ch.template, d.tracker, coalesce(m.action, o.action, d.default_action) AS action "
    f"FROM ({_CHOICES.replace('{customer}', 'customer')}) ch CROSS JOIN (SELECT DISTINCT tracker, default_action FROM rules) d "
    "LEFT JOIN overrides o ON o.template = ch.template AND o.tracker = d.tracker "
    f"LEFT JOIN ({_MANUAL.replace('{customer}', 'customer')}) m ON m.customer_id = ch.customer_id AND m.tracker = d.tracker"
)
_ALL_ALLOW = ", ".join(f"('alles-allow', '{r.key}', 'allow')" for r in _RULES)
_CONFIG_CTE = _RULE_CTE + ", " + _override_cte("ultra-streng", "basis-analytics", "marketing-light")[:-1] + f", {_ALL_ALLOW})"


def _config(t: Inputs) -> DataFrame:
    return classify.effective_config(t.sql(_CHOICES), rules_df(t.spark), templates_df(t.spark), t.sql(_MANUAL))


@query("effective_config", "", _CONFIG_SQL, ctes=_CONFIG_CTE)
def effective_config(t):
    return _config(t).select("customer_id", "template", "tracker", "action")


@query("action_counts", "", f"""
SELECT customer_id, count(*) AS total, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'strip') AS stripped,
  count(*) FILTER (action = 'allow') AS allowed, any_value(n.custom) AS custom FROM ({_CONFIG_SQL})
  JOIN (SELECT customer_id, count(*) AS custom FROM ({_CUSTOM_DUCK}) GROUP BY 1) n USING (customer_id) GROUP BY 1""", ctes=_CONFIG_CTE)
def action_counts(t):
    return classify.action_counts(_config(t), t.sql(_CUSTOM))


_ROUTE_SQL = (
    f"CASE WHEN regexp_matches(url, '(?i){ROUTE_PATTERNS[0][1]}') THEN 'piwik' WHEN regexp_matches(url, '(?i){ROUTE_PATTERNS[1][1]}') THEN 'adobe' ELSE 'generic' END"
)


@query("route_vendor", "requests", f"SELECT request_id, {_ROUTE_SQL} AS route FROM requests")
def route_vendor(t):
    return t.requests.select("request_id", web.vendor_route(c("url")).alias("route"))


_INTERCEPT_SQL = "(NOT starts_with({u}, 'https://relay.example') AND regexp_matches({u}, '" + "|".join(INTERCEPT_PATTERNS) + "'))"


@query("original_urls", "requests", "SELECT request_id, url FROM requests")
def original_urls(t):
    relay = F.concat(F.lit("https://relay.example/proxy/x?k=1&_orig="), F.url_encode(c("url")), F.lit("&b=2"))
    return t.requests.select("request_id", relay.alias("relay_url")).select(
        "request_id", events.original_url(c("relay_url")).alias("url")
    )


@query("intercept_requests", "requests", f"""
SELECT request_id, {_INTERCEPT_SQL.format(u='url')} AS intercepted, split_part(url, '?', 1) AS bare_url FROM requests""")
def intercept_requests(t):
    return t.requests.select(
        "request_id", web.is_intercepted(c("url")).alias("intercepted"), web.url_without_query(c("url")).alias("bare_url")
    )


_COOKIES = """SELECT event_id, user_id, section, concat(CASE event_id % 9 WHEN 0 THEN '_ga' WHEN 1 THEN ' _gat_UA' WHEN 2 THEN 'session' WHEN 3 THEN 'mp_x'
  WHEN 4 THEN 'fresh' WHEN 5 THEN 'consent' WHEN 6 THEN '_hjSession_1' WHEN 7 THEN 'cart' ELSE 'NIDx' END, '=', event_id, '; path=/') AS cookie FROM {visits}"""
_COOKIE_CTE = f"cookies AS ({_COOKIES.replace('{visits}', 'visits')})"
_COOKIE_SQL = "regexp_matches(trim(split_part(cookie, '=', 1)), '^(" + "|".join(COOKIE_PREFIXES) + ")')"


@query("cookie_audit", "visits", f"""
SELECT trim(split_part(cookie, '=', 1)) AS name, {_COOKIE_SQL} AS blocked, count(*) AS n FROM cookies GROUP BY 1, 2""", ctes=_COOKIE_CTE)
def cookie_audit(t):
    return t.sql(_COOKIES).groupBy(
        web.cookie_name(c("cookie")).alias("name"), web.is_blocked_cookie(c("cookie")).alias("blocked")
    ).agg(F.count("*").alias("n"))


_RESOURCES = """SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS section, concat(html, CASE page_id % 4
  WHEN 0 THEN '<script src="https://connect.facebook.net/en_US/fbevents.js"></script>'
  WHEN 1 THEN '<img width="1" src="https://www.facebook.com/tr?id=1"><script async src="/app.js"></script>'
  WHEN 2 THEN '<link rel="preload" href="https://mc.yandex.ru/x"><img src="/logo.png">'
  ELSE '<script src="https://bat.bing.com/bat.js"></script><script src="https://bat.bing.com/bat.js"></script>' END) AS html FROM {pages}"""


def _extract_sql(kind: str, tag: str, attr: str) -> str:
    pattern = f"""(?i)<{tag}\\s(?:[^>]*?\\s)?{attr}\\s*=\\s*["'']([^"'']+)["'']"""
    return f"SELECT page_id, section, '{kind}' AS kind, unnest(regexp_extract_all(html, '{pattern}', 1)) AS resource_url FROM res"


_RESOURCE_CTE = f"res AS ({_RESOURCES.replace('{pages}', 'pages')}), found AS (" + " UNION ALL ".join(
    _extract_sql(*tag) for tag in classify.RESOURCE_TAGS
) + f"""), judged AS (SELECT *, {_INTERCEPT_SQL.format(u='resource_url')}
  OR (kind = 'script' AND regexp_matches(resource_url, '{"|".join(SCRIPT_PATTERNS)}')) AS blocked FROM found)"""


@query("page_resources", "", "SELECT page_id, kind, resource_url, blocked FROM judged", ctes=_RESOURCE_CTE)
def page_resources(t):
    return classify.page_resources(t.sql(_RESOURCES)).select("page_id", "kind", "resource_url", "blocked")


@query("protection_counters", "requests", f"""
SELECT section, sum(b)::BIGINT AS blocked, sum(k)::BIGINT AS cookies, sum(s)::BIGINT AS scripts, sum(p)::BIGINT AS pixels FROM (
  SELECT section, CASE WHEN {_INTERCEPT_SQL.format(u='url')} THEN 1 ELSE 0 END AS b, 0 AS k, 0 AS s, 0 AS p FROM requests
  UNION ALL SELECT section, 0, CASE WHEN {_COOKIE_SQL} THEN 1 ELSE 0 END, 0, 0 FROM cookies
  UNION ALL SELECT section, 0, 0, CASE WHEN blocked AND kind = 'script' THEN 1 ELSE 0 END, CASE WHEN blocked AND kind = 'pixel' THEN 1 ELSE 0 END FROM judged)
GROUP BY section""", ctes=_COOKIE_CTE + ", " + _RESOURCE_CTE)
def protection_counters(t):
    return classify.protection_counters(
        "section", t.requests, t.sql(_COOKIES), classify.page_resources(t.sql(_RESOURCES))
    )


# ---------------------------------------------------------------- vendor requests

def _strip_fields(key: str) -> list[str]:
    return next([f.lower() for f in r.strip_fields] for r in _RULES if r.key == key)


def _strip_sql(key: str) -> str:
    """URL stripped under one rule, the token put in after scrubbing."""
    hit = "(" + " OR ".join(f"starts_with(lower(split_part(p, '=', 1)), '{f}')" for f in _strip_fields(key)) + ")"
    pseudo = "regexp_matches(lower(split_part(p, '=', 1)), '^(_id|uid|cid|vid|aid|mid|duid|_pk_id|visitor|distinct_id)')"
    kept = f"list_filter({sql.params('url')}, lambda p: NOT {hit} OR {pseudo})"
    marked = f"list_transform({kept}, lambda p: CASE WHEN {hit} THEN split_part(p, '=', 1) || '=<<T>>' ELSE p END)"
    return f"replace({sql.scrub('(' + sql.join_query(sql.base('url'), marked) + ')')}, '<<T>>', {sql.visitor()})"


@query("strip_urls", "requests", f"""
SELECT request_id, route, CASE route WHEN 'piwik' THEN {_strip_sql('piwik_pro')} ELSE {_strip_sql('adobe_analytics')} END AS clean_url,
  CASE WHEN method = 'POST' THEN '{{"k":' || json_extract_string(body, '$.k') || '}}' END AS clean_body
FROM (SELECT *, {_ROUTE_SQL} AS route FROM requests) WHERE route <> 'generic'""")
def strip_urls(t):
    return events.strip_requests(t.requests, SALTS).select("request_id", "route", "clean_url", "clean_body")


def _value_sql(name: str) -> str:
    return f"regexp_replace(list_filter({sql.params('url')}, lambda p: split_part(p, '=', 1) = '{name}')[1], '^[^=]*=?', '')"


def _flat_map(m: Column, names: list[str]) -> list[Column]:
    return [F.try_element_at(m, F.lit(n)).alias(f"p_{n}") for n in names]


_GA4_NAMES = ["v", "tid", "en", "dl", "cid", "uip", "uid"]


@query("ga4_params", "requests", f"""
SELECT request_id, {', '.join(f"nullif(substr({_value_sql(n)}, 1, 200), '') AS p_{n}" for n in ('v', 'tid', 'en', 'dl'))},
  {sql.token(f"nullif({_value_sql('cid')}, '') || '|cid'")} AS p_cid, {sql.token(sql.ip24('ip'))} AS p_uip, CAST(NULL AS VARCHAR) AS p_uid
FROM requests""")
def ga4_params(t):
    kept = events.ga4_params(c("url"), c("ip"), SALTS, c("ts"))
    return t.requests.select("request_id", kept.alias("m")).select("request_id", *_flat_map(c("m"), _GA4_NAMES))


@query("meta_params", "requests", f"""
SELECT request_id, {', '.join(f"nullif(substr({_value_sql(n)}, 1, 200), '') AS p_{n}" for n in ('id', 'ev'))},
  {sql.token(sql.ip24('ip'))} AS p__anon, CAST(NULL AS VARCHAR) AS p_fbp FROM requests""")
def meta_params(t):
    kept = events.meta_params(c("url"), c("ip"), SALTS, c("ts"))
    return t.requests.select("request_id", kept.alias("m")).select("request_id", *_flat_map(c("m"), ["id", "ev", "_anon", "fbp"]))


_GENERIC_KEPT = f"list_filter({sql.params('url')}, lambda p: split_part(p, '=', 1) NOT IN ({sql.words(events.GENERIC_DROP)}))"


@query("generic_params", "requests", f"""
SELECT request_id, {sql.join_query("split_part(split_part(url, '#', 1), '?', 1)", _GENERIC_KEPT)} || regexp_extract(url, '(#.*)$', 1) AS clean_url
FROM requests""")
def generic_params(t):
    return t.requests.select("request_id", events.generic_url(c("url")).alias("clean_url"))


_GA4_BODY = """concat('{"client": "x", "events": [{"name": "', e, '", "params": {"user_id": ', user_id, ', "page": "', event_id, '", "email": "u@x.nl"}}, {"name": "plain"}]}')"""


@query("ga4_bodies", "visits", """
SELECT event_id, concat('{"client":"x","events":[{"name":"', e, '","params":{"page":"', event_id, '"}},{"name":"plain","params":{}}]}') AS body FROM visits""")
def ga4_bodies(t):
    return t.visits.select("event_id", events.drop_event_params(F.expr(_GA4_BODY)).alias("body"))


def _headers(t: Inputs) -> DataFrame:
    return t.requests.withColumn("headers", F.create_map(
        F.lit("Cookie"), F.concat(F.lit("id="), c("request_id")), F.lit("Accept"), F.lit("text/html"), F.lit("X-Real-IP"), c("ip"),
        F.when(c("method") == "POST", "Content-Type").otherwise("X-Other"), F.lit("text/css"), F.lit("Referer"), c("origin"),
    ))


@query("headers_filtered", "requests", """
SELECT request_id, CASE WHEN method = 'POST' THEN 'Accept,Content-Type' ELSE 'Accept,X-Other' END AS names FROM requests""")
def headers_filtered(t):
    kept = F.array_join(F.array_sort(F.map_keys(events.filter_headers(c("headers")))), ",")
    return _headers(t).select("request_id", kept.alias("names"))


@query("forward_headers", "requests", f"""
SELECT request_id, CASE WHEN method = 'POST' THEN 'text/css' ELSE 'text/plain' END AS content_type, {sql.ua_class('ua')} AS user_agent,
  '0.0.0.0' AS forwarded_for, 'text/html' AS accept, '' AS cookie FROM requests""")
def forward_headers(t):
    out = events.forward_headers(c("headers"), c("ua"), c("method") == "POST")
    names = {"content-type": "content_type", "user-agent": "user_agent", "x-forwarded-for": "forwarded_for", "accept": "accept", "cookie": "cookie"}
    rows = _headers(t).select("request_id", out.alias("m"))
    return rows.select("request_id", *[F.try_element_at("m", F.lit(k)).alias(v) for k, v in names.items()])


@query("vendor_events", "requests", f"""
SELECT request_id, {sql.visitor()} AS visitor, {sql.host('origin')} AS domain, 'tracker_' || key AS event, '/' || key AS path, '' AS referrer,
  {sql.country('country')} AS country, CASE WHEN regexp_matches(lower(ua), 'mobi|android|iphone') THEN 'mobile' ELSE 'desktop' END AS device, '{{}}' AS props
FROM (SELECT *, CASE {_ROUTE_SQL} WHEN 'piwik' THEN '{ROUTE_TRACKER['piwik']}' WHEN 'adobe' THEN '{ROUTE_TRACKER['adobe']}' END AS key FROM requests)
WHERE key IS NOT NULL""")
def vendor_events(t):
    return events.vendor_events(t.requests, SALTS).select(
        "request_id", "visitor", "domain", "event", "path", "referrer", "country", "device", "props"
    )


_ACTION_SQL = "CASE user_no % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'strip' WHEN 2 THEN 'allow' ELSE 'other' END"
_ROUTED = """SELECT request_id, url, CASE request_id % 3 WHEN 0 THEN 'piwik' WHEN 1 THEN 'adobe' ELSE 'generic' END AS route,
  CAST(substr(customer_id, 2) AS BIGINT) AS user_no FROM {requests}"""


@query("request_disposition", "requests", f"""
SELECT request_id, CASE WHEN url = '' THEN 'dropped' WHEN route <> 'generic' THEN 'forwarded' WHEN action = 'block' THEN 'blocked'
    WHEN action IN ('allow', 'strip') THEN 'forwarded' ELSE 'processed' END AS disposition,
  CASE WHEN url = '' AND route <> 'generic' THEN 'blocked' WHEN url = '' THEN NULL WHEN route <> 'generic' THEN 'stripped'
    WHEN action = 'block' THEN 'blocked' WHEN action = 'strip' THEN 'stripped' ELSE 'allowed' END AS counted_as
FROM (SELECT *, {_ACTION_SQL} AS action FROM ({_ROUTED.replace('{requests}', 'requests')}))""")
def request_disposition(t):
    disposition, counted = events.request_disposition(c("route"), c("url"), F.expr(_ACTION_SQL))
    return t.sql(_ROUTED).select("request_id", disposition.alias("disposition"), counted.alias("counted_as"))


# ---------------------------------------------------------------- usage and feeds

_USAGE_SQL = """SELECT customer_id, strftime(ts, '%Y-%m') AS month, count(*) AS requests, count(*) FILTER (action = 'blocked') AS blocked,
  count(*) FILTER (action = 'strip') AS stripped, count(*) FILTER (action NOT IN ('blocked', 'strip')) AS allowed FROM usage_log GROUP BY 1, 2"""


@query("usage_monthly", "usage_log", _USAGE_SQL)
def usage_monthly(t):
    return usage.monthly_usage(t.usage_log)


@query("usage_merged", "usage_log", f"""
SELECT customer_id, month, sum(requests)::BIGINT AS requests, sum(blocked)::BIGINT AS blocked, sum(stripped)::BIGINT AS stripped,
  sum(allowed)::BIGINT AS allowed FROM ({_USAGE_SQL} UNION ALL {_USAGE_SQL}) GROUP BY 1, 2""")
def usage_merged(t):
    monthly = usage.monthly_usage(t.usage_log)
    return usage.merge_usage(monthly, monthly)


def _pct(col: str) -> str:
    return f"CASE WHEN coalesce(requests, 0) > 0 THEN CAST(floor({col} * 1.0 / requests * 100 + 0.5) AS BIGINT) ELSE 0 END AS pct_{col}"


@query("feed_totals", "usage_log projects", f"""
SELECT p.feed_hash, '1997-05' AS month, {', '.join(f'coalesce(u.{k}, 0) AS {k}' for k in usage.COUNTERS)}, {', '.join(map(_pct, usage.COUNTERS[1:]))}
FROM projects p LEFT JOIN ({_USAGE_SQL}) u ON u.customer_id = 'c' || p.customer_id_ref AND u.month = '1997-05'""")
def feed_totals(t):
    projects = t.projects.withColumn("customer_id_ref", F.concat(F.lit("c"), c("customer_id_ref")))
    return usage.feed_totals(projects, usage.monthly_usage(t.usage_log), "1997-05")


@query("feed_breakdown", "requests feed_events", """
SELECT feed_hash, coalesce(nullif(tracker, ''), 'unknown') AS tracker, count(*) FILTER (action IN ('block', 'blocked')) AS blocked,
  count(*) FILTER (action IN ('strip', 'stripped')) AS stripped,
  count(*) FILTER (coalesce(action, 'allow') NOT IN ('block', 'blocked', 'strip', 'stripped')) AS allowed FROM feed_events GROUP BY 1, 2""")
def feed_breakdown(t):
    return usage.feed_breakdown(t.feed_events)


_FEED_NOW = "2024-01-30 22:00:00"


@query("feed_capped", "requests feed_events", f"""
SELECT event_id, feed_hash FROM (SELECT *, row_number() OVER (PARTITION BY feed_hash ORDER BY ts DESC, event_id DESC) AS place
  FROM feed_events WHERE epoch_us(TIMESTAMP '{_FEED_NOW}') - epoch_us(ts) < 864000000000) WHERE place <= 12""")
def feed_capped(t):
    return usage.cap_feed(t.feed_events, _FEED_NOW, seconds=864_000, cap=12).select("event_id", "feed_hash")


@query("feed_recent", "requests feed_events", """
SELECT event_id, feed_hash, rank FROM (SELECT *, row_number() OVER (PARTITION BY feed_hash ORDER BY ts DESC, event_id DESC) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY feed_hash ORDER BY ts, event_id) AS place FROM feed_events) WHERE place <= 50) WHERE rank <= 20""")
def feed_recent(t):
    return usage.recent_events(t.feed_events, listed=50).select("event_id", "feed_hash", c("rank").cast("bigint").alias("rank"))


_JSON_LINES = """SELECT event_id, CASE WHEN event_type = 'error' THEN concat('not json ', event_id)
  ELSE concat('{{"ts": "', CAST(date_trunc('second', ts) AS STRING), '", "tracker": "', event_type, '", "action": "strip"}}') END AS line FROM {events}"""


@query("parse_json_list", "", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type AS tracker, 'strip' AS action FROM events WHERE event_type <> 'error'")
def parse_json_list(t):
    return io.parse_json_list(t.sql(_JSON_LINES), "line").withColumn("ts", text_time(c("ts")))


# ---------------------------------------------------------------- page audit

_RELAYS = ["relay.example"]
_AUDIT_CASE = "CASE " + " ".join(f"WHEN contains(lower(url), '{h}') THEN '{h}'" for h in AUDIT_HOSTS) + " END"
_AUDIT_CTE = f"""seen AS (SELECT {sql.host('origin')} AS page_host, regexp_replace({sql.host('url')}, ':[0-9]*$', '') AS host, {_AUDIT_CASE} AS hit FROM requests),
leak AS (SELECT page_host, count(*) AS total,
  coalesce(string_agg(DISTINCT hit, ',' ORDER BY hit) FILTER (host <> 'relay.example'), '') AS direct,
  coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (host = 'relay.example'), '') AS relayed FROM seen GROUP BY 1)"""


def _leakage(t: Inputs) -> DataFrame:
    return audit.page_leakage(t.requests.select(web.origin_host(c("origin")).alias("page_host"), "ts", "url"), _RELAYS)


@query("page_leakage", "requests", "SELECT * FROM leak", ctes=_AUDIT_CTE)
def page_leakage(t):
    return _leakage(t).select("page_host", "total", *[F.array_join(s, ",").alias(s) for s in ("direct", "relayed")])


@query("leakage_verdict", "requests attestations", """
SELECT l.page_host, l.total, CASE WHEN ok AND direct = '' THEN 'protected' WHEN ok THEN 'partial' WHEN direct <> '' THEN 'unprotected' ELSE 'clean' END AS verdict
FROM (SELECT l.*, coalesce(a.enrolled, false) AND coalesce(a.signature_valid, true) AS ok FROM leak l LEFT JOIN
  (SELECT x.domain, x.enrolled, x.signature_valid FROM attestations x JOIN (SELECT domain, max(event_id) AS m FROM attestations GROUP BY 1) y ON x.event_id = y.m) a
  ON a.domain = l.page_host) l""", ctes=_AUDIT_CTE)
def leakage_verdict(t):
    # The newest attestation counts, also where its signature could not be checked.
    newest = t.attestations.groupBy("domain").agg(
        *[F.max_by(x, "event_id").alias(x) for x in ("enrolled", "signature_valid")]
    )
    return audit.leakage_verdict(_leakage(t), newest).select("page_host", "total", "verdict")


def _projects(t: Inputs) -> DataFrame:
    return t.projects.withColumn("allowed_domains", F.filter(F.split("domains", ","), lambda d: d != ""))


_LISTED_SQL = """SELECT DISTINCT regexp_replace(d, '^www\\.', '') AS listed FROM (
  SELECT unnest(string_split(p.domains, ',')) AS d FROM projects p JOIN customers k ON k.id = p.customer_id_ref WHERE k.enabled) WHERE d <> ''"""


@query("enrolled_domains", "visits projects customers", f"""
SELECT event_id, domain FROM (SELECT event_id, {sql.host('origin')} AS domain FROM visits) v
WHERE regexp_replace(domain, '^www\\.', '') IN (SELECT listed FROM ({_LISTED_SQL}))""")
def enrolled_domains(t):
    domains = t.visits.select("event_id", web.origin_host(c("origin")).alias("domain"))
    return audit.enrolled_domains(domains, _projects(t), t.customers)


_ASKED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.nl' WHEN 1 THEN regexp_replace(origin, '^https?://', '') WHEN 2 THEN concat(user_id % 70, '.example.org')
  ELSE concat('www.', user_id % 9, '.example.net') END AS domain FROM {visits}"""


@query("enrolled_contains", "visits projects customers", f"""
SELECT event_id, domain FROM ({_ASKED.format(visits='visits')}) v
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT listed FROM ({_LISTED_SQL})) l WHERE contains(l.listed, regexp_replace(v.domain, '^www\\.', '')))""")
def enrolled_contains(t):
    return audit.enrolled_domains(t.sql(_ASKED), _projects(t), t.customers, "contains")


@query("attestation_fresh", "attestations", f"""
SELECT event_id, domain, nonce FROM (SELECT *, row_number() OVER (PARTITION BY nonce ORDER BY ts, domain) AS use FROM attestations)
WHERE use = 1 AND epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts) <= ttl_ms AND lower(domain) = lower(inspected) AND public_key = 'pinned'""")
def attestation_fresh(t):
    return audit.fresh_attestations(t.attestations, NOW, "inspected", "pinned").select("event_id", "domain", "nonce")


# ---------------------------------------------------------------- limits

_HITS = "SELECT event_id AS hit_id, user_id AS key, ts FROM {visits}"
_HIT_DUCK = "hits AS (SELECT event_id AS hit_id, user_id AS key, ts FROM visits)"


@query("rate_limit_fixed", "visits", """
SELECT hit_id, row_number() OVER (PARTITION BY key, epoch_us(ts) // 86400000000 ORDER BY ts, hit_id) <= 2 AS allowed FROM hits""", ctes=_HIT_DUCK)
def rate_limit_fixed(t):
    return limits.fixed_window_limit(t.sql(_HITS), 2, 86400).select("hit_id", "allowed")


_FRESH_HIT = "o.sec >= s.last_ok + 172800"
_ROOM = f"({_FRESH_HIT} OR s.used < 3)"


_RENEWING_CTE = _HIT_DUCK + f""",
o AS (SELECT hit_id, key, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY key ORDER BY ts, hit_id) AS rn FROM hits),
walk AS (SELECT hit_id, key, rn, sec AS last_ok, 1 AS used, true AS ok FROM o WHERE rn = 1
  UNION ALL SELECT o.hit_id, o.key, o.rn, CASE WHEN {_ROOM} THEN o.sec ELSE s.last_ok END,
    CASE WHEN {_FRESH_HIT} THEN 1 WHEN s.used < 3 THEN s.used + 1 ELSE s.used END, {_ROOM}
  FROM walk s JOIN o ON o.key = s.key AND o.rn = s.rn + 1)"""


@query("rate_limit_renewing", "visits", "SELECT hit_id, ok AS allowed FROM walk", ctes=_RENEWING_CTE, recursive=True)
def rate_limit_renewing(t):
    return limits.renewing_limit(t.sql(_HITS), 3, 172_800).select("hit_id", "allowed")


_FAILURES = "SELECT user_id AS source, ts FROM {visits} WHERE e = 'error'"


_RUNS_SQL = f"""
SELECT source, {sql_time('min(ts)')} AS first_failure, {sql_time('max(ts)')} AS last_failure, count(*) AS failures,
  greatest(count(*) - 2, 0) AS flagged, count(*) >= 3 AS suspicious FROM (
  SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY ts) AS run FROM (
    SELECT source, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source ORDER BY ts) < 172800000000 THEN 0 ELSE 1 END AS opens
    FROM (SELECT user_id AS source, ts FROM visits WHERE e = 'error'))) GROUP BY source, run"""


@query("suspicious_sources", "visits", _RUNS_SQL)
def suspicious_sources(t):
    out = limits.suspicious_sources(t.sql(_FAILURES), threshold=3, seconds=172_800)
    return out.withColumns({"first_failure": text_time(c("first_failure")), "last_failure": text_time(c("last_failure"))})


# ---------------------------------------------------------------- accounts

_AUTH_SQL = """SELECT r.request_id, k.id AS account, k.plan, p.feed_hash, p.domains, r.ts, r.api_key, r.origin
  FROM requests r JOIN customers k ON k.api_key = r.api_key AND k.enabled JOIN projects p ON p.customer_id_ref = k.id"""


@query("authenticated_requests", "requests customers projects", f"SELECT request_id, account, plan, feed_hash FROM ({_AUTH_SQL})")
def authenticated_requests(t):
    out = accounts.authenticate(t.requests.drop("customer_id"), t.customers, _projects(t))
    return out.select("request_id", c("customer_id").alias("account"), "plan", "feed_hash")


@query("revoked_filter", "requests revocations", """
SELECT r.request_id FROM requests r WHERE NOT EXISTS (SELECT 1 FROM revocations v WHERE v.api_key = r.api_key
  AND r.ts >= v.revoked_at AND r.ts < v.revoked_at + INTERVAL 24 HOUR)""")
def revoked_filter(t):
    revoked = t.revocations.select(an.short_hash(c("api_key")).alias("key_hash"), "revoked_at")
    return accounts.drop_revoked(t.requests, revoked).select("request_id")


@query("domain_lock", "requests customers projects", f"""
SELECT request_id, domains = '' OR len(list_filter(string_split(domains, ','), lambda d: host = d OR ends_with(host, '.' || d))) > 0 AS allowed
FROM (SELECT *, {sql.host('origin')} AS host FROM ({_AUTH_SQL}))""")
def domain_lock(t):
    out = accounts.authenticate(t.requests.drop("customer_id"), t.customers, _projects(t))
    return out.select("request_id", accounts.domain_allowed(c("origin"), F.lit(None).cast("string"), c("allowed_domains")).alias("allowed"))


@query("customer_view", "users customers projects subscriptions", """
SELECT u.id AS user_id, u.email, k.api_key, k.plan, k.feed_hash, s.status AS sub_status FROM users u JOIN (
  SELECT c.*, p.feed_hash, row_number() OVER (PARTITION BY c.user_id ORDER BY c.created_at DESC, c.id DESC) AS place
  FROM customers c JOIN projects p ON p.customer_id_ref = c.id WHERE c.enabled) k ON k.user_id = u.id AND k.place = 1
LEFT JOIN subscriptions s ON s.customer_id_ref = k.id""")
def customer_view(t):
    return accounts.customer_view(t.users, t.customers, t.projects, t.subscriptions)


@query("login_candidates", "users", """
SELECT id, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) AS place
  FROM users WHERE deleted_at IS NULL) WHERE place = 1""")
def login_candidates(t):
    return accounts.login_candidates(t.users).select("id", "email")


_ERASE = """SELECT event_id, concat('u', user_id * 9, '@example.nl') AS email, CASE WHEN e = 'click' THEN
  concat('wk_', md5(CAST(user_id AS STRING)), substr(md5(concat('k', user_id)), 1, 16)) END AS api_key FROM {visits}"""
_ERASE_CTE = f"""asks AS ({_ERASE.replace('{visits}', 'visits').replace('AS STRING', 'AS VARCHAR')}),
live AS (SELECT id, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) AS place
  FROM users WHERE deleted_at IS NULL) WHERE place = 1),
subjects AS (SELECT a.event_id, coalesce(k.user_id, l.id) AS user_id FROM asks a LEFT JOIN customers k ON k.api_key = a.api_key LEFT JOIN live l ON l.email = a.email)"""


def _subjects(t: Inputs) -> DataFrame:
    return accounts.find_subjects(t.sql(_ERASE), t.users, t.customers)


@query("subject_lookup", "visits users customers", "SELECT event_id, coalesce(user_id, -1) AS user_id FROM subjects", ctes=_ERASE_CTE)
def subject_lookup(t):
    return _subjects(t).select("event_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


_ACTIVATIONS = "SELECT event_id, ts, concat('u', user_id * 11, '@example.nl') AS email FROM {visits} WHERE e = 'signup'"
_PENDING = """SELECT concat('u', user_id, '@example.nl') AS email, ts AS created_at, CASE e WHEN 'purchase' THEN true WHEN 'view' THEN false END AS payment_processed
  FROM {visits}"""
_ACTIVATION_CTE = """acts AS (SELECT event_id, ts, concat('u', user_id * 11, '@example.nl') AS email FROM visits WHERE e = 'signup'),
won AS (SELECT event_id, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, event_id) AS place FROM acts) WHERE place = 1
  AND email NOT IN (SELECT u.email FROM users u JOIN customers k ON k.user_id = u.id WHERE k.enabled)
  AND email NOT IN (SELECT concat('u', user_id, '@example.nl') FROM visits WHERE e = 'purchase'))"""


def _won(t: Inputs) -> DataFrame:
    return accounts.activate(t.sql(_ACTIVATIONS), t.users, t.customers, t.sql(_PENDING))


@query("activation_dedup", "visits users customers", "SELECT event_id, email FROM won", ctes=_ACTIVATION_CTE)
def activation_dedup(t):
    return _won(t).select("event_id", "email")


_CLOSE_CTE = "acts AS (SELECT DISTINCT concat('u', user_id * 11, '@example.nl') AS email FROM visits WHERE e = 'signup')"


@query("closed_accounts", "visits users customers", f"""
SELECT k.id, k.user_id, k.enabled AND k.user_id NOT IN (SELECT id FROM users WHERE deleted_at IS NULL AND email IN (SELECT email FROM acts)) AS enabled
FROM customers k""", ctes=_CLOSE_CTE)
def closed_accounts(t):
    _, customers = accounts.close_old_accounts(t.sql(_ACTIVATIONS), t.users, t.customers, NOW)
    return customers.select("id", "user_id", "enabled")


_RAW_ACCOUNTS = """SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN concat('  U', c_custkey, '@Example.NL ') WHEN 1 THEN 'no mail' ELSE concat('a+', c_custkey, '@x.nl') END AS email,
  CASE c_nationkey % 4 WHEN 0 THEN 'https://www.A.nl/path, b.nl' WHEN 1 THEN '-bad,ok.example' WHEN 2 THEN '' ELSE concat('s', c_custkey, '.example.org') END AS domain,
  lower(c_mktsegment) AS template, CASE c_nationkey % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'test' ELSE 'gold' END AS plan,
  concat(' <b>', c_name, '</b> ') AS name FROM {customer}"""


@query("clean_accounts", "", f"""
SELECT c_custkey, CASE WHEN regexp_matches(m, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') THEN m END AS email,
  CASE nk % 4 WHEN 0 THEN 'a.nl,b.nl' WHEN 1 THEN 'ok.example' WHEN 2 THEN '' ELSE domain END AS domains,
  CASE WHEN plan IN ('starter', 'pro', 'business', 'test') THEN plan ELSE 'starter' END AS plan, 'ultra-streng' AS template,
  regexp_replace(trim(name), '<[^>]*>', '', 'g') AS name
FROM (SELECT r.*, trim(lower(r.email)) AS m, k.c_nationkey AS nk FROM ({_RAW_ACCOUNTS.replace('{customer}', 'customer')}) r JOIN customer k USING (c_custkey))""")
def clean_accounts(t):
    return accounts.clean_accounts(t.sql(_RAW_ACCOUNTS)).withColumn("domains", F.array_join("domains", ","))


_SUSPECT = """SELECT event_id, concat('/p', u, CASE event_id % 11 WHEN 0 THEN '/../x' WHEN 1 THEN '%2e%2e' WHEN 2 THEN '%252e' WHEN 3 THEN '%00' ELSE '' END) AS url,
  CASE event_id % 13 WHEN 0 THEN '{{"__proto__": 1}}' WHEN 1 THEN '{{"constructor": 1}}' WHEN 2 THEN NULL ELSE p END AS body FROM {visits}"""


@query("quarantine", "visits", f"""
SELECT event_id, CASE WHEN contains(body, '__proto__') OR contains(body, 'constructor') OR contains(body, 'prototype') THEN 'invalid_input'
  WHEN contains(url, '..') OR contains(url, '%2e%2e') OR contains(url, '%252e') OR contains(url, '%00') THEN 'invalid_path' END AS reject_reason
FROM ({_SUSPECT.replace('{visits}', 'visits').replace('{{', '{').replace('}}', '}')})""")
def quarantine(t):
    return accounts.quarantine(t.sql(_SUSPECT)).select("event_id", "reject_reason")


_SYSTEM = """SELECT event_id, CASE event_type WHEN 'view' THEN 'key_activated' WHEN 'error' THEN 'rate_limit_hit' WHEN 'click' THEN 'key_rotated' ELSE 'gdpr_delete' END AS event_type,
  props AS meta, ts AS created_at FROM {events}"""


@query("security_events", "", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'key_activated' WHEN 'error' THEN 'rate_limit_hit' ELSE 'gdpr_delete' END AS event_type
FROM events WHERE event_type <> 'click'""")
def security_events(t):
    return io.select_security_events(t.sql(_SYSTEM)).select("event_id", "event_type")


# ---------------------------------------------------------------- retention and erasure

_PURGE_NOW = "2024-01-15 12:00:00"
_TRANSIENT = """SELECT event_id, concat('t', event_id) AS token, ts AS created_at, ts + INTERVAL '3' HOUR AS expires_at, e = 'click' AS used,
  CASE e WHEN 'purchase' THEN true WHEN 'error' THEN false END AS payment_processed FROM {visits}"""


@query("purge_expired", "visits", f"""
SELECT policy, sum(1 - gone)::BIGINT AS kept, sum(gone)::BIGINT AS purged FROM (
  SELECT 'pending_accounts' AS policy, CASE WHEN ts < TIMESTAMP '{_PURGE_NOW}' - INTERVAL 2 HOUR AND e <> 'purchase' THEN 1 ELSE 0 END AS gone FROM visits
  UNION ALL SELECT 'view_tokens', CASE WHEN ts + INTERVAL 3 HOUR < TIMESTAMP '{_PURGE_NOW}' - INTERVAL 1 HOUR THEN 1 ELSE 0 END FROM visits
  UNION ALL SELECT 'magic_links', CASE WHEN e = 'click' OR ts + INTERVAL 3 HOUR < TIMESTAMP '{_PURGE_NOW}' - INTERVAL 1 HOUR THEN 1 ELSE 0 END FROM visits)
GROUP BY policy""")
def purge_expired(t):
    rows = t.sql(_TRANSIENT)
    return retention.purge_counts({"pending_accounts": rows, "view_tokens": rows, "magic_links": rows}, _PURGE_NOW)


@query("purged_links", "visits", f"""
SELECT event_id FROM visits WHERE NOT (e = 'click' OR ts + INTERVAL 3 HOUR < TIMESTAMP '{_PURGE_NOW}' - INTERVAL 1 HOUR)""")
def purged_links(t):
    return retention.purge(t.sql(_TRANSIENT), "magic_links", _PURGE_NOW).select("event_id")


@query("purged_usage", "usage_log", f"SELECT customer_id, month, requests FROM ({_USAGE_SQL}) WHERE month >= '1999-08'")
def purged_usage(t):
    return retention.purge(usage.monthly_usage(t.usage_log), "usage_monthly", "2000-08-15 00:00:00").select("customer_id", "month", "requests")


@query("trial_expiry", "customers", """
SELECT id, enabled AND NOT (plan = 'test' AND created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 10 MINUTE) AS enabled FROM customers""")
def trial_expiry(t):
    return retention.expire_trials(t.customers, "1998-06-01 00:00:00").select("id", "enabled")


_ERASED_SQL = f"""
SELECT id, CASE WHEN id IN (SELECT user_id FROM subjects WHERE user_id IS NOT NULL) THEN 'deleted_' || substr(md5(CAST(id AS VARCHAR)), 1, 16) || '@deleted' ELSE email END AS email,
  {sql_time(f"CASE WHEN id IN (SELECT user_id FROM subjects WHERE user_id IS NOT NULL) THEN TIMESTAMP '{NOW}' ELSE deleted_at END")} AS deleted_at FROM users"""


@query("erased_users", "visits users customers", _ERASED_SQL, ctes=_ERASE_CTE)
def erased_users(t):
    users, _, _ = retention.erase_subjects(_subjects(t), t.users, t.customers, NOW, F.substring(F.md5(c("id").cast("string")), 1, 16))
    return users.select("id", "email", text_time(c("deleted_at")).alias("deleted_at"))


@query("erased_in_files", "visits users customers", _ERASED_SQL, ctes=_ERASE_CTE)
def erased_in_files(t):
    """The user table as files, of which only those with a subject are written anew."""
    table = KeyedTable(t.spark, shared_dir(t.spark, "users"), "id")
    table.write(t.users)
    subjects = reliable_checkpoint(_subjects(t).select("user_id"))
    random = F.substring(F.md5(c("id").cast("string")), 1, 16)
    table.change(subjects, lambda rows: retention.erase_subjects(subjects, rows, t.customers, NOW, random)[0])
    return table.read().select("id", "email", text_time(c("deleted_at")).alias("deleted_at"))


@query("erased_customers", "visits users customers", """
SELECT id, enabled AND user_id NOT IN (SELECT user_id FROM subjects WHERE user_id IS NOT NULL) AS enabled FROM customers""", ctes=_ERASE_CTE)
def erased_customers(t):
    return retention.erase_subjects(_subjects(t), t.users, t.customers, NOW)[1].select("id", "enabled")


@query("erasure_audit", "visits users customers", f"""
SELECT substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS user_hash, '{NOW}.000000' AS deleted_at, 'user_confirmed' AS reason
FROM (SELECT DISTINCT user_id FROM subjects WHERE user_id IS NOT NULL)""", ctes=_ERASE_CTE)
def erasure_audit(t):
    audit_rows = retention.erase_subjects(_subjects(t), t.users, t.customers, NOW)[2]
    return audit_rows.withColumn("deleted_at", text_time(c("deleted_at")))


_ENDED = "SELECT DISTINCT concat('u', user_id, '@example.nl') AS email FROM {visits} WHERE e = 'error' AND country = 'DE'"
_ENDED_CTE = "owners AS (SELECT id FROM users WHERE email IN (SELECT concat('u', user_id, '@example.nl') FROM visits WHERE e = 'error' AND country = 'DE'))"


@query("cascade_customers", "visits users customers", "SELECT id, enabled AND user_id NOT IN (SELECT id FROM owners) AS enabled FROM customers", ctes=_ENDED_CTE)
def cascade_customers(t):
    return retention.cascade_delete(t.sql(_ENDED), t.users, t.customers, t.projects, t.feed_events)[0].select("id", "enabled")


@query("cascade_feed", "requests users customers projects feed_events", """
SELECT event_id, feed_hash FROM feed_events WHERE feed_hash NOT IN (SELECT p.feed_hash FROM projects p JOIN customers k ON k.id = p.customer_id_ref
  WHERE k.user_id IN (SELECT id FROM owners))""", ctes=_ENDED_CTE)
def cascade_feed(t):
    return retention.cascade_delete(t.sql(_ENDED), t.users, t.customers, t.projects, t.feed_events)[1].select("event_id", "feed_hash")


# ---------------------------------------------------------------- streams

STEPS = 4
_MICROS = "unix_micros(CAST({ts} AS TIMESTAMP))"


def _by_time(rows: DataFrame, ts: str = "ts", steps: int = STEPS) -> Column:
    """Number of the step of each row, in time order; rows without a time come first."""
    at = F.unix_micros(c(ts))
    borders = rows.agg(F.percentile_approx(at, [i / steps for i in range(1, steps)])).first()[0] or []
    return sum((F.coalesce((at > b).cast("int"), F.lit(0)) for b in borders), F.lit(0))


def _stream(t: Inputs, rows: DataFrame, part: str, start, number: Column | None = None, steps: int = STEPS) -> str:
    """Hand the rows to a stream in ``steps`` batches, each written by as many tasks as it has; the folder of the results.

    ``start(stream, root)`` runs what is there and ends; it goes on from its checkpoint each time.
    """
    root = shared_dir(t.spark, part)
    staged = rows.withColumn("step", _by_time(rows, steps=steps) if number is None else number)
    staged.write.partitionBy("step").parquet(f"{root}/staged")
    for i in range(steps):
        t.spark.read.parquet(f"{root}/staged").where(c("step") == i).select(rows.columns).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        start(stream, f"{root}/out").awaitTermination()
    return f"{root}/out"


def _to_files(query: DataFrame, root: str):
    """Append what a native query gives out to files."""
    return query.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True).start()


@query("stream_kanon", "visits", "SELECT event_id FROM labelled WHERE status = 'released'",
       ctes=sql.CLEAN_EVENTS + "," + sql.arrival("clean", _ARRIVAL_KEY, 3), recursive=True)
def stream_kanon(t):
    rows = clean_events(t).select("event_id", "ts", "visitor", "event", "hour")
    root = _stream(t, rows, "gate", lambda s, out: jobs.gate_stream(s, out, _ARRIVAL_QI, 3, ttl_seconds=_NO_TTL, sweep=False))
    return jobs.released_events(t.spark, root).select("event_id")


# All batches are through: the last sweep runs at the newest event time.
_SWEPT_CTES = sql.CLEAN_EVENTS + "," + sql.arrival("clean", _DAY_KEY, 4, 7200, 60, as_of_sql="(SELECT max(ts) FROM clean)")
_DECIDED = "SELECT event_id, status FROM labelled WHERE status <> 'held'"


@query("stream_gate_ttl", "visits", _DECIDED, ctes=_SWEPT_CTES, recursive=True)
def stream_gate_ttl(t):
    """The micro-batch gate with sweeps over batch borders: what was released and what was dropped."""
    rows = clean_events(t).select("event_id", "ts", "visitor", *_DAY_QI)
    root = _stream(t, rows, "gate-ttl", lambda s, out: jobs.gate_stream(s, out, _DAY_QI, 4, ttl_seconds=7200))
    return jobs.decided_events(t.spark, root).select("event_id", "status")


@query("stream_gate_counts", "visits", "SELECT status, count(*) AS events FROM labelled WHERE status <> 'held' GROUP BY status",
       ctes=sql.CLEAN_EVENTS + "," + sql.arrival("clean", _ARRIVAL_KEY, 3, 7200, 60, as_of_sql="(SELECT max(ts) FROM clean)"), recursive=True)
def stream_gate_counts(t):
    rows = clean_events(t).select("event_id", "ts", "visitor", "event", "hour")
    root = _stream(t, rows, "gate-counts", lambda s, out: jobs.gate_stream(s, out, _ARRIVAL_QI, 3, ttl_seconds=7200))
    return jobs.gate_counts(t.spark, root)


@query("stream_kanon_ttl", "visits", _DECIDED, ctes=_SWEPT_CTES, recursive=True)
def stream_kanon_ttl(t):
    """The gate as keyed state with event-time timers."""
    rows = clean_events(t).select("event_id", "ts", "visitor", *_DAY_QI)
    root = _stream(t, rows, "gate-keyed", lambda s, out: _to_files(keyed.keyed_gate(s, _DAY_QI, 4, ttl_seconds=7200), out))
    return t.spark.read.parquet(f"{root}/rows")


@query("stream_usage", "usage_log", _USAGE_SQL)
def stream_usage(t):
    return jobs.stored_usage(t.spark, _stream(t, t.usage_log, "usage", jobs.usage_stream))


_ROLLUP_COLUMNS = ["event_id", "ts", "visitor", "event", "path", "referrer", "country", "device"]
_TOTALS_SQL = """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (event = 'pageview') AS pageviews, count(DISTINCT visitor) AS uniques
FROM clean GROUP BY 1"""


@query("stream_rollup", "visits", _TOTALS_SQL, ctes=sql.CLEAN_EVENTS)
def stream_rollup(t):
    root = _stream(t, clean_events(t).select(*_ROLLUP_COLUMNS), "rollup", jobs.rollup_stream)
    return jobs.stored_totals(t.spark, root).withColumn("day", c("day").cast("string"))


_UNTIMED_STEPS = 10
_UNTIMED_LOG = "SELECT event_id, customer_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts, action FROM {usage_log}"


@query("stream_usage_untimed", "usage_log", _USAGE_SQL.replace("usage_log", f"({_UNTIMED_LOG.format(usage_log='usage_log')})"))
def stream_usage_untimed(t):
    """Rows without a time in every batch, and enough batches for fragments to be folded."""
    root = _stream(t, t.sql(_UNTIMED_LOG), "usage-untimed", jobs.usage_stream, c("event_id") % _UNTIMED_STEPS, _UNTIMED_STEPS)
    return jobs.stored_usage(t.spark, root)


@query("stream_rollup_untimed", "visits", """
SELECT CASE WHEN event_id % 7 <> 0 THEN strftime(day, '%Y-%m-%d') END AS day, count(*) FILTER (event = 'pageview') AS pageviews, count(DISTINCT visitor) AS uniques
FROM clean GROUP BY 1""", ctes=sql.CLEAN_EVENTS)
def stream_rollup_untimed(t):
    rows = clean_events(t).select(*_ROLLUP_COLUMNS).withColumn("ts", F.when(c("event_id") % 7 != 0, c("ts")))
    root = _stream(t, rows, "rollup-untimed", jobs.rollup_stream, c("event_id") % STEPS)
    return jobs.stored_totals(t.spark, root).withColumn("day", c("day").cast("string"))


@query("stream_uniques", "visits", "SELECT strftime(day, '%Y-%m-%d') AS day, true AS within_bound FROM clean GROUP BY 1", ctes=sql.CLEAN_EVENTS)
def stream_uniques(t):
    """Sketched uniques of every day lie within four standard errors of the exact ones."""
    rows = clean_events(t).select("event_id", "ts", "visitor")
    root = _stream(t, rows, "sketches", jobs.sketch_stream, c("event_id") % STEPS)
    exact = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("visitor").alias("exact"))
    near = F.abs(c("uniques") - c("exact")) <= 1 + c("exact") * 4 * 1.04 / 2 ** (jobs.SKETCH_LG_K / 2)
    return jobs.stored_uniques(t.spark, root).join(exact, "day").select(c("day").cast("string").alias("day"), near.alias("within_bound"))


# Out of order: every 50th event comes two steps after its time.
_SHUFFLED_SQL = """
SELECT *, CAST(least(3, floor((us - lo) * 4.0 / (hi - lo + 1)) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END) AS INT) AS step
FROM (SELECT *, min(us) OVER () AS lo, max(us) OVER () AS hi FROM (SELECT *, {us} AS us FROM {rows}))"""


@query("stream_late_counts", "visits", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (NOT late AND event = 'pageview') AS pageviews,
  count(DISTINCT visitor) FILTER (NOT late) AS uniques, count(*) FILTER (late) AS late
FROM (SELECT s.*, coalesce(epoch_us(day + INTERVAL 1 DAY) <= w.newest - 21600000000, false) AS late
  FROM shuffled s LEFT JOIN (SELECT a.step, max(b.us) AS newest FROM (SELECT DISTINCT step FROM shuffled) a JOIN shuffled b ON b.step < a.step GROUP BY 1) w
  ON w.step = s.step) GROUP BY 1""", ctes=sql.CLEAN_EVENTS + f", shuffled AS ({_SHUFFLED_SQL.format(us='epoch_us(ts)', rows='clean')})")
def stream_late_counts(t):
    """Rows behind the watermark of a day are counted beside its totals, so that every row stands somewhere."""
    rows = clean_events(t).select("event_id", "ts", "visitor", "event")
    shuffled = t.spark.sql(_SHUFFLED_SQL.format(us="unix_micros(ts)", rows="{rows}"), rows=rows).drop("us", "lo", "hi")
    root = _stream(t, shuffled, "late", lambda s, out: jobs.closed_days_stream(s.drop("step"), out, 21_600), c("step"))
    late = jobs.late_rows(t.spark, root).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("late"))
    days = jobs.stored_totals(t.spark, root).join(late, "day", "full")
    return days.select(c("day").cast("string").alias("day"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("pageviews", "uniques", "late")])


@query("stream_revoked", "requests revocations", """
SELECT r.request_id FROM requests r WHERE NOT EXISTS (SELECT 1 FROM revocations v WHERE v.api_key = r.api_key
  AND r.ts >= v.revoked_at AND r.ts < v.revoked_at + INTERVAL 24 HOUR)""")
def stream_revoked(t):
    """Requests and revocations as one stream in time order."""
    asked = t.requests.select("ts", "request_id", "api_key", F.lit(None).cast("string").alias("key_hash"))
    revoked = t.revocations.select(c("revoked_at").alias("ts"), F.lit(None).cast("bigint"), F.lit(None).cast("string"), an.short_hash(c("api_key")))

    def start(stream, out):
        requests = stream.where("api_key IS NOT NULL").drop("key_hash")
        return jobs.revoked_stream(requests, stream.where("key_hash IS NOT NULL").select("key_hash", c("ts").alias("revoked_at")), out)

    return jobs.passed_requests(t.spark, _stream(t, asked.union(revoked), "revoked", start)).select("request_id")


@query("stream_suspicious", "visits", _RUNS_SQL)
def stream_suspicious(t):
    """Every 37th failure comes a step late and still joins its runs; a last marker closes all runs."""
    failures = t.sql(_FAILURES)
    number = F.least(F.lit(STEPS - 1), _by_time(failures) + F.when(F.crc32(c("ts").cast("string").cast("binary")) % 37 == 0, 1).otherwise(0))
    last = failures.agg(F.lit(None).cast(failures.schema["source"].dataType).alias("source"), (F.max("ts") + F.expr("INTERVAL 200 DAYS")).alias("ts"))
    numbered = failures.withColumn("_step", number).unionByName(last.withColumn("_step", F.lit(STEPS)))

    def start(stream, out):
        return _to_files(jobs.suspicious_stream(stream.drop("_step"), threshold=3, seconds=172_800, delay="60 days"), out)

    root = _stream(t, numbered, "suspicious", start, c("_step"), STEPS + 1)
    out = t.spark.read.parquet(f"{root}/rows").where("source IS NOT NULL")
    return out.withColumns({"first_failure": text_time(c("first_failure")), "last_failure": text_time(c("last_failure"))})


@query("stream_limit", "visits", """
SELECT hit_id FROM (SELECT hit_id, row_number() OVER (PARTITION BY key, epoch_us(ts) // 86400000000 ORDER BY ts, hit_id) AS n FROM hits) WHERE n <= 2""", ctes=_HIT_DUCK)
def stream_limit(t):
    root = _stream(t, t.sql(_HITS), "limit", lambda s, out: jobs.fixed_limit_stream(s, out, 2, 86400))
    return jobs.allowed_hits(t.spark, root).select("hit_id")


@query("stream_limit_renewing", "visits", "SELECT hit_id FROM walk WHERE ok", ctes=_RENEWING_CTE, recursive=True)
def stream_limit_renewing(t):
    root = _stream(t, t.sql(_HITS), "renewing", lambda s, out: jobs.renewing_limit_stream(s, out, 3, 172_800))
    return jobs.allowed_hits(t.spark, root).select("hit_id")


@query("stream_closed_days", "visits", _TOTALS_SQL.replace("FROM clean", "FROM clean WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM clean) - INTERVAL 1 HOUR"),
       ctes=sql.CLEAN_EVENTS)
def stream_closed_days(t):
    """Days that the watermark has passed, each given out once."""
    rows = clean_events(t).select("event_id", "ts", "visitor", "event")
    root = _stream(t, rows, "closed-days", lambda s, out: _to_files(jobs.closed_day_totals(s), out))
    return t.spark.read.parquet(f"{root}/rows").withColumn("day", c("day").cast("string"))


@query("stream_first_uses", "attestations", "SELECT nonce, count(*) FILTER (false) + 1 AS uses FROM attestations GROUP BY 1")
def stream_first_uses(t):
    """Every nonce counts once, however often it is used."""
    rows = t.attestations.select("nonce", "ts")
    root = _stream(t, rows, "first-uses", lambda s, out: _to_files(jobs.first_uses(s, "400 days"), out))
    return t.spark.read.parquet(f"{root}/rows").groupBy("nonce").agg(F.count("*").alias("uses"))


@query("stream_events", "visits", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT {sql.visitor()}) AS visitors, 0 AS shared_tokens FROM visits GROUP BY 1""")
def stream_events(t):
    """Clean events with a stored salt per open day: one token per visitor and day over all batches, none on two days."""
    vault = SaltVault(t.spark, shared_dir(t.spark, "salts"))
    root = _stream(t, t.visits.drop("section"), "events", lambda s, out: event_stream(s, out, vault, 3600))
    rows = read_part(t.spark, root, "events").withColumn("day", F.to_date("ts").cast("string"))
    days = rows.groupBy("day").agg(F.count("*").alias("events"), F.count_distinct("visitor").alias("visitors"))
    twice = rows.groupBy("visitor").agg(F.count_distinct("day").alias("n"), F.min("day").alias("day")).where("n > 1")
    shared = twice.groupBy("day").agg(F.count("*").alias("shared_tokens"))
    return days.join(shared, "day", "left").fillna(0, ["shared_tokens"])


# ---------------------------------------------------------------- logs as files

# One line per visit. Some are cut, foreign, doubled, lists, of a wrong type or blank.
_LINE_KIND = """CASE WHEN event_id % 10 = 3 THEN 'cut' WHEN event_id % 11 = 4 THEN 'foreign' WHEN event_id % 13 = 5 THEN 'doubled' WHEN event_id % 17 = 6 THEN 'list'
  WHEN event_id % 19 = 7 THEN 'type' WHEN event_id % 23 = 8 THEN 'blank' WHEN event_id % 29 = 9 THEN 'plain' ELSE 'good' END"""
_LINE_REASON = """CASE kind WHEN 'cut' THEN 'broken' WHEN 'doubled' THEN 'broken' WHEN 'plain' THEN 'broken' WHEN 'foreign' THEN 'incomplete'
  WHEN 'list' THEN 'no_object' WHEN 'type' THEN 'bad_field' WHEN 'blank' THEN 'empty' END"""
_LANES_SQL = f"""
SELECT 'day' AS lane, strftime(ts, '%Y-%m-%d') AS key, count(*) FILTER (e = 'pageview') AS n FROM lines WHERE kind = 'good' GROUP BY 2
UNION ALL SELECT 'rejected', {_LINE_REASON}, count(*) FROM lines WHERE kind <> 'good' GROUP BY 2"""
_LANES_CTE = f"lines AS (SELECT *, {_LINE_KIND} AS kind FROM visits)"


def _beacon_lines(visits: DataFrame) -> DataFrame:
    fields_ = [x for x in visits.columns if x not in ("user_id", "section")]
    whole = F.to_json(F.struct(*fields_))
    kind = c("kind")
    line = (
        F.when(kind == "cut", F.substring(whole, F.lit(1), F.floor(F.length(whole) * 2 / 3).cast("int")))
        .when(kind == "foreign", F.to_json(F.struct(c("event_id").alias("item"), F.lit("x").alias("text"))))
        .when(kind == "doubled", F.concat(whole, whole)).when(kind == "list", F.concat(F.lit("["), whole, F.lit("]")))
        .when(kind == "type", F.to_json(F.struct(c("event_id"), F.array("e").alias("ts")))).when(kind == "blank", F.lit("  "))
        .when(kind == "plain", F.concat(F.lit("GET "), c("u"))).otherwise(whole)
    )
    return visits.withColumn("kind", F.expr(_LINE_KIND)).select("event_id", line.alias("value"))


def _lanes(good: DataFrame, rejected: DataFrame) -> DataFrame:
    days = rollup.daily_totals(events.build_events(good, SALTS)).select(F.lit("day").alias("lane"), c("day").cast("string").alias("key"), c("pageviews").alias("n"))
    return days.unionByName(io.rejected_counts(rejected).select(F.lit("rejected").alias("lane"), c("reason").alias("key"), c("lines").alias("n")))


@query("beacons_rejected", "visits", _LANES_SQL, ctes=_LANES_CTE)
def beacons_rejected(t):
    """A beacon log with lines that are no beacon: reports count the beacons, the others are counted by reason."""
    folder = shared_dir(t.spark, "beacons")
    _beacon_lines(t.visits).select("value").write.text(folder)
    return _lanes(*io.beacon_lanes(t.spark, folder))


@query("stream_beacons", "visits", _LANES_SQL, ctes=_LANES_CTE)
def stream_beacons(t):
    root = _stream(t, _beacon_lines(t.visits), "beacon-lines", lambda s, out: jobs.lane_stream(s.drop("event_id"), out), c("event_id") % STEPS)
    return _lanes(jobs.accepted_records(t.spark, root), jobs.rejected_lines(t.spark, root))


@query("requests_read", "requests", "SELECT tracker_host, count(*) AS requests, sum(length(coalesce(body, '')))::BIGINT AS body_chars FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS tracker_host FROM requests) GROUP BY 1")
def requests_read(t):
    """The request log, written as JSON lines and read back."""
    folder = shared_dir(t.spark, "requests")
    t.requests.drop("section").write.json(folder)
    read = io.read_requests(t.spark, folder)
    return read.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("tracker_host")).agg(
        F.count("*").alias("requests"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("body_chars")
    )


@query("page_requests_read", "visits", """
SELECT page_host, count(*) AS requests, count(DISTINCT url) AS urls FROM (SELECT regexp_replace(origin, '^https?://', '') AS page_host, r AS url FROM visits WHERE r <> '')
WHERE page_host <> '' GROUP BY 1""")
def page_requests_read(t):
    """Page observations as JSON lines; those without a page or URL are set aside."""
    folder = shared_dir(t.spark, "page-requests")
    seen = t.visits.select(F.regexp_replace("origin", "^https?://", "").alias("page_host"), "ts", F.nullif(c("r"), F.lit("")).alias("url"))
    seen.write.json(folder)
    return io.read_page_requests(t.spark, folder).where("page_host <> ''").groupBy("page_host").agg(
        F.count("*").alias("requests"), F.count_distinct("url").alias("urls")
    )


@query("accounts_read", "customers", "SELECT plan, count(*) FILTER (enabled) AS enabled, count(*) AS accounts FROM customers WHERE plan <> 'test' GROUP BY 1")
def accounts_read(t):
    """The account scan from files, with the condition pushed into it."""
    folder = shared_dir(t.spark, "accounts")
    t.customers.write.parquet(folder)
    rows = io.read_dimension(t.spark, "customers", folder).where("plan <> 'test'")
    return rows.groupBy("plan").agg(F.count_if(c("enabled")).alias("enabled"), F.count("*").alias("accounts"))


@query("list_caps", "", f"""
SELECT doc_id, least(150, 120 + doc_id % 60) AS n_domains, 'd' || least(150, 120 + doc_id % 60) || '-' || doc_id || '.nl' AS last_domain,
  regexp_replace(substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 500), '<[^>]*>', '', 'g') AS cut_text
FROM documents""")
def list_caps(t):
    """Lists and texts that are longer than their caps."""
    listed = F.transform(F.sequence(F.lit(1), (F.lit(120) + c("doc_id") % 60).cast("int")), lambda i: F.concat(F.lit("https://www.D"), i, F.lit("-"), c("doc_id"), F.lit(".nl/x")))
    kept = fields.clean_domains(F.array_join(listed, ","))
    return t.documents.select("doc_id", kept.alias("kept"), fields.clean_text(c("text")).alias("cut_text")).select(
        "doc_id", F.size("kept").cast("long").alias("n_domains"), F.element_at("kept", -1).alias("last_domain"), "cut_text"
    )


@query("clean_requests_written", "requests", f"""
SELECT request_id, {_strip_sql('piwik_pro')} AS clean_url FROM (SELECT *, {_ROUTE_SQL} AS route FROM requests) WHERE route = 'piwik'""")
def clean_requests_written(t):
    """Clean requests handed to the forwarder as files, in two appends."""
    folder = shared_dir(t.spark, "clean-requests")
    clean = events.strip_requests(t.requests, SALTS).where(c("route") == "piwik").select("request_id", "clean_url")
    for half in (0, 1):
        io.write_clean_requests(clean.where(c("request_id") % 2 == half), folder)
    return t.spark.read.parquet(folder)


# ---------------------------------------------------------------- composed flows

_COUNTED_SQL = """CASE WHEN url = '' AND route <> 'generic' THEN 'blocked' WHEN url = '' THEN NULL WHEN route <> 'generic' THEN 'stripped'
    WHEN action = 'block' THEN 'blocked' WHEN action = 'strip' THEN 'stripped' ELSE 'allowed' END"""
_RESOLVED_CTE = f"""resolved AS (SELECT r.*, {_ROUTE_SQL} AS route, h.tracker, coalesce(o.action, h.default_action) AS action
  FROM requests r LEFT JOIN hits h USING (request_id) LEFT JOIN overrides o ON o.tracker = h.tracker)"""
_FLOW_CTE = ", ".join([_HIT_CTE, _override_cte("ultra-streng"), _RESOLVED_CTE])


@query("feed_flow", "requests projects", f"""
SELECT p.feed_hash, '2024-01' AS month, {', '.join(f'coalesce(u.{k}, 0) AS {k}' for k in usage.COUNTERS)}, {', '.join(map(_pct, usage.COUNTERS[1:]))}
FROM projects p LEFT JOIN (SELECT customer_id, count(*) AS requests, {', '.join(f"count(*) FILTER (counted = '{k}') AS {k}" for k in usage.COUNTERS[1:])}
  FROM (SELECT customer_id, {_COUNTED_SQL} AS counted FROM resolved WHERE strftime(ts, '%Y-%m') = '2024-01') WHERE counted IS NOT NULL GROUP BY 1) u
ON u.customer_id = 'c' || p.customer_id_ref""", ctes=_FLOW_CTE)
def feed_flow(t):
    projects = t.projects.withColumn("customer_id_ref", F.concat(F.lit("c"), c("customer_id_ref")))
    return reports.feed(t.requests, projects, "2024-01")[0]


@query("feed_flow_breakdown", "requests projects", f"""
SELECT p.feed_hash, coalesce(tracker, 'unknown') AS tracker, {', '.join(f"count(*) FILTER (counted = '{k}') AS {k}" for k in usage.COUNTERS[1:])}
FROM (SELECT customer_id, tracker, {_COUNTED_SQL} AS counted FROM resolved WHERE url <> '') u JOIN projects p ON u.customer_id = 'c' || p.customer_id_ref
GROUP BY 1, 2""", ctes=_FLOW_CTE)
def feed_flow_breakdown(t):
    projects = t.projects.withColumn("customer_id_ref", F.concat(F.lit("c"), c("customer_id_ref")))
    return reports.feed(t.requests, projects, "2024-01")[1]


@query("vendor_lanes", "requests customers projects revocations", f"""
SELECT lane, count(*) AS requests, count(clean_url) AS forwarded, sum(CASE WHEN lane = 'generic' AND clean_url IS NOT NULL THEN length({sql.join_query("split_part(split_part(url, '#', 1), '?', 1)", _GENERIC_KEPT)}
    || regexp_extract(url, '(#.*)$', 1)) ELSE 0 END)::BIGINT AS generic_chars,
  count(*) FILTER (clean_url IS NOT NULL AND lane = 'ga4' AND len(list_filter({sql.params('url')}, lambda p: split_part(p, '=', 1) IN ('cid', 'uid'))) > 0) AS cid_replaced
FROM (SELECT request_id, url, lane, CASE WHEN disposition = 'forwarded' THEN url END AS clean_url FROM (
  SELECT r.*, CASE WHEN route <> 'generic' THEN route WHEN tracker = 'ga4' THEN 'ga4' WHEN tracker = 'meta_pixel' THEN 'meta' ELSE 'generic' END AS lane,
    CASE WHEN url = '' THEN 'dropped' WHEN route <> 'generic' THEN 'forwarded' WHEN action = 'block' THEN 'blocked'
      WHEN action IN ('allow', 'strip') THEN 'forwarded' ELSE 'processed' END AS disposition
  FROM resolved r)) GROUP BY 1""", ctes=_FLOW_CTE)
def vendor_lanes(t):
    """All five lanes of the composed flow: what leaves, and that no identifier does."""
    clean = events.clean_requests(classify.resolve_trackers(t.requests), SALTS)
    raw_id = F.regexp_extract("url", r"[?&]cid=([^&#]*)", 1)
    gone = (c("lane") == "ga4") & (raw_id != "") & ~F.contains(c("clean_url"), F.concat(F.lit("cid="), raw_id)) & ~F.contains(c("clean_url"), F.lit("uid="))
    return clean.groupBy("lane").agg(
        F.count("*").alias("requests"), F.count("clean_url").alias("forwarded"),
        F.coalesce(F.sum(F.when(c("lane") == "generic", F.length("clean_url"))), F.lit(0)).alias("generic_chars"), F.count_if(gone).alias("cid_replaced"),
    )


@query("vendor_flow", "requests customers projects revocations", f"""
SELECT request_id, account, tracker, CASE WHEN route <> 'generic' THEN route WHEN tracker = 'ga4' THEN 'ga4' WHEN tracker = 'meta_pixel' THEN 'meta' ELSE 'generic' END AS lane,
  CASE WHEN url = '' THEN 'dropped' WHEN route <> 'generic' THEN 'forwarded' WHEN action = 'block' THEN 'blocked'
    WHEN action IN ('allow', 'strip') THEN 'forwarded' ELSE 'processed' END AS disposition, {_COUNTED_SQL} AS counted_as,
  CASE route WHEN 'piwik' THEN {_strip_sql('piwik_pro')} WHEN 'adobe' THEN {_strip_sql('adobe_analytics')} END AS strip_url
FROM (SELECT r.*, a.account FROM resolved r JOIN (SELECT *, {sql.host('origin')} AS host FROM ({_AUTH_SQL})) a USING (request_id)
  WHERE (a.domains = '' OR len(list_filter(string_split(a.domains, ','), lambda d: a.host = d OR ends_with(a.host, '.' || d))) > 0)
  AND NOT EXISTS (SELECT 1 FROM revocations v WHERE v.api_key = r.api_key AND r.ts >= v.revoked_at AND r.ts < v.revoked_at + INTERVAL 24 HOUR))""",
       ctes=_FLOW_CTE)
def vendor_flow(t):
    revoked = t.revocations.select(an.short_hash(c("api_key")).alias("key_hash"), "revoked_at")
    # Each customer also has a younger project, which must not double its requests.
    younger = _projects(t).withColumns({"id": c("id") + 5_000_000_000, "feed_hash": F.lit("younger"), "allowed_domains": F.array(F.lit("none.example"))})
    clean, _ = reports.vendor_flow(t.requests, t.customers, _projects(t).unionByName(younger), revoked, SALTS)
    strip = F.when(c("lane").isin("piwik", "adobe"), c("clean_url"))
    return clean.select("request_id", c("customer_id").alias("account"), "tracker", "lane", "disposition", "counted_as", strip.alias("strip_url"))


@query("united_gate", "visits requests", "SELECT event_id, status FROM labelled", recursive=True, ctes=sql.CLEAN_EVENTS + f""",
both_lanes AS (SELECT event_id, ts, visitor, event, hour FROM clean
  UNION ALL SELECT request_id + 1000000000, ts, {sql.visitor()}, 'tracker_' || key, date_trunc('hour', ts)
  FROM (SELECT *, CASE {_ROUTE_SQL} WHEN 'piwik' THEN '{ROUTE_TRACKER['piwik']}' WHEN 'adobe' THEN '{ROUTE_TRACKER['adobe']}' END AS key FROM requests)
  WHERE key IS NOT NULL),""" + sql.arrival("both_lanes", _ARRIVAL_KEY, 3))
def united_gate(t):
    vendor = events.vendor_events(t.requests, SALTS).withColumn("event_id", c("request_id") + 1_000_000_000)
    out = reports.united_gate(t.visits, vendor, SALTS, _ARRIVAL_QI, 3, ttl_seconds=_NO_TTL)
    return out.select("event_id", "status")
