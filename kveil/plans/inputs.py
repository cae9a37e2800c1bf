"""Input views derived from the test tables.

Each view is one SQL text that Spark and DuckDB both run, so that a query and its
oracle start from the same rows. Table and view names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kveil.session import ship_package

TABLES = "events pages documents conversations customer orders".split()
NOW = "2024-01-31 00:00:00"

# Raw visits: every event gets a page, a referrer page and the fields of a browser request.
VISITS = """
SELECT e.event_id, CAST(e.ts AS TIMESTAMP) AS ts, e.user_id,
  concat('10.', e.user_id % 200, '.', (e.user_id * 7) % 256, '.', e.event_id % 256) AS ip,
  CASE e.user_id % 6
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64) Firefox/120.0'
    WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
    WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36'
    WHEN 3 THEN 'Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Version/17.0 Safari/604.1'
    WHEN 4 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Version/17.0 Safari/605.1'
    ELSE 'Mozilla/5.0 (compatible; ExampleBot/1.0; crawler)' END AS ua,
  regexp_extract(p.url, '^https?://[^/]+', 0) AS origin, CAST(NULL AS STRING) AS d,
  CASE WHEN e.event_type = 'view' THEN 'pageview' ELSE e.event_type END AS e,
  CASE WHEN e.event_id % 4 = 0
    THEN concat(split_part(regexp_replace(p.url, '^https?://[^/]+', ''), '#', 1),
                CASE WHEN instr(p.url, '?') > 0 THEN '&' ELSE '?' END, 'gclid=g', e.event_id)
    ELSE regexp_replace(p.url, '^https?://[^/]+', '') END AS u,
  regexp_extract(p.url, '^https?://[^/]+/([^/?#]+)', 1) AS section,
  CASE WHEN e.event_id % 3 = 0 THEN '' ELSE regexp_extract(r.url, '^https?://[^/]+', 0) END AS r,
  CASE e.user_id % 7 WHEN 0 THEN 'nl' WHEN 1 THEN 'T1' WHEN 2 THEN 'DE' WHEN 3 THEN 'BE' ELSE 'NL' END AS country,
  e.props AS p
FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page_key,
        (event_id * 3 + 1) % (SELECT count(*) FROM {pages}) AS ref_key FROM {events}) e
JOIN {pages} p ON p.page_id = e.page_key
JOIN {pages} r ON r.page_id = e.ref_key
"""

# Requests to trackers; the URLs carry identifiers, and every account sends many of them.
REQUESTS = """
SELECT v.event_id AS request_id, v.ts, concat('c', v.user_id) AS customer_id,
  concat('wk_', md5(CAST(v.user_id AS STRING)), substr(md5(concat('k', v.user_id)), 1, 16)) AS api_key,
  CASE WHEN v.event_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE v.event_id % 13
    WHEN 0 THEN concat('https://www.google-analytics.com/g/collect?v=2&tid=G-', v.user_id, '&cid=', v.user_id, '.2&en=page_view&dl=', v.origin, '&uid=u', v.user_id)
    WHEN 1 THEN concat('https://stad.piwik.pro/t/web?url=', v.origin, '&e_c=form&uid=u', v.user_id, '&rec=1&token_auth=K', v.event_id % 9, '&cip=', v.ip, '&_id=f', v.event_id, '&idsite=8')
    WHEN 2 THEN concat('https://t.sc.omtrdc.net/b/ss/r/1?vid=V', v.user_id, '&aid=', v.event_id, '&c_ip=', v.ip, '&email=u', v.user_id, '@example.nl&eVar5=x&pe=o&page=p', v.event_id % 7)
    WHEN 3 THEN concat('https://dpm.demdex.net/id?d_mid=', v.event_id)
    WHEN 4 THEN concat('https://www.facebook.com/tr?id=', v.user_id, '&ev=PageView&fbp=f', v.event_id, '&em=u', v.user_id, '@example.nl')
    WHEN 5 THEN 'https://static.hotjar.com/c/hotjar-1.js'
    WHEN 6 THEN concat('https://cdn.cookielaw.org/x?uid=', v.user_id, '&k=1#top')
    WHEN 7 THEN 'https://consent.cookiebot.com/uc.js'
    WHEN 8 THEN concat('https://target.com/x?email=u', v.user_id, '@example.nl&q=', v.event_id % 5)
    WHEN 9 THEN concat('https://js.intercomcdn.com/a?user_id=', v.user_id)
    WHEN 10 THEN concat(v.origin, v.u)
    WHEN 11 THEN concat('https://relay.example/collect?k=', v.event_id % 3)
    ELSE '' END AS url,
  v.p AS body, v.ip, v.ua, v.origin, v.country, v.section
FROM {visits} v
"""

USAGE_LOG = """
SELECT o_orderkey AS event_id, concat('c', o_custkey) AS customer_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'blocked' WHEN '2-HIGH' THEN 'strip' WHEN '3-MEDIUM' THEN 'allow'
    WHEN '4-NOT SPECIFIED' THEN 'block' ELSE 'other' END AS action
FROM {orders}
"""

# Accounts: one user per customer row, one account per order, newest orders last.
USERS = """
SELECT c_custkey AS id, concat('u', c_custkey % 1200, '@example.nl') AS email,
  TIMESTAMP '2020-01-01 00:00:00' + c_custkey * INTERVAL '1' HOUR AS created_at,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN TIMESTAMP '2023-06-01 00:00:00' END AS deleted_at
FROM {customer}
"""
CUSTOMERS = """
SELECT o_orderkey AS id, o_custkey AS user_id,
  concat('wk_', md5(CAST(o_orderkey AS STRING)), substr(md5(concat('k', o_orderkey)), 1, 16)) AS api_key,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'pro' WHEN '3-MEDIUM' THEN 'business' ELSE 'starter' END AS plan,
  o_orderstatus <> 'F' AS enabled, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders}
"""
PROJECTS = """
SELECT o_orderkey + 1000000000 AS id, o_orderkey AS customer_id_ref, concat('Site ', o_orderkey) AS name,
  substr(md5(concat('f', o_orderkey)), 1, 16) AS feed_hash,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a.nl,example.com' WHEN 2 THEN concat('s', o_orderkey % 50, '.example.org,example.net')
    ELSE 'ba.nl,www.ththre.example.com' END AS domains
FROM {orders}
"""
SUBSCRIPTIONS = """
SELECT o_orderkey AS customer_id_ref, 'pro' AS plan,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'trialing' END AS status
FROM {orders} WHERE o_orderpriority <> '5-LOW'
"""
REVOCATIONS = """
SELECT concat('wk_', md5(CAST(o_orderkey AS STRING)), substr(md5(concat('k', o_orderkey)), 1, 16)) AS api_key,
  TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 700) * INTERVAL '1' HOUR AS revoked_at
FROM {orders} WHERE o_orderpriority = '1-URGENT'
"""
FEED_EVENTS = """
SELECT r.request_id AS event_id, substr(md5(concat('f', substr(r.customer_id, 2))), 1, 16) AS feed_hash, r.ts,
  CASE r.request_id % 5 WHEN 0 THEN 'ga4' WHEN 1 THEN 'hotjar' WHEN 2 THEN '' WHEN 3 THEN 'meta_pixel' END AS tracker,
  CASE r.request_id % 6 WHEN 0 THEN 'block' WHEN 1 THEN 'blocked' WHEN 2 THEN 'strip' WHEN 3 THEN 'stripped' WHEN 4 THEN 'allow' END AS action
FROM {requests} r
"""
ATTESTATIONS = """
SELECT v.event_id, regexp_replace(v.origin, '^https?://', '') AS domain,
  CASE v.event_id % 5 WHEN 0 THEN 'other.example' ELSE upper(regexp_replace(v.origin, '^https?://', '')) END AS inspected,
  v.ts, (v.user_id % 40) * 86400000 AS ttl_ms, concat('n', v.event_id % (v.user_id * 30 + 7)) AS nonce,
  CASE v.user_id % 9 WHEN 0 THEN 'other' ELSE 'pinned' END AS public_key,
  v.user_id % 4 <> 0 AS enrolled, CASE v.user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS signature_valid
FROM {visits} v
"""

VIEWS = {
    "visits": VISITS, "requests": REQUESTS, "usage_log": USAGE_LOG, "users": USERS, "customers": CUSTOMERS,
    "projects": PROJECTS, "subscriptions": SUBSCRIPTIONS, "revocations": REVOCATIONS, "feed_events": FEED_EVENTS,
    "attestations": ATTESTATIONS,
}
_NAME = re.compile(r"\{(\w+)\}")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a source that has fewer splits than the session has cores.

    A small file is one split; a large source has many and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Inputs:
    """The test tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return spread(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    def sql(self, text: str) -> DataFrame:
        names = set(_NAME.findall(text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def duckdb_views(*names: str) -> str:
    """The named views and what they need, as a WITH list for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for needed in _NAME.findall(VIEWS[name]):
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    texts = [f"{n} AS ({_NAME.sub(r'\1', VIEWS[n]).strip()})" for n in order]
    return ", ".join(texts).replace("AS STRING", "AS VARCHAR")
