"""DuckDB expressions for the oracle SQL, written independently of the Spark columns."""

from __future__ import annotations

from kveil.functions.scrub import TRACKING_PARAMS

TEST_SALT = bytes(range(32))
_PAD_IN = bytes(b ^ 0x36 for b in TEST_SALT.ljust(64, b"\0")).hex()
_PAD_OUT = bytes(b ^ 0x5C for b in TEST_SALT.ljust(64, b"\0")).hex()

_SPACE = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# The six patterns with their tags.
_PII = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (rf"\+?\d[\d{_SPACE}().-]{{7,}}\d", "[phone]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[ip]"),
    (r"\b(?:[A-Fa-f0-9]{1,4}:){2,}[A-Fa-f0-9]{0,4}\b", "[ip6]"),
    (r"\b\d{13,19}\b", "[num]"),
    (r"\b\d{9}\b", "[id]"),
]


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _pads(salt: bytes) -> tuple[str, str]:
    return tuple(bytes(b ^ x for b in salt.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


def token(message: str, salts: dict[str, bytes] | None = None, epoch: str = "") -> str:
    """Keyed token under the test salt, or under the salt of ``epoch`` (an expression) in ``salts`` by its text."""
    pad_in, pad_out = f"'{_PAD_IN}'", f"'{_PAD_OUT}'"
    if salts:
        pad_in, pad_out = (f"CASE {epoch} {' '.join(f"WHEN {e} THEN '{_pads(s)[k]}'" for e, s in salts.items())} END" for k in (0, 1))
    inner = f"from_hex(sha256(from_hex({pad_in}) || encode({message})))"
    return f"substr(sha256(from_hex({pad_out}) || {inner}), 1, 16)"


def ip24(ip: str) -> str:
    return f"(split_part({ip}, '.', 1) || '.' || split_part({ip}, '.', 2) || '.' || split_part({ip}, '.', 3) || '.0/24')"


def ua_class(ua: str) -> str:
    low = f"lower({ua})"
    return (
        f"(CASE WHEN contains({low}, 'firefox') THEN 'ff' WHEN contains({low}, 'edg/') THEN 'edge' "
        f"WHEN contains({low}, 'chrome') THEN 'chrome' WHEN contains({low}, 'safari') THEN 'safari' ELSE 'other' END || '/' || "
        f"CASE WHEN contains({low}, 'windows') THEN 'win' WHEN contains({low}, 'android') THEN 'android' "
        f"WHEN contains({low}, 'iphone') OR contains({low}, 'ipad') THEN 'ios' WHEN contains({low}, 'mac os') THEN 'mac' "
        f"WHEN contains({low}, 'linux') THEN 'linux' ELSE 'other' END)"
    )


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^https?://(?:[^/?#@]*@)?([^/?#]+)', 1))"


def visitor(ip: str = "ip", ua: str = "ua", origin: str = "origin") -> str:
    return token(f"{ip24(ip)} || '|' || {ua_class(ua)} || '|' || {host(origin)}")


def scrub(text: str) -> str:
    for pattern, tag in _PII:
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return text


def params(url: str) -> str:
    """Non-empty parameters of the query of a URL."""
    query = f"regexp_extract(split_part({url}, '#', 1), '^[^?]*\\?(.*)$', 1)"
    return f"list_filter(string_split({query}, '&'), lambda p: p <> '')"


def name(param: str) -> str:
    return f"split_part({param}, '=', 1)"


def join_query(base: str, kept: str) -> str:
    return f"{base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def base(url: str) -> str:
    return f"regexp_replace(split_part(split_part({url}, '#', 1), '?', 1), '^(https?://)[^/]*@', '\\1')"


def scrub_url(url: str) -> str:
    kept = f"list_filter({params(url)}, lambda p: lower({name('p')}) NOT IN ({words(TRACKING_PARAMS)}))"
    return scrub(f"({join_query(base(url), kept)})")


def device(ua: str) -> str:
    low = f"lower({ua})"
    return (
        f"CASE WHEN regexp_matches({low}, 'ipad|tablet') THEN 'tablet' "
        f"WHEN regexp_matches({low}, 'mobi|iphone|android.*mobile') THEN 'mobile' "
        f"WHEN regexp_matches({low}, 'bot|crawl|spider|headless') THEN 'bot' ELSE 'desktop' END"
    )


def country(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^[A-Za-z]{{2}}$') THEN upper({col}) ELSE '??' END"


CLEAN_EVENTS = f"""clean AS (
  SELECT event_id, ts, user_id, section, {visitor()} AS visitor, {host('origin')} AS domain, {host('origin')} AS origin,
    e AS event, {scrub_url('u')} AS path, CASE WHEN r = '' THEN '' ELSE {scrub_url('r')} END AS referrer,
    {country('country')} AS country, {device('ua')} AS device,
    '{{"k":' || json_extract_string(p, '$.k') || '}}' AS props, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day
  FROM visits)"""


def arrival(source: str, bucket: str, k: int, ttl: int | None = None, sweep: int = 60, as_of: str | None = None, as_of_sql: str | None = None) -> str:
    """CTEs ending in ``labelled(event_id, status, ...)``: the arrival-mode gate, row by row."""
    late = "false" if ttl is None else f"o.us // {sweep}000000 >= (s.first_us + {ttl}000000) // {sweep}000000 + 1"
    at = as_of_sql or (as_of and f"TIMESTAMP '{as_of}'")
    over = (
        "false" if ttl is None or at is None else
        f"((first_us + {ttl}000000) // {sweep}000000 + 1) * {sweep}000000 <= epoch_us({at})"
    )
    fresh = f"(s.closed OR {late})"
    seen = f"CASE WHEN {fresh} THEN [o.visitor] ELSE list_distinct(list_append(s.seen, o.visitor)) END"
    return f"""
o AS (SELECT event_id, visitor, epoch_us(ts) AS us, {bucket} AS bucket,
    row_number() OVER (PARTITION BY {bucket} ORDER BY ts, event_id) AS rn FROM {source}),
step AS (
  SELECT bucket, rn, event_id, us AS first_us, [visitor] AS seen, 1 AS run, false AS closed FROM o WHERE rn = 1
  UNION ALL
  SELECT o.bucket, o.rn, o.event_id, CASE WHEN {fresh} THEN o.us ELSE s.first_us END, {seen},
    s.run + CASE WHEN {fresh} THEN 1 ELSE 0 END, len({seen}) >= {k}
  FROM step s JOIN o ON o.bucket = s.bucket AND o.rn = s.rn + 1),
runs AS (SELECT bucket, run, bool_or(closed) AS released, min(first_us) AS first_us FROM step GROUP BY ALL),
ends AS (SELECT bucket, max(run) AS last_run FROM runs GROUP BY ALL),
labelled AS (
  SELECT s.event_id, s.bucket, CASE WHEN r.released THEN 'released' WHEN r.run < e.last_run THEN 'dropped'
      WHEN {over.replace('first_us', 'r.first_us')} THEN 'dropped' ELSE 'held' END AS status
  FROM step s JOIN runs r ON r.bucket = s.bucket AND r.run = s.run JOIN ends e ON e.bucket = s.bucket)"""
